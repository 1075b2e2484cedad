"""Phrase collocation mining: substrings of words from suffix automata of shards, counts reduced globally.

A first pass counts hashes of words, pairs and triples; a Bloom filter of those frequent enough, of a fixed size, then tells
shards which can be part of a frequent phrase. In the second pass each shard, some MB of text, builds the
generalised suffix automaton of its pieces to a depth of `most_words`, cut where a pair or triple is rare, and emits its
substrings with the counts of their end places; these are summed as words, so nothing rests on hashes. A frequent phrase
is subsumed if a phrase that it ends (one suffix link away in the automaton of all shards) or begins occurs as often; longer
ones need no look, as all between them occur as often, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verascope.llm.automaton import levels
from verascope.llm.bloom import bloom, passes
from verascope.llm.common import written
from verascope.llm.tokens import Words, gathered, mix, words

BREAKERS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_BYTE = np.arange(256)
_BREAKS = np.isin(_BYTE, list(BREAKERS))
_STEP = np.uint64(0xD1342543DE82EF95)
_INSIDE = ~np.isin(_BYTE, list(BREAKERS + BLANKS))
#: Bytes of text of a shard. Python holds about twenty times as much.
SHARD = 4 << 20
#: Parts that a language's phrases are dealt over before its first ones are chosen: these parts' first ones meet in one task.
SALTS = 128


class Shard:
    """Words of some texts, the languages' numbers, and how many words up to each hang together in its piece."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        texts = [(x or "").encode("utf-8", "replace").lower() for x in batch.column(0).to_pylist()]
        self.found: Words = words(texts, _INSIDE)
        langs = pc.fill_null(batch.column(1), "und").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy()[self.found.text_of()] if len(self.found.hashes) else np.empty(0, np.int32)
        f = self.found
        breaks = np.zeros(len(f.data) + 1, np.int32)
        np.cumsum(_BREAKS[f.data], out=breaks[1:])
        # the texts themselves are parted by a line feed
        self.joined = np.zeros(len(f.start), bool)
        self.joined[1:] = breaks[f.start[1:]] == breaks[f.end[:-1]]

    def hashes(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Hashes of each word, by language; and of each with the word before it and with the two before it, and where these hang together."""
        salt = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs] or [0], np.uint64)
        h = mix(self.found.hashes ^ salt[self.lang]) if len(self.lang) else self.found.hashes
        pairs = np.zeros(len(h), np.uint64)
        pairs[1:] = mix(h[:-1] * _STEP + h[1:])
        triples, three = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
        triples[2:] = mix(pairs[1:-1] * _STEP + h[2:])
        three[2:] = self.joined[2:] & self.joined[1:-1]
        return h, [(pairs, self.joined), (triples, three)]

    def numbers(self) -> np.ndarray:
        """A number for each word: equal for equal words of one language only."""
        f = self.found
        inside = _INSIDE[f.data]
        ends = np.zeros(len(f.start) + 1, np.int32)
        np.cumsum(f.end - f.start, out=ends[1:])
        values = pa.Array.from_buffers(pa.binary(), len(f.start), [None, pa.py_buffer(ends), pa.py_buffer(f.data[inside])])
        return values.dictionary_encode().indices.to_numpy().astype(np.int64) * max(1, len(self.langs)) + self.lang

    def phrases(self, places: np.ndarray, k: int) -> pa.Array:
        """The k words that end at each place, space-joined."""
        f = self.found
        parts = []
        for j in range(k - 1, -1, -1):
            parts.append((f.start[places - j], f.end[places - j] - f.start[places - j]))
        sizes = sum(n for _, n in parts) + (k - 1)
        ends = np.zeros(len(places) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        out = np.full(int(ends[-1]), ord(" "), np.uint8)
        at = ends[:-1].copy()
        for start, n in parts:
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at, n) + step] = f.data[np.repeat(start, n) + step]
            at += n + 1
        return pa.Array.from_buffers(pa.large_utf8(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.utf8())


def _parts(df: DataFrame) -> int:
    """Parts that counts are dealt over: a power of two, several for each shuffle partition."""
    return 1 << (4 * max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows of equal first columns, which come sorted, as slices of batches."""
    now, held = None, []
    for b in batches:
        names = list(zip(*(b.column(k).to_pylist() for k in range(keys)), strict=True))
        at = 0
        while at < len(names):
            to = at + 1
            while to < len(names) and names[to] == names[at]:
                to += 1
            if names[at] != now:
                if held:
                    yield now, held
                now, held = names[at], []
            held.append(b.slice(at, to - at))
            at = to
    if held:
        yield now, held


def _flat(rows: list[pa.RecordBatch], column: int) -> pa.Array:
    return pa.concat_arrays([r.column(column).flatten() for r in rows])


def _reduced(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of a hash and 32 bits more: enough for a filter, at half the bytes."""
    return h >> np.uint64(32 - (parts.bit_length() - 1))


def _likely(df: DataFrame, least: int, parts: int) -> DataFrame:
    """(key) of hashes of words, pairs and triples that occur `least` times or more.

    A shard's counts travel as one row for each part that they are dealt to, and a part is summed by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, 0, SHARD):
            h, longer = Shard(part).hashes()
            key, count = np.unique(_reduced(np.concatenate([h, *(x[there] for x, there in longer)]), parts), return_counts=True)
            place, first = np.unique((key >> np.uint64(32)).astype(np.int32), return_index=True)
            ends = pa.array(np.append(first, len(key)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.ListArray.from_arrays(ends, pa.array(key.astype(np.uint32).view(np.int32))), pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))], ["part", "keys", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in _groups(batches, 1):
            key, of = np.unique(_flat(rows, 1).to_numpy().view(np.uint32), return_inverse=True)
            n = np.bincount(of, _flat(rows, 2).to_numpy(), len(key))
            found = key[n >= least].astype(np.uint64) | np.uint64(part << 32)
            yield pa.RecordBatch.from_arrays([pa.array(mix(found).view(np.int64))], ["key"])

    dealt = df.mapInArrow(run, "part int, keys array<int>, n array<int>").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(add, "key long")


def _substrings(source: DataFrame, table: np.ndarray, most_words: int, parts: int) -> DataFrame:
    """(part, lang, k, phrases, f) of every shard's substrings that can be frequent, and of its word count as k = 0: a row for each
    language, length and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "lang", "k", "phrases", "f"]
        for shard_rows in gathered(batches, 0, SHARD):
            shard = Shard(shard_rows)
            langs = pa.array(shard.langs, pa.utf8())
            total = np.bincount(shard.lang, minlength=len(shard.langs))
            one = pa.array(range(len(langs) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(langs), np.int32)), langs, pa.array(np.zeros(len(langs), np.int32)), pa.ListArray.from_arrays(one, pa.array([""] * len(langs), pa.utf8())), pa.ListArray.from_arrays(one, pa.array(total, pa.int64()))], names
            )
            if not len(shard.lang):
                continue
            h, longer = shard.hashes()
            known, two, three = (there & passes(table, mix(_reduced(x, parts))) for x, there in ((h, np.ones(len(h), bool)), *longer))
            # how long a phrase that ends here can be: a word, a pair, or as many as triples in a row give; a rare word is left out
            at = np.arange(len(h), dtype=np.int32)
            in_a_row = at - np.maximum.accumulate(np.where(three, 0, at))
            run_length = np.where(in_a_row > 0, in_a_row + 2, np.where(two, 2, 1)).astype(np.int32)
            run_length[~known] = 0
            del longer, known, two, three, at, in_a_row
            shard.found.hashes = h
            numbers = shard.numbers()
            for k, level in enumerate(levels(numbers, run_length, most_words), 1):
                if not len(level.place):
                    break
                key = h[level.place - (k - 1)]
                for j in range(k - 2, -1, -1):
                    key = mix(key * _STEP + h[level.place - j])
                dealt = shard.lang[level.place].astype(np.int64) * parts + (key >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64)
                order = np.argsort(dealt, kind="stable")
                place, first = np.unique(dealt[order], return_index=True)
                ends = np.append(first, len(order))
                for x in range(0, len(place), 1 << 12):
                    mine = order[ends[x] : ends[min(x + (1 << 12), len(place))]]
                    cut = pa.array(ends[x : x + (1 << 12) + 1] - ends[x], pa.int32())
                    some = place[x : x + (1 << 12)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((some % parts).astype(np.int32)), langs.take(pa.array(some // parts)), pa.array(np.full(len(some), k, np.int32)),
                            pa.ListArray.from_arrays(cut, shard.phrases(level.place[mine], k)), pa.ListArray.from_arrays(cut, pa.array(level.count[mine].astype(np.int64))),
                        ], names)

    return source.mapInArrow(run, "part int, lang string, k int, phrases array<string>, f array<long>")


def _summed(dealt: DataFrame, least: int) -> DataFrame:
    """(lang, k, phrase, f) of _substrings(), those under `least` left out. A task holds the phrases of one part, language and length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lang, k), rows in _groups(batches, 3):
            sums = pa.table({"phrase": _flat(rows, 3), "f": _flat(rows, 4)}).group_by("phrase").aggregate([("f", "sum")])
            kept = sums.filter(pc.greater_equal(sums["f_sum"], least if k else 0))
            for b in kept.combine_chunks().to_batches():
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.utf8()), pa.array([k] * n, pa.int32()), b.column(b.schema.get_field_index("phrase")), b.column(b.schema.get_field_index("f_sum"))], ["lang", "k", "phrase", "f"])

    return dealt.repartition("part").sortWithinPartitions("part", "lang", "k").mapInArrow(add, "lang string, k int, phrase string, f long")


def counts(df: DataFrame, least: int = 100, most_words: int = 5, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, k, phrase, f) of phrases of one to most_words words that occur `least` times or more, and all words' count as k = 0."""
    source = df.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    parts = _parts(df)
    return _summed(_substrings(source, bloom(_likely(source, least, parts)), most_words, parts), least)


def _exact(*names: str) -> str:
    return " * ".join(f"cast({x} as decimal(19, 0))" for x in names)


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words or more in counts(): the cut of least score, of those the first."""
    words_in = F.split("phrase", " ")
    join = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = found.where("k >= 2").withColumn("w", words_in).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", join(F.lit(1), F.col("cut")).alias("left"), join(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    parts = found.where("k >= 1")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(found.where("k = 0").select("lang", F.col("f").alias("n")), "lang")
    score = F.expr(f"cast((1000 * {_exact('a', 'n')}) div ({_exact('l', 'r')}) as long)")
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def subsumed(found: DataFrame, percent: int = 100) -> DataFrame:
    """(lang, phrase) of phrases in counts() that one a word longer, to the left or right, holds as often.

    With percent = 100 this covers all longer ones: whatever lies between two phrases of equal count has that count, too.
    """
    ends = F.array(F.expr("substring_index(phrase, ' ', 1 - k)"), F.expr("substring_index(phrase, ' ', k - 1)"))
    longer = found.where("k >= 3").select("lang", F.explode(ends).alias("phrase"), F.col("f").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return found.where("k >= 2").join(longer, ["lang", "phrase"]).where(100 * F.col("longer") >= percent * F.col("f")).select("lang", "phrase")


def _first(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def collocations(df: DataFrame, least: int = 100, most_words: int = 5, per_lang: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first per_lang phrases of 2 to most_words words.

    A-Z is lower-cased; `[.,;:!?]` and line breaks part pieces, blanks and tabs words. n: all words of the language,
    a: the phrase's occurrences, overlaps included; l, r: those of both sides of the cut whose floor(1000 * a * n / (l * r))
    is least, of equal ones the first. Phrases under `least` don't count; those that a longer one holds as often go. Order:
    score and a descending, then the phrase's bytes. A null language is `und`; null and empty texts add nothing. A language
    without words or phrases gives no row; nor does an empty table. Repeated rows count each, texts may have any length,
    other columns are not read.
    """
    found = written(counts(df, least, most_words, lang_col, text_col), "phrases")
    kept = scored(found).join(subsumed(found), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = _first(kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), ["lang", "salt"], order, per_lang).drop("salt", "rank")
    return _first(kept, ["lang"], order, per_lang).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
