"""LM scoring: a gated recurrent model over words, and a unigram base from counts of the whole corpus.

Word counts come from all learnable documents; words travel as 64-bit hashes. The most frequent words form the recurrent
model's vocabulary; a larger, still bounded set of frequent words travels to the executors, and all rarer words meet their
counts in a join. The recurrent model is trained on all learnable documents, once each, split into shards: each shard
trains from the same weights, the shards' weights are averaged, and this repeats. A word outside the vocabulary has the
model's probability of such a word times its share among them in the base.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verascope.llm import gru
from verascope.llm.common import written
from verascope.llm.tokens import NOT_SPACE, Words, gathered, portions, words

#: Stands for the end of a text among the hashes.
END = np.uint64(0x2545F4914F6CDD1D)
#: Upper bits of a hash by which frequent words are found.
SLOT_BITS = 20
SHIFT = np.uint64(64 - SLOT_BITS)
#: Bytes of text that are scored at a time.
SIDE_BY_SIDE = 10_000_000


@dataclass(frozen=True)
class Settings:
    """Sizes of the model, of the frequent words on executors, and of training.

    Every learnable document trains the recurrent model, in one of the rounds; a shard has about shard_tokens.
    """

    vocabulary: int = 2046
    frequent: int = 1 << 17
    embedding: int = 16
    hidden: int = 24
    shard_tokens: int = 2_400_000
    rounds: int = 2
    rate: float = 0.01
    #: Words that a counting task holds before it passes their counts on.
    held_words: int = 4_000_000
    chunk: int = 4096


def _words(column: pa.Array) -> Words:
    """The words of texts, A-Z lower-cased; the ends are left out."""
    return words([(t or "").encode().lower() for t in column.to_pylist()], NOT_SPACE)


def count_words(texts: DataFrame, held: int) -> DataFrame:
    """(word, c) over all rows of texts (text); the word END stands for the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = ends = 0

        def rows() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate([*parts, np.empty(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.append(h, END).view(np.int64)), pa.array(np.append(n, ends))], ["word", "n"])

        for b in portions(batches, 0):
            parts.append(_words(b.column(0)).hashes)
            size, ends = size + len(parts[-1]), ends + b.num_rows
            if size > held:
                yield rows()
                parts.clear()
                size = ends = 0
        yield rows()

    return texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")


@dataclass
class Model:
    """What an executor needs: hashes of frequent words in order with their counts and places by frequency, totals, and the recurrent weights."""

    hashes: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    ends: int
    total: int
    distinct: int
    shape: gru.Shape
    weights: gru.Weights
    slots: np.ndarray | None = None
    crowded: np.ndarray | None = None

    @property
    def scale(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def base(self, c: int) -> float:
        return math.log10((c + 0.5) / self.scale)

    def other_mass(self) -> float:
        """The base's probability of all words outside the vocabulary."""
        inside = self.counts[self.places < self.shape.vocabulary]
        return max(1 - (float(inside.sum()) + self.ends + 0.5 * (len(inside) + 1)) / self.scale, 0.5 / self.scale)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where the words are among the frequent ones; len(hashes) for all others."""
        n = len(self.hashes)
        if not n:
            return np.zeros(len(h), np.int64)
        if self.slots is None:
            # by the upper bits of a hash: one of the words that have them, and whether there are more
            upper = (self.hashes >> SHIFT).astype(np.int64)
            self.slots, self.crowded = np.full(1 << SLOT_BITS, -1, np.int32), np.bincount(upper, minlength=1 << SLOT_BITS) > 1
            self.slots[upper] = np.arange(n)
        upper = (h >> SHIFT).astype(np.int64)
        at = self.slots[upper]
        hit = self.hashes[at] == h
        at[~hit] = n
        more = np.flatnonzero(~hit & self.crowded[upper])
        near = np.minimum(np.searchsorted(self.hashes, h[more]), n - 1)
        at[more] = np.where(self.hashes[near] == h[more], near, n)
        return at


def _with_ends(ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The ids of each text, with the end after each."""
    n = len(first) - 1
    out = np.full(len(ids) + n, gru.END, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(first))] = ids
    ends = first + np.arange(n + 1)
    return [out[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def _vocabulary_ids(model: Model) -> np.ndarray:
    """The recurrent model's id of each frequent word; the last is that of all others."""
    return np.append(np.where(model.places < model.shape.vocabulary, model.places + 2, gru.OTHER), gru.OTHER).astype(np.int32)


def _hash_long(x: np.ndarray) -> np.ndarray:
    """Spark's hash of 64-bit integers, by which it deals rows to partitions."""
    rotated = lambda v, n: v << np.uint32(n) | v >> np.uint32(32 - n)
    h = np.full(len(x), 42, np.uint32)
    for part in (x & 0xFFFFFFFF, x >> 32):
        k = part.astype(np.uint32) * np.uint32(0xCC9E2D51)
        h = rotated(h ^ rotated(k, 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def partition_keys(n: int) -> np.ndarray:
    """For each of n partitions the least whole number that is dealt to it."""
    m = 32 * n
    while True:
        place, first = np.unique(_hash_long(np.arange(m)).astype(np.int64) % n, return_index=True)
        if len(place) == n:
            return first
        m *= 2


def _trained(texts: DataFrame, model: Model, s: Settings, shards: int) -> gru.Weights:
    """One round: every shard of texts (shard, at, text) trains from model.weights; the mean of what they reach, weighted by tokens, by chunk.

    A shard takes its texts in order of at, then of their ids, and sums run over shards in order: how rows are dealt changes nothing.
    """
    weights, shape, ids = model.weights, model.shape, _vocabulary_ids(model)
    find = Model(model.hashes, model.counts, model.places, 0, 0, 0, shape, {}).find

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = partition_keys(shards)
        for b in portions(batches, 2):
            found = _words(b.column(2))
            lists = _with_ends(ids[find(found.hashes)], found.first)
            # each shard by the number that Spark deals to a partition of its own
            yield pa.RecordBatch.from_arrays([pa.array(keys[b.column(0).to_numpy()]), b.column(1), pa.array([x.astype("<i4" if shape.tokens > 1 << 15 else "<i2").tobytes() for x in lists], pa.binary())], ["shard", "at", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        held, done, now, shard = 0, 0, weights, None

        def learn() -> None:
            nonlocal now, held, done
            now = gru.train(now, shape, docs, s.rate)
            done += held
            docs.clear()
            held = 0

        def reached() -> Iterator[pa.RecordBatch]:
            nonlocal now, done
            if docs:
                learn()
            if done:
                flat = gru.packed(now).astype(np.float64) * done
                parts = [flat[i : i + s.chunk] for i in range(0, len(flat), s.chunk)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([done] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64()))], ["shard", "k", "n", "x"]
                )
            now, done = weights, 0

        for b in batches:
            for of, x in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if of != shard:
                    yield from reached()
                    shard = of
                docs.append(np.frombuffer(x.as_py(), "<i4" if shape.tokens > 1 << 15 else "<i2").astype(np.int32))
                held += len(docs[-1])
                if held > 2 * s.shard_tokens:
                    learn()
        yield from reached()

    listed = texts.select("shard", "at", "text").mapInArrow(to_ids, "shard bigint, at bigint, ids binary")
    sums = listed.repartition(shards, "shard").sortWithinPartitions("shard", "at", "ids").mapInArrow(run, "shard bigint, k int, n bigint, x array<double>")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for k, n, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                before = held.get(k, (0, 0.0))
                held[k] = before[0] + n, before[1] + x.values.to_numpy()
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([x for _, x in held.values()], pa.list_(pa.float64()))], ["k", "n", "x"]
            )

    # a task holds one sum for each of its chunks, however many shards there are; the model's size reaches the driver
    one = sums.repartition("k").sortWithinPartitions("k", "shard").mapInArrow(add, "k int, n bigint, x array<double>")
    rows = sorted(one.collect(), key=lambda r: r["k"])
    if not rows:
        return weights
    return gru.unpacked(np.concatenate([np.asarray(r["x"]) for r in rows]) / rows[0]["n"], weights)


def _frequent(table: DataFrame, most: int) -> list:
    """The rows of the most frequent words, `most` at most: all above a count, found from a histogram of its logarithm."""
    level = F.floor(F.log2("c") * 64)
    sizes = sorted(((r["k"], r["n"]) for r in table.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for k, n in sizes:
        total += n
        if total > most:
            break
        least = k
    return table.where(level >= least).collect() if least is not None else []


def train(df: DataFrame, learnable: Column, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the table (word, c) of all learnable words."""
    texts = df.where(learnable).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).cast("string").alias("id"))
    table = written(count_words(texts.select("text"), s.held_words), "words")
    totals = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    end = int(END.view(np.int64))
    top = _frequent(table.where(F.col("word") != end), s.frequent)
    hashes, counts = np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], np.int64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    places = np.empty(len(hashes), np.int64)
    places[np.lexsort((hashes, -counts))] = np.arange(len(hashes))
    ends = table.where(F.col("word") == end).first()
    ends = ends["c"] if ends else 0
    shape = gru.Shape(min(s.vocabulary, len(hashes)), s.embedding, s.hidden)
    inside = np.empty(shape.vocabulary)
    inside[places[places < shape.vocabulary]] = counts[places < shape.vocabulary]
    weights = gru.initial(shape, np.array([ends, totals["n"] - ends - inside.sum(), *inside], np.float64))
    model = Model(hashes, counts, places, ends, totals["n"], totals["v"], shape, weights)
    if totals["n"]:
        shards = max(1, round(totals["n"] / s.shard_tokens / s.rounds))
        drawn = F.xxhash64("id", "text", F.lit(41))
        for k in range(s.rounds):
            mine = texts.where(F.pmod(drawn, F.lit(s.rounds)) == k)
            model.weights = _trained(mine.select(F.pmod(F.xxhash64("id", "text", F.lit(43)), F.lit(shards)).alias("shard"), drawn.alias("at"), "text"), model, s, shards)
    return model, table


_ROW = "uid binary, word bigint, n bigint, is_doc boolean, {id}, n_tokens bigint, known bigint, base double, score double, others bigint"


def score(df: DataFrame, model: Model, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities.

    Null and empty texts hold the end only. Words seen in no learnable document have count zero. Repeated rows and ids stay
    apart, a null doc_id too. Texts may have any length; the state runs through the whole of each. Words of one count are
    ordered by hash where the vocabulary ends. Other columns are not read, so their names may clash. An empty table gives
    none; nothing learnable leaves one unknown word as the whole base.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = _ROW.format(id=f"doc_id {kind}")
    shape, weights, scale, n_frequent = model.shape, model.weights, model.scale, len(model.hashes)
    ids, find = _vocabulary_ids(model), Model(model.hashes, model.counts, model.places, 0, 0, 0, shape, {}).find
    end_base, end_known = model.base(model.ends), int(model.ends > 0)
    # words that are not here have the last place, where nothing is added
    log_of = np.append(np.log10((model.counts + 0.5) / scale), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of few long texts leave the others waiting, so many texts are scored side by side
        for b in gathered(batches, 1, SIDE_BY_SIDE):
            found = _words(b.column(1))
            size, of = b.num_rows, found.text_of()
            at = find(found.hashes)
            token = ids[at]
            logs = gru.log_probabilities(weights, shape, _with_ends(token, found.first))
            sums = lambda x: np.bincount(of, x, size)  # noqa: E731, B023
            here, other, one = at < n_frequent, token == gru.OTHER, log_of[at]
            base, known, others, outside = sums(one) + end_base, sums(here) + end_known, sums(other), sums(one * other)
            # rare words by text: equal neighbours once sorted are one row
            rare, rare_of = found.hashes[~here], of[~here]
            order = np.lexsort((rare, rare_of))
            rare, rare_of = rare[order], rare_of[order]
            new = np.ones(len(rare), bool)
            new[1:] = (rare[1:] != rare[:-1]) | (rare_of[1:] != rare_of[:-1])
            starts = np.flatnonzero(new)
            # a document's number is made of its id and text, so that a task that runs again gives the same; copies share it
            uids = [xxhash.xxh3_128_digest(f"{i!r}\0{t or ''}".encode("utf-8", "replace")) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            dealt_by = np.frombuffer(b"".join(uids), np.int64)[::2]
            uids = pa.array(uids, pa.binary())
            # a document's own row is dealt by its number; it counts no word
            yield pa.RecordBatch.from_arrays(
                [
                    uids, pa.array(dealt_by), pa.array(np.zeros(size, np.int64)), pa.array([True] * size), b.column(0),
                    pa.array(np.diff(found.first) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(logs / math.log(10) + outside), pa.array(others.astype(np.int64)),
                ], names)
            if m := len(starts):
                nulls = [pa.nulls(m, t) for t in (b.column(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                times = np.diff(np.append(starts, len(rare)))
                yield pa.RecordBatch.from_arrays([uids.take(pa.array(rare_of[starts])), pa.array(rare[starts].view(np.int64)), pa.array(times), pa.array([False] * m), *nulls], names)

    names = [part.split()[0] for part in schema.split(", ")]
    rows = source.mapInArrow(run, schema).join(table, "word", "left")
    rare_log = F.when(F.col("is_doc"), 0.0).otherwise(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(scale)))
    per = rows.groupBy("uid").agg(
        F.sum(F.col("is_doc").cast("long")).alias("copies"),
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("known").alias("known"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.max("base").alias("base"),
        F.max("score").alias("score"),
        F.max("others").alias("others"),
        F.sum(rare_log).alias("rare"),
    )
    # rows of one id and text come as one, with the sums of all of them
    per = per.withColumn("rare", F.col("rare") / F.col("copies")).withColumn("n_known", F.expr("known + rare_known div copies"))
    return per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare")).alias("base_score"),
        (F.col("score") + F.col("rare") - F.col("others") * F.lit(math.log10(model.other_mass()))).alias("score"),
    )
