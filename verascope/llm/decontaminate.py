"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over token positions ignore some of them, so a passage keeps most of its hashes when words are
replaced. Hashes of the benchmark's items and of the documents are joined; every hit gives a diagonal along
which the document's region and the item are compared token by token. The best run of matches, a mismatch
costing as much as a match gains, decides.

Short items have masks of their own: as many parts as leave one free of every allowed mismatch, so none is missed;
an item of five tokens or fewer is one part and must occur whole. Items of equal tokens are compared once. A Bloom
filter of fixed size, made of all benchmark hashes, keeps documents without a hit on their executor. The arrays of a
pair are cut to the stretch that both cover before they leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verascope.llm.common import row_key, written
from verascope.llm.tokens import WORDLIKE, mix, portions, words

#: Token positions that count; all others up to the last are ignored. Whatever steady step from four on words are replaced at, one
#: mask fits between them.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 7, 8), (0, 2, 3, 6, 9, 10), (0, 1, 2, 4, 5, 6))
SPAN = 11
#: Items of fewer tokens are sought by masks of neighbouring positions as well, one for each part.
SHORT = 15
FILTER_BITS = 1 << 26
#: Benchmark hashes that are broadcast at most (about 24 bytes each); beyond, the join shuffles.
BROADCAST_SEEDS = 1_000_000
#: Tokens of all items that are broadcast at most (4 bytes each); beyond, the join shuffles.
BROADCAST_TOKENS = 4_000_000
_GENERAL_PUNCTUATION = re.compile("[ -¿ -⁯　-〿]+")
#: Letters of scripts that put no spaces between words: each is a token. Thai to Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
_FACTORS = [np.uint64(pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64) | 1) for i in range(8)]


def _normal(text: str | None) -> bytes:
    text = (text or "").lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", _GENERAL_PUNCTUATION.sub(" ", text))
    return text.encode()


def _need(n: int, min_matches: int = 12) -> int:
    """Equal tokens that an item of n tokens needs: all of up to five, all but a fifth of more, min_matches at most."""
    return n if n <= 5 else min(min_matches, -(-4 * n // 5))


def _short_parts(n: int, min_matches: int = 12) -> list[tuple[int, int]]:
    """(position, length) of the parts of a short item: one more than the mismatches it may have, five tokens at most each."""
    parts = max(n - _need(n, min_matches) + 1, -(-n // 5))
    ends = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _hashes(hashes: np.ndarray, text_of: np.ndarray, number: int, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a mask fits inside one text, and the hashes there."""
    span = mask[-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.full(n, np.uint64(number), np.uint64)
    for k, offset in enumerate(mask):
        total += hashes[offset : offset + n] * _FACTORS[k]
    at = np.flatnonzero(text_of[:n] == text_of[span - 1 : span - 1 + n])
    return at, mix(total[at])


def _run_mask(length: int) -> tuple[int, tuple[int, ...]]:
    """The mask of `length` neighbouring positions, with its number."""
    return len(MASKS) + length, tuple(range(length))


def _filter_bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item, tokens) of every row: tokens as 32 bits of each word's hash; item: 128 bits that equal tokens share."""
    source = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1):
            found = words([_normal(t) for t in b.column(1).to_pylist()], WORDLIKE)
            lists = pa.ListArray.from_arrays(pa.array(found.first.astype(np.int32)), pa.array(found.hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["item_id", "hashes"])

    rows = source.mapInArrow(run, f"item_id {kind}, hashes array<bigint>").where(F.size("hashes") > 0)
    return rows.withColumn("item", F.unhex(F.md5(F.array_join(F.col("hashes").cast("array<string>"), " ").cast("binary"))))


def seeds(items: DataFrame, min_matches: int = 12) -> DataFrame:
    """(item, h, q): every seed hash of every item (item, hashes), with its position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                hashes = b.column(1)[i].values.to_numpy().view(np.uint64)
                n, one = len(hashes), np.zeros(len(hashes), np.int8)
                found = [_hashes(hashes, one, number, mask) for number, mask in enumerate(MASKS)]
                if n < SHORT:
                    for at, length in _short_parts(n, min_matches):
                        number, mask = _run_mask(length)
                        found.append((np.array([at]), _hashes(hashes[at : at + length], one[:length], number, mask)[1]))
                q, h = (np.concatenate(x) for x in zip(*found, strict=True))
                for lo in range(0, len(q), 100_000):
                    part = slice(lo, lo + 100_000)
                    name = pa.array([b.column(0)[i].as_py()] * len(q[part]))
                    yield pa.RecordBatch.from_arrays([name, pa.array(h[part].view(np.int64)), pa.array(q[part].astype(np.int32))], ["item", "h", "q"])

    return items.select("item", "hashes").mapInArrow(run, "item binary, h bigint, q int")


def _bloom(seeds: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Set 64-bit words of the filter: FILTER_BITS / 8 bytes at most, whatever the benchmark's size."""
    bits = FILTER_BITS - 1
    at = F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits).cast("long")), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits).cast("long"))))
    rows = (
        seeds.select(at.alias("b"))
        .groupBy(F.shiftright("b", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
        .toPandas()
    )
    return rows["word"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64).view(np.uint64)


def _regions(docs: DataFrame, bloom: tuple[np.ndarray, np.ndarray], lengths: list[int], reach: int) -> DataFrame:
    """Stretches of documents around hits of the filter: first word, tokens, and hits (hash, position)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    at, bits = bloom
    masks = [*enumerate(MASKS), *map(_run_mask, lengths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(FILTER_BITS // 64, np.uint64)
        table[at] = bits
        table = table.view(np.uint8)
        marked = lambda h: (table[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1).view(bool)
        for b in portions(batches, 1, 500_000):
            if not len(at):
                continue
            found = words([_normal(t) for t in b.column(1).to_pylist()], WORDLIKE)
            text_of = found.text_of()
            where, hashes = [], []
            for number, mask in masks:
                pos, h = _hashes(found.hashes, text_of, number, mask)
                one, two = _filter_bits(h)
                hit = np.flatnonzero(marked(one))
                hit = hit[marked(two[hit])]
                where.append(pos[hit])
                hashes.append(h[hit])
            if not sum(map(len, where)):
                continue
            where, hashes = np.concatenate(where), np.concatenate(hashes)
            order = np.argsort(where, kind="stable")
            where, hashes = where[order], hashes[order]
            text = text_of[where]
            cuts = np.flatnonzero((np.diff(where) > 2 * reach) | (np.diff(text) != 0)) + 1
            firsts, lasts = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(where)]))
            begin = np.maximum(where[firsts] - reach, found.first[text[firsts]])
            stop = np.minimum(where[lasts - 1] + SPAN + reach, found.first[text[firsts] + 1])
            short = found.hashes.astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(text[firsts])),
                    pa.array((begin - found.first[text[firsts]]).astype(np.int32)),
                    pa.array([short[x:y] for x, y in zip(begin, stop, strict=True)], pa.list_(pa.int32())),
                    pa.array([hashes[x:y].view(np.int64) for x, y in zip(firsts, lasts, strict=True)], pa.list_(pa.int64())),
                    pa.array([(where[x:y] - s).astype(np.int32) for x, y, s in zip(firsts, lasts, begin, strict=True)], pa.list_(pa.int32())),
                ],
                ["doc_id", "begin", "region", "h", "p"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, begin int, region array<int>, h array<bigint>, p array<int>")


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """(matches, first, end) of the stretch in which matches exceed mismatches most; the first of equals."""
    if not len(same):
        return 0, 0, 0
    sums = np.concatenate(([0], np.cumsum(np.where(same, 1, -1))))
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    first = int(np.argmin(sums[: end + 1]))
    return int(same[first:end].sum()), first, end


_VERDICT = "region_id bigint, item binary, n_matches long, n_aligned long, coverage double, at long"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_matches: int = 12,
    min_share: float = 0.7,
    reach: int = 64,
) -> DataFrame:
    """(doc_id, item_id, n_matches, n_aligned, coverage, first_word): a row per document and item found in it.

    Tokens are runs of letters and digits, case ignored; in scripts without spaces each letter is one. A pair counts if the best run holds min_matches equal
    tokens, or all but a fifth of a shorter item, and min_share of its positions are equal; an item of five tokens or
    fewer must occur whole. Null and empty texts, and texts without a token, hold nothing and, as items, are found
    nowhere. Documents that hold no item give no row. Rows that repeat a doc_id count as one, rows that repeat an
    item_id too; the best match of a pair counts, of equal ones that with the least first_word. A null doc_id or item_id
    is an id like others. Texts may have any length: a long one is cut into the stretches around its hits. An empty
    table on either side gives no row. Other columns are not read, so their names may clash.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = written(_items(benchmark, item_col, item_text_col), "items")
    items = named.groupBy("item").agg(F.first("hashes").alias("hashes"))
    keys = seeds(items, min_matches)
    sizes = [r["n"] for r in named.where(F.size("hashes") < SHORT).select(F.size("hashes").alias("n")).distinct().collect()]
    lengths = sorted({length for n in sizes for _, length in _short_parts(n, min_matches)})
    regions = written(_regions(source, _bloom(keys), lengths, reach).withColumn("region_id", F.monotonically_increasing_id()), "regions")
    tokens = items.select("item", F.transform("hashes", lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("t"))
    tokens = tokens.select("item", F.transform("t", lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")).alias("tokens"))
    most = named.agg(F.sum(F.size("hashes"))).first()[0] or 0
    if most * (len(MASKS) + 1) <= BROADCAST_SEEDS:
        keys = F.broadcast(keys)
    if most <= BROADCAST_TOKENS:
        tokens = F.broadcast(tokens)
    hits = regions.select("region_id", F.explode(F.arrays_zip("h", "p")).alias("x")).select("region_id", "x.h", "x.p")
    pairs = hits.join(keys, "h").select("region_id", "item", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
    aligned = pairs.join(regions.select("region_id", "region"), "region_id").join(tokens, "item")
    first = F.greatest(F.lit(0), "diagonal")
    size = F.least(F.size("region"), F.col("diagonal") + F.size("tokens")) - first
    # both sides are cut to what they cover together: neither a long item nor a long region travels whole
    both = aligned.select("region_id", "item", F.size("tokens").alias("n"), first.alias("lo"), F.slice("region", first + 1, size).alias("a"), F.slice("tokens", first - F.col("diagonal") + 1, size).alias("b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            if not f.num_rows:
                continue
            n, lo = f.column(2).to_numpy(), f.column(3).to_numpy()
            same = f.column(4).flatten().to_numpy() == f.column(5).flatten().to_numpy()
            ends = f.column(4).offsets.to_numpy() - f.column(4).offsets[0].as_py()
            runs = [best_run(same[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
            kept = [i for i, (m, x, y) in enumerate(runs) if m >= _need(n[i], min_matches) and m >= min_share * (y - x)]
            if kept:
                m, x, y = np.array([runs[i] for i in kept]).T
                rows = pa.array(kept)
                columns = [f.column(0).take(rows), f.column(1).take(rows), *(pa.array(v) for v in (m, y - x, m / n[kept], lo[kept] + x))]
                yield pa.RecordBatch.from_arrays(columns, ["region_id", "item", "n_matches", "n_aligned", "coverage", "at"])

    out = both.mapInArrow(verify, _VERDICT).join(regions.select("region_id", "doc_id", "begin"), "region_id").join(named.select("item", "item_id"), "item")
    best = F.max(F.struct("n_matches", F.negative(F.col("begin") + F.col("at")).alias("x"), "n_aligned", "coverage")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_matches", "b.n_aligned", "b.coverage", F.negative("b.x").alias("first_word"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, in which no item was found; of rows that share an id only those that hold one go."""
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    bad = contaminated(keyed, benchmark, "key", "text", **options).select(F.col("doc_id.id").alias("_id"), F.col("doc_id.digest").alias("_digest")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & (row_key(id_col, text_col)["digest"] == bad["_digest"]), "left_anti")
