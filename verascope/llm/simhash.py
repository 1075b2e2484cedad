"""SimHash near-dedup: distinct fingerprints compared exactly, tile by tile.

Fingerprints are dealt into tiles by population counts: of the whole, and of `parts` equal parts of the bits.
A differing bit changes one part's count by one, so fingerprints within the radius lie in tiles whose counts
differ by the radius at most, summed over the parts; all other tile pairs are skipped. Each fingerprint stays
in its own tile and visits the later tiles in reach; there numpy takes exclusive-or and bit counts of
blocks. A tile pair reports a spanning forest of its links, so large groups give few edges. A tile of more than
TILE_ROWS fingerprints is dealt over several tasks by hash, which all its visitors visit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verascope.llm.common import row_key, written
from verascope.llm.graph import components

SEED, BITS = 42, 64
#: Fingerprints of a block: bounds the matrix of a comparison.
BLOCK = 1024
#: Fingerprints that one task holds of a tile, and parts that a tile may be dealt over.
TILE_ROWS, MOST_SPLITS = 1 << 16, 1 << 15
#: Fingerprints from which on tiles are cut by eight parts of the bits instead of four: more, smaller tiles, more visits.
FINE = 20_000_000


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The SimHash of a text: A-Z lower-cased, ASCII white space between words, one vote of each shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= words_per_shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest, k = xxhash.xxh64_intdigest, words_per_shingle - 1
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k].tolist(), ends[k:].tolist(), strict=True)]
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed 64-bit integer; null and wordless texts have zero."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1)
            fps = np.array([fingerprint(text[i].as_py(), words_per_shingle) for i in range(b.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _tile(fp: Column, parts: int) -> Column:
    """Population counts of the parts, a byte each: numbers of neighbouring tiles differ by fixed steps."""
    width, key = BITS // parts, F.lit(0).cast("long")
    for i in range(parts):
        part = F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else -1).cast("long"))
        key = key + (F.bit_count(part).cast("long") + 8) * (64**i)
    return key


def _steps(parts: int, radius: int) -> list[int]:
    """Differences of tile numbers within the radius, one of each mirrored pair; zero first."""
    near = [v for v in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, v)) <= radius]
    return sorted(s for v in near if (s := sum(x * 64**i for i, x in enumerate(v))) >= 0)


class _Forest:
    """Union-find that keeps the edges which joined something."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[x] = y
            self.kept.append((a, b))


def _compare(left: np.ndarray, right: np.ndarray, radius: int, same: bool, forest: _Forest) -> None:
    for i in range(0, len(left), BLOCK):
        a = left[i : i + BLOCK]
        for j in range(i if same else 0, len(right), BLOCK):
            b = right[j : j + BLOCK]
            close = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            rows, cols = np.nonzero(np.triu(close, 1) if same and i == j else close)
            for x, y in zip(a[rows].tolist(), b[cols].tolist(), strict=True):
                forest.link(x, y)


def links(distinct: DataFrame, radius: int = 2, parts: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (u, v) among distinct fingerprints (fp) that connect all pairs within the radius, transitively."""
    own = distinct.select("fp", _tile(F.col("fp"), parts).alias("own"))
    # one row for each TILE_ROWS fingerprints at most
    crowded = own.groupBy(F.col("own").alias("tile")).count().where(F.col("count") > tile_rows)
    crowded = crowded.select("tile", F.least(F.ceil(F.col("count") / tile_rows), F.lit(MOST_SPLITS)).alias("splits"))
    reached = own.withColumn("step", F.explode(F.array(*[F.lit(s).cast("long") for s in _steps(parts, radius)]))).withColumn("tile", F.col("own") + F.col("step"))
    splits = F.coalesce("splits", F.lit(1))
    home = F.pmod(F.xxhash64("fp"), splits)
    # at home it meets the parts before its own as a visitor
    last = F.when(F.col("step") == 0, home).otherwise(splits - 1)
    dealt = (
        reached.join(F.broadcast(crowded), "tile", "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .select((F.col("tile") * MOST_SPLITS + F.col("part")).alias("tile"), ((F.col("step") != 0) | (F.col("part") != home)).alias("visits"), "fp")
        .repartition("tile")
        .sortWithinPartitions("tile", "visits")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        forest, tile = _Forest(), None
        residents: list[np.ndarray] = []
        home = np.empty(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            tiles = batch.column(0).to_numpy()
            visits = batch.column(1).to_numpy(zero_copy_only=False)
            fps = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((tiles[1:] != tiles[:-1]) | (visits[1:] != visits[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tiles)], strict=True):
                if tiles[a] != tile:
                    tile, residents, home = tiles[a], [], np.empty(0, np.uint64)
                if not visits[a]:
                    new = fps[a:b]
                    for old in residents:
                        _compare(old, new, radius, False, forest)
                    if len(new) > 1:
                        _compare(new, new, radius, True, forest)
                    residents.append(new)
                    home = np.concatenate(residents)
                elif len(home):
                    _compare(fps[a:b], home, radius, False, forest)
            if len(forest.kept) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*forest.kept, strict=True)], schema=schema)
                forest = _Forest()
        if forest.kept:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*forest.kept, strict=True)], schema=schema)

    return dealt.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, parts: int | None = None, words_per_shingle: int = 3
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    fingerprint: 16 lower-case hex digits. component_id: the least doc_id that links of radius or fewer differing
    bits reach, its own included. Wordless texts share the fingerprint zero and link like any other. A null doc_id
    never becomes a component_id unless its component has no other. Repeated rows stay. Texts may have any length. parts:
    of the bits that tiles are cut by (a divisor of 64; by the number of fingerprints unless given); no result depends on
    it. Other columns are not read, so their names may clash. An empty table gives none.
    """
    marked = written(fingerprints(df, id_col, text_col, words_per_shingle), "simhash")
    firsts = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    parts = parts or (4 if firsts.count() < FINE else 8)
    found = components(links(firsts.select("fp"), radius, parts))
    tagged = firsts.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = tagged.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = tagged.select("fp", "component").join(least, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """The rows of df, with all their columns, of each linked group those of the least id.

    Rows are judged one by one: one that shares its id with another text goes only if its own group has a lesser id. Rows that
    repeat id and group stay together. Rows of a null id stay. Null and wordless texts are one group.
    """
    marked = df.select(F.when(F.col(id_col).isNotNull(), row_key(id_col, text_col)).alias("key"), F.col(text_col).alias("text"))
    found = near_duplicates(marked, "key", "text", radius).where(F.col("doc_id.id") != F.col("component_id.id"))
    gone = found.select(F.col("doc_id.id").alias("_id"), F.col("doc_id.digest").alias("_digest")).distinct()
    same = (df[id_col] == gone["_id"]) & (row_key(id_col, text_col)["digest"] == gone["_digest"])
    return df.join(gone, same, "left_anti")
