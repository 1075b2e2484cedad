"""Pairs of similar word sets, all of them, by a prefix-filtered inverted index.

Equal sets are one set with a count, so that copies never become pairs. The words of a set are ordered by rarity in
the whole table: a set that overlaps another one enough must share a word of its short, rare prefix with it. Prefixes are
the index; sets meet there only if their sizes allow the similarity and enough words are left behind the one they share.
What meets is verified on the whole sets. Any order gives the same pairs; rarity makes them cheap to find.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verascope.session import written

#: Words whose place in the order travels to the tasks: the most frequent ones. All others are rare, ordered by hash.
FREQUENT = 1 << 16
#: Words that a prefix has beyond what one shared word needs; so many more must be shared.
MORE = 4
#: Pairs to verify, up to which they travel to the sets; beyond, the sets travel to them.
FEW = 1 << 18


def words_of(text: Column) -> Column:
    """Distinct lower-case words between white space; none for a null."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != ""))


def word_sets(texts: DataFrame, by: str, text: str) -> DataFrame:
    """(by, sid, copies, words): distinct non-empty sets of each group's texts, words as 64-bit hashes."""
    w = texts.select(by, words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    return w.groupBy(by, F.md5(F.array_join(F.array_sort("w"), " ").cast("binary")).alias("sid")).agg(F.count("*").alias("copies"), F.first(F.transform("w", lambda x: F.xxhash64(x))).alias("words"))


def by_rarity(sets: DataFrame, frequent: int = FREQUENT, counted: DataFrame | None = None) -> DataFrame:
    """sets with the words in one order: rare ones first, then the `frequent` most frequent, the most frequent last.

    counted: hashes of words (word) whose counts give the order, if not the sets' own; any order serves.
    """
    counts = (sets.select(F.explode("words").alias("word")) if counted is None else counted).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()  # `frequent` rows at most
    known = np.array(sorted((r["word"], -i) for i, r in enumerate(top)), np.int64).reshape(-1, 2)
    at = [c for c in sets.columns].index("words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(at)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            ends = ends - ends[0]
            rank = np.full(len(flat), -frequent, np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known[:, 0], flat), len(known) - 1)
                hit = known[place, 0] == flat
                rank[hit] = known[place[hit], 1]
            order = np.lexsort((flat, rank, np.repeat(np.arange(b.num_rows), np.diff(ends))))
            ordered = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[order]))
            yield b.set_column(at, b.schema.field(at).name, ordered)

    return sets.mapInArrow(run, sets.schema)


def numbered(sets: DataFrame) -> DataFrame:
    """sets with a number as sid, a quarter of the digest's width; to be written before it is read twice."""
    return sets.withColumn("sid", F.monotonically_increasing_id())


def candidates(sets: DataFrame, by: str, limit: float, more: int = MORE) -> DataFrame:
    """(by, x, y): sets that may have a similarity over limit, each pair once; x is the larger, of equal ones the greater.

    A pair that shares o words or more shares j of them among each set's first n - o + j: one word among short prefixes, but
    more + 1 (or all that it needs, if those are fewer) among prefixes that are `more` words longer, which few other pairs do.
    """
    n = F.size("words")
    # a partner shares floor(limit * n) + 1 words or more
    prefix = F.least(n, n - F.floor(n * limit - 1e-9).cast("int") + more)
    level = F.floor(F.log(n.cast("double")) / -math.log(limit)).cast("int")
    index = sets.select(by, F.col("sid"), n.alias("n"), level.alias("level"), F.posexplode(F.slice("words", 1, prefix)).alias("at", "word"))
    x = index.select(by, "word", F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.explode(F.array("level", F.col("level") - 1)).alias("level"))
    y = index.select(by, "word", "level", F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    smaller = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    overlap = F.floor((F.col("nx") + F.col("ny")) * (limit / (1 + limit)) - 1e-9) + 1
    left = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))
    # up to `more` shared words stand before the one that meets
    met = x.join(y, [by, "word", "level"]).where(smaller & (F.col("ny") > F.col("nx") * limit - 1e-9) & (left + more >= overlap))
    shared = met.groupBy(by, "x", "y").agg(F.count("*").alias("shared"), F.first(overlap).alias("overlap"))
    return shared.where(F.col("shared") >= F.least(F.lit(more + 1), F.col("overlap"))).select(by, "x", "y")


def similar_pairs(sets: DataFrame, by: str, limit: float) -> DataFrame:
    """(by, x, y, copies, similarity): all pairs of different sets over limit; copies: pairs of texts that they stand for."""
    if not 0 < limit < 1:
        raise ValueError("the limit lies between 0 and 1")
    side = lambda s: sets.select(by, F.col("sid").alias(s), F.col("words").alias(f"w{s}"), F.col("copies").alias(f"c{s}"))
    met = written(candidates(sets, by, limit), "set-pairs")
    if met.limit(FEW + 1).count() <= FEW:
        known = met.select(by, F.explode(F.array("x", "y")).alias("sid")).distinct()
        sets = sets.join(F.broadcast(known), [by, "sid"], "left_semi")  # two for each of FEW pairs at most
    both = met.join(side("x"), [by, "x"]).join(side("y"), [by, "y"])
    common = F.size(F.array_intersect("wx", "wy"))
    both = both.withColumn("similarity", common / (F.size("wx") + F.size("wy") - common))
    return both.where(F.col("similarity") > limit).select(by, "x", "y", (F.col("cx") * F.col("cy")).alias("copies"), "similarity")
