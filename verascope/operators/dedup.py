"""Dedup, anti- and semi-joins, top-k: the incremental protocol on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verascope.functions.scalars import either


def keep_first(df: DataFrame, order: list[str], within: tuple[str, ...] = ("source",), hash_col: str = "content_hash", id_col: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """The first row of each content hash (of the id where the hash is empty) within a source, by `order`.

    The aggregate keeps the least order of each key before the shuffle, so a hot key costs a row per task. It carries whole
    rows, whatever is read of them later; where few of their columns are wanted, name them.
    """
    columns = df.columns if columns is None else columns
    d = df.withColumn("_key", either(F.col(hash_col), F.col(id_col)))
    rest = [c for c in columns if c not in within]
    best = d.groupBy(*within, "_key").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*within, "_r.*").select(*columns)


def keep_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*").select(*df.columns)


def new_rows(df: DataFrame, *known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is in none of `known`. A null key is never known."""
    ids = None
    for k in known:
        one = k.select(key)
        ids = one if ids is None else ids.unionByName(one)
    return df if ids is None else df.join(ids.distinct(), key, "left_anti")


def inserted(df: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def newest(df: DataFrame, n: int, time: str = "created_dt", tie: str = "doc_id") -> DataFrame:
    """The n newest rows, those without a time last."""
    return df.orderBy(F.col(time).desc_nulls_last(), tie).limit(n)


def head_per_group(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same rows and seed: those whose key, with the seed, has the least MD5."""
    drawn = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return df.orderBy(drawn, key).limit(n)


def frontier(configured: DataFrame, existing: DataFrame, done: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Up to n ids to do next: configured ones that exist, in their order (rank), then newer ones, newest first, less those done."""
    first = configured.join(existing.select(key), key, "left_semi").select(key, F.col("rank").cast("long").alias("_r"))
    top = configured.agg(F.max(key).alias("_top"))
    more = existing.select(key).distinct().crossJoin(F.broadcast(top)).where(F.col("_top").isNull() | (F.col(key) > F.col("_top"))).select(key, F.lit(None).cast("long").alias("_r"))  # top is one row
    # each task keeps the n it would give, so the newer ids need no numbers
    return first.unionByName(more).join(done.select(key), key, "left_anti").orderBy(F.col("_r").asc_nulls_last(), F.desc(key)).limit(n).select(key)
