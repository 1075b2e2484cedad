"""Helpers of the training-data operators: shared storage, column selection, held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verascope.session import reachable, spread, written

__all__ = ["SPACE_CLASS", "fold", "row_key", "table", "written"]

#: A word of the contracts: a run without ASCII white space. bytes.split() cuts the same way.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def row_key(id_col: str, text_col: str) -> Column:
    """A row's id and its text's digest: rows that share an id but not a text stay apart. Null texts are as empty ones."""
    return F.struct(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("digest"))
