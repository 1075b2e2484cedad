"""Rows of a query and of its SQL, made comparable."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return plain(v.item())
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


def rows(df: pd.DataFrame):
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df[names].itertuples(index=False, name=None)), key=repr)
