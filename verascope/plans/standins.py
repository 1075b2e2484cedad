"""Inputs of the catalogue's queries, made of the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verascope.operators.index import daily_index
from verascope.session import reachable, spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = reachable(spark).read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def silver(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "source",
        F.col("lang").alias("category"),
        F.concat("source", F.lit(".example")).alias("domain"),
        "text",
        F.length("text").cast("long").alias("text_length"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("date"),
        F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"),
        F.col("doc_id").alias("ord"),
        "n_chars",
    )


def scored(spark: SparkSession, sf: str, nulls: bool = True) -> DataFrame:
    score = (F.col("n_chars") % 1000) / F.lit(10.0)
    return silver(spark, sf).withColumn("aliveness_score", F.when(F.col("ord") % 17 != 0, score) if nulls else score)


def daily(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rows = e.select(F.to_date("ts").alias("date"), F.col("event_type").alias("source"), F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string")).alias("category"), F.least("value", F.lit(100.0)).alias("aliveness_score"))
    return daily_index(rows)


def series(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice") / 10000, 8).alias("aliveness_index"), F.count("*").alias("n_docs"))


def activity(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("account"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("value").alias("score"), "event_id")


SILVER = """silver AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, lang AS category, source || '.example' AS domain, text, CAST(length(text) AS BIGINT) AS text_length,
  CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS date, substr(sha256(text), 1, 16) AS content_hash, doc_id AS ord, n_chars FROM documents)"""
SCORED = SILVER + ", scored AS (SELECT *, CASE WHEN ord % 17 <> 0 THEN CAST(n_chars % 1000 AS DOUBLE) / 10.0 END AS aliveness_score FROM silver)"


def daily_sql(rows: str) -> str:
    return f"""SELECT date, source, category, count(*) AS n_docs, avg(aliveness_score) AS mean_score, quantile_cont(aliveness_score, 0.5) AS median_score, stddev_samp(aliveness_score) AS std_score,
  100.0 * count(CASE WHEN aliveness_score < 50 THEN 1 END) / count(aliveness_score) AS pct_below_50, CAST(0 AS DOUBLE) AS bot_fraction, avg(aliveness_score) AS aliveness_index
  FROM {rows} WHERE date IS NOT NULL AND source IS NOT NULL AND category IS NOT NULL GROUP BY date, source, category HAVING count(aliveness_score) > 0"""


DAILY = (
    "ev AS (SELECT CAST(ts AS DATE) AS date, event_type AS source, 'c' || CAST(user_id % 2 AS VARCHAR) AS category, least(value, 100.0) AS aliveness_score FROM events), daily AS (" + daily_sql("ev") + ")"
)
SERIES = "series AS (SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice) / 10000, 8) AS aliveness_index, count(*) AS n_docs FROM orders GROUP BY 1)"
ACTIVITY = "activity AS (SELECT user_id AS account, epoch_us(ts) / 1e6 AS ts, value AS score, event_id FROM events)"
TOKENS = r"""tok AS (SELECT doc_id, text, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{2,}')) AS t FROM documents)"""
