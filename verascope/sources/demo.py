"""A synthetic daily index: a logistic decline with a weekly wave and a few events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The decline's ends, the events as (day, change), and the sources with their offsets.
START, HIGH, LOW, DAYS = "2024-01-01", 78.0, 41.0, 854
EVENTS = ((180, -8.0), (320, -6.0), (450, 5.0), (550, -10.0), (700, 3.0))
SOURCES = {"common_crawl": -2.0, "reddit": 1.0, "news": 3.0, "wikipedia": 5.0}


def demo_timeline(spark: SparkSession, days: int = DAYS, noise: Column | None = None, seed: int = 42) -> DataFrame:
    """(date, source, mean_score) within 10 to 95. noise: a column of deviations; by default normal ones of the seed."""
    t = F.col("id").cast("double")
    wave = HIGH - (HIGH - LOW) / (1 + F.exp(-8 * (t / days - 0.5))) + 1.5 * F.sin(2 * 3.141592653589793 * t / 7)
    for day, change in EVENTS:
        wave = wave + change * F.greatest(F.lit(0.0), 1 - F.abs(t - day) / 7)
    offset = F.create_map(*[F.lit(x) for s, o in SOURCES.items() for x in (s, o)])
    d = spark.range(days).withColumn("source", F.explode(F.array(*map(F.lit, SOURCES))))
    value = wave + offset[F.col("source")] + (F.randn(seed) * 1.5 if noise is None else noise)
    return d.select(F.date_add(F.lit(START).cast("date"), F.col("id").cast("int")).alias("date"), "source", F.greatest(F.lit(10.0), F.least(F.lit(95.0), value)).alias("mean_score"))
