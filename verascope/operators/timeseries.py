"""Ordered series of one value a day: change points, anomalies, slopes, trends.

A series is an aggregate (a row a day), so its windows and its fold run in one task whatever the corpus' size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verascope.operators.index import trailing_z


def anomaly_width(rows: int) -> int:
    return min(30, max(7, rows // 5))


def cusum(series: DataFrame, value: str, order: str = "date", k: float = 0.5, h: float = 4.0) -> DataFrame:
    """Rows (order, value) at which a two-sided cumulative sum of normalised values passes h; both sums then restart.

    Nulls are left out. A fold over the ordered array: the restart is beyond window functions.
    """
    rows = series.where(F.col(value).isNotNull())
    norm = F.struct(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x")))).alias("xs"))
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        p, n = F.greatest(F.lit(0.0), a["p"] + x - k), F.greatest(F.lit(0.0), a["n"] - x - k)
        alarm = (p > h) | (n > h)
        return F.struct(
            F.when(alarm, 0.0).otherwise(p).alias("p"), F.when(alarm, 0.0).otherwise(n).alias("n"), F.when(alarm, F.array_append(a["at"], a["i"])).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i")
        )

    one = rows.agg(norm.alias("s")).where("s.mu is not null")
    sd = F.when(F.col("s.sd") > 0, F.col("s.sd")).otherwise(1.0)
    normal = F.transform("s.xs", lambda e: (e["x"] - F.col("s.mu")) / sd)
    hits = one.select("s.xs", F.aggregate(normal, start, step, lambda a: a["at"]).alias("at"))
    return hits.select(F.explode(F.transform("at", lambda i: F.get("xs", i))).alias("e")).select(F.col("e.o").alias(order), F.col("e.x").alias(value))


def label_anomalies(series: DataFrame, value: str = "aliveness_index", order: str = "date", limit: float = 2.5) -> DataFrame:
    """series with z_score (3 decimals), anomaly_type, is_anomaly and cusum_flag; the frame's width follows the row count."""
    width = anomaly_width(series.count())
    z = trailing_z(value, order, width, 3)
    df = series.withColumn("_z", z)
    kind = F.when(F.col("_z") > limit, "spike").when(F.col("_z") < -limit, "drop").otherwise("")
    alarms = cusum(series, value, order).select(F.col(order).alias("_at"))
    df = df.join(alarms, df[order] == F.col("_at"), "left")
    return df.withColumns({"z_score": F.round("_z", 3), "anomaly_type": kind, "is_anomaly": kind != "", "cusum_flag": F.col("_at").isNotNull()}).drop("_z", "_at")


def rolling_zscore(series: DataFrame, value: str, order: str = "date", width: int = 30, limit: float = 2.5) -> DataFrame:
    return series.withColumn("is_outlier", F.coalesce(F.abs(trailing_z(value, order, width, 5)) > limit, F.lit(False)))


def notable_anomalies(labelled: DataFrame, n: int = 10, value: str = "aliveness_index", order: str = "date") -> DataFrame:
    """The n anomalies of largest |z|; all that tie with the last."""
    ranked = labelled.where("is_anomaly").withColumn("_r", F.rank().over(Window.orderBy(F.desc(F.abs("z_score")))))
    return ranked.where(F.col("_r") <= n).select(order, F.col(value).alias("score"), "z_score", F.col("anomaly_type").alias("type"))


def decay_rate(value: str, width: int, order: str = "date") -> Column:
    """Least-squares slope per row over the last `width` rows; null until the frame is full of values."""
    w = Window.orderBy(order)
    frame = w.rowsBetween(-(width - 1), 0)
    return F.when(F.count(value).over(frame) == width, F.regr_slope(F.col(value), F.col("_row")).over(frame))


def trend(slope: Column, limit: float = 0.05) -> Column:
    return F.when(slope.isNull(), "unknown").when(F.abs(slope) < limit, "stable").when(slope < -0.3, "crash").when(slope < 0, "declining").otherwise("recovering")


def synthetic_estimate(index: Column) -> Column:
    """(pct, low, high): 100 less the index, and 1.96 deviations around it within 0 to 100."""
    point = 100 - index
    sd = 5 + 10 * (1 - F.abs(index - 50) / 50)
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    return F.struct(F.round(point, 1).alias("pct"), F.round(clip(point - 1.96 * sd), 1).alias("low"), F.round(clip(point + 1.96 * sd), 1).alias("high"))


def enrich_timeline(series: DataFrame, value: str = "aliveness_index", order: str = "date", digits: int | None = 4) -> DataFrame:
    df = series.withColumn("_row", F.row_number().over(Window.orderBy(order)).cast("double"))
    for days in (90, 30):
        slope = decay_rate(value, days, order)
        df = df.withColumn(f"decay_rate_{days}d", F.round(slope, digits) if digits is not None else slope)
    s = synthetic_estimate(F.col(value))
    df = df.withColumns({"trend": trend(F.col("decay_rate_30d")), "_s": s})
    return df.withColumns({"synthetic_pct": F.col("_s.pct"), "synthetic_low": F.col("_s.low"), "synthetic_high": F.col("_s.high")}).drop("_s", "_row")


def platform_trends(daily: DataFrame, sources: list[str], since, width: int = 7, value: str = "mean_score") -> DataFrame:
    """Trailing mean of each chosen source since a day."""
    w = Window.partitionBy("source").orderBy("date").rowsBetween(-(width - 1), 0)
    return daily.where(F.col("source").isin(sources) & (F.col("date") >= F.lit(since))).withColumn("smoothed", F.avg(value).over(w))


def as_of(series: DataFrame, value: str, days: int, order: str = "date") -> DataFrame:
    """(as_of, value): the last row at least `days` before the newest; no row if there is none."""
    newest = series.agg(F.max(order).alias("_last"))
    old = series.crossJoin(F.broadcast(newest)).where(F.col(order) <= F.date_sub("_last", days))  # one row
    return old.agg(F.max(order).alias("as_of"), F.max_by(value, order).alias(value)).where("as_of is not null")
