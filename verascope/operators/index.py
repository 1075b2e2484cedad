"""Daily, domain and composite indices, and their incremental merges.

Rows of scored documents are reduced by partial aggregation on (date, source, category); the median is that of scores of
two decimals, so its state is bounded. The composite has one row a day: its windows run in one task by design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the sources in the composite; others have DEFAULT_WEIGHT.
SOURCE_WEIGHTS = {
    "common_crawl": 0.30, "reddit": 0.15, "news": 0.10, "wikipedia": 0.10, "wayback": 0.08, "hackernews": 0.06, "bluesky": 0.05, "youtube": 0.05,
    "fourchan": 0.04, "steam": 0.03, "mastodon": 0.03, "stackoverflow": 0.03, "linkedin": 0.02, "github": 0.02,
}
DEFAULT_WEIGHT = 0.1
KEYS = ("date", "source", "category")
VALUES = ("n_docs", "mean_score", "median_score", "std_score", "pct_below_50", "bot_fraction", "aliveness_index")


def _digits(c: Column, n: int | None) -> Column:
    return c if n is None else F.round(c, n)


#: Decimals of the scores that the median sees: a group's state holds one count for each, 10,001 at most.
MEDIAN_DIGITS = 2


def daily_index(scored: DataFrame, score_col: str = "aliveness_score", digits: int | None = None) -> DataFrame:
    """(date, source, category) -> counts and moments. Counts include unscored rows; keys with a null and groups without a score are left out."""
    s = F.col(score_col)
    known = scored.where(" and ".join(f"{k} is not null" for k in KEYS))
    out = known.groupBy(*KEYS).agg(
        F.count("*").alias("n_docs"),
        F.avg(s).alias("mean_score"),
        F.median(F.round(s, MEDIAN_DIGITS)).alias("median_score"),
        F.stddev_samp(s).alias("std_score"),
        (F.avg(F.when(s < 50, 1.0).when(s.isNotNull(), 0.0)) * 100).alias("pct_below_50"),
        F.count(s).alias("_scored"),
    )
    out = out.where("_scored > 0").drop("_scored").withColumn("bot_fraction", F.lit(0.0)).withColumn("aliveness_index", F.col("mean_score"))
    if digits is not None:
        out = out.withColumns({c: F.round(c, digits) for c in ("mean_score", "median_score", "std_score", "aliveness_index")} | {"pct_below_50": F.round("pct_below_50", 2)})
    return out.select(*KEYS, *VALUES)


#: Columns of a daily state: what merges exactly in any order. m2: squared deviations from the mean; histogram: how often
#: each score of MEDIAN_DIGITS decimals occurs, 10,001 entries at most for scores from 0 to 100.
STATE = ("n_docs", "n_scored", "mean", "m2", "below_50", "histogram")


def daily_state(scored: DataFrame, score_col: str = "aliveness_score") -> DataFrame:
    """(date, source, category) -> STATE. Rows without a score count in n_docs alone; keys with a null are left out."""
    s = F.col(score_col).cast("double")
    known = scored.where(" and ".join(f"{k} is not null" for k in KEYS))
    per = known.groupBy(*KEYS, F.round(s, MEDIAN_DIGITS).alias("score")).agg(
        F.count("*").alias("n"), F.count(s).alias("k"), F.avg(s).alias("mu"), (F.var_pop(s) * F.count(s)).alias("m2"), F.count(F.when(s < 50, 1)).alias("below")
    )
    some = F.when(F.col("k") > 0, F.struct("score", "k", "mu", "m2"))
    out = per.groupBy(*KEYS).agg(
        F.sum("n").alias("n_docs"), F.sum("k").alias("n_scored"), F.try_divide(F.sum(F.col("k") * F.col("mu")), F.sum("k")).alias("mean"), F.sum("below").alias("below_50"), F.array_sort(F.collect_list(some)).alias("parts")
    )
    m2 = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["m2"] + x["k"] * (x["mu"] - F.col("mean")) * (x["mu"] - F.col("mean")))
    histogram = F.map_from_entries(F.transform("parts", lambda x: F.struct(x["score"], x["k"])))
    return out.select(*KEYS, "n_docs", "n_scored", "mean", m2.alias("m2"), "below_50", histogram.alias("histogram"))


def merge_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both states' rows, those of one key as if their documents had come together."""
    a, b = old.select(*KEYS, F.struct(*STATE).alias("a")), new.select(*KEYS, F.struct(*STATE).alias("b"))
    both = a.join(b, list(KEYS), "full")
    zero = F.lit(0).cast("long")
    count = lambda c: F.coalesce(F.col(f"a.{c}"), zero) + F.coalesce(F.col(f"b.{c}"), zero)
    na, nb = F.coalesce("a.n_scored", zero), F.coalesce("b.n_scored", zero)
    ma, mb = F.coalesce("a.mean", "b.mean"), F.coalesce("b.mean", "a.mean")
    # weighted from one side, not summed, so that a side without scores leaves the other's mean as it is
    mean = ma + (mb - ma) * F.try_divide(nb, na + nb)
    m2 = F.coalesce("a.m2", F.lit(0.0)) + F.coalesce("b.m2", F.lit(0.0)) + F.coalesce((mb - ma) * (mb - ma) * F.try_divide(na.cast("double") * nb, na + nb), F.lit(0.0))
    none = F.create_map().cast("map<double,bigint>")
    histogram = F.map_zip_with(F.coalesce("a.histogram", none), F.coalesce("b.histogram", none), lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))
    return both.select(*KEYS, count("n_docs").alias("n_docs"), count("n_scored").alias("n_scored"), mean.alias("mean"), m2.alias("m2"), count("below_50").alias("below_50"), histogram.alias("histogram"))


def _median(histogram: Column, n: Column) -> Column:
    """The middle score, or the mean of both middle ones."""
    low, high = F.expr("(n_scored - 1) div 2"), F.expr("n_scored div 2")
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def step(a: Column, e: Column) -> Column:
        seen = a["seen"] + e["value"]
        return F.struct(seen.alias("seen"), F.when(a["x"].isNull() & (seen > low), e["key"]).otherwise(a["x"]).alias("x"), F.when(a["y"].isNull() & (seen > high), e["key"]).otherwise(a["y"]).alias("y"))

    return F.aggregate(F.array_sort(F.map_entries(histogram)), start, step, lambda a: (a["x"] + a["y"]) / 2)


def daily_of_state(state: DataFrame, digits: int | None = None) -> DataFrame:
    """The daily index of a state: what daily_index() gives for all its documents at once."""
    n = F.col("n_scored")
    out = state.where("n_scored > 0").select(
        *KEYS,
        "n_docs",
        _digits(F.col("mean"), digits).alias("mean_score"),
        _digits(_median(F.col("histogram"), n), digits).alias("median_score"),
        _digits(F.sqrt(F.try_divide("m2", F.when(n > 1, n - 1))), digits).alias("std_score"),
        _digits(100.0 * F.col("below_50") / n, None if digits is None else 2).alias("pct_below_50"),
        F.lit(0.0).alias("bot_fraction"),
        _digits(F.col("mean"), digits).alias("aliveness_index"),
    )
    return out.select(*KEYS, *VALUES)


def domain_index(scored: DataFrame, order_col: str, score_col: str = "aliveness_score", digits: int | None = None) -> DataFrame:
    """(date, domain) -> category of the first row by order_col, mean score, rows."""
    out = scored.where("date is not null and domain is not null").groupBy("date", "domain").agg(
        F.min_by("category", order_col).alias("category"), _digits(F.avg(score_col), digits).alias("mean_score"), F.count("*").alias("n_docs")
    )
    return out.where("mean_score is not null")


def merge_delta(old: DataFrame, new: DataFrame, digits: int | None = None) -> DataFrame:
    """Daily rows of both: means weighted by counts, counts added, median and deviation those of the newer batch.

    The rule of the data that this reproduces; merge_states() is exact instead.
    """
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    n = F.coalesce("n_docs", F.lit(0))
    weighted = lambda c: _digits(F.try_divide(F.sum(F.col(c) * n), F.sum(F.when(F.col(c).isNotNull(), n))), digits).alias(c)
    newest = lambda c: F.max_by(c, "_batch").alias(c)
    return both.groupBy(*KEYS).agg(
        F.sum(n).alias("n_docs"), weighted("mean_score"), newest("median_score"), newest("std_score"), weighted("pct_below_50"), weighted("bot_fraction"), weighted("aliveness_index")
    ).select(*KEYS, *VALUES)


def merge_domain_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return both.groupBy("date", "domain").agg(
        F.max_by("category", "_batch").alias("category"), F.try_divide(F.sum(F.col("mean_score") * F.col("n_docs")), F.sum("n_docs")).alias("mean_score"), F.sum("n_docs").alias("n_docs")
    )


def replace_rows(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def replace_dates(old: DataFrame, new: DataFrame) -> DataFrame:
    """old without any date that new touches, and new."""
    return old.join(new.select("date").distinct(), "date", "left_anti").select(*old.columns).unionByName(new)


def weight_of(source: Column, weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT) -> Column:
    out = None
    for name, w in (SOURCE_WEIGHTS if weights is None else weights).items():
        out = F.when(source == name, w) if out is None else out.when(source == name, w)
    return F.lit(default) if out is None else out.otherwise(default)


def composite(daily: DataFrame, weights: dict[str, float] | None = None, min_docs: int = 10) -> DataFrame:
    """(date, aliveness_index, n_docs): each daily row counts with its source's weight; days of few documents are left out."""
    w = weight_of(F.col("source"), weights)
    return (
        daily.groupBy("date")
        .agg(F.coalesce(F.try_divide(F.sum(F.col("mean_score") * w), F.sum(w)), F.lit(50.0)).alias("aliveness_index"), F.sum("n_docs").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )


def centred(width: int) -> tuple[int, int]:
    """Rows before and after of a centred frame; an even width has one more before."""
    return -(width // 2), (width - 1) // 2


def smoothed(series: DataFrame, value: str = "aliveness_index", width: int = 21, order: str = "date", out: str = "smoothed_index") -> DataFrame:
    return series.withColumn(out, F.avg(value).over(Window.orderBy(order).rowsBetween(*centred(width))))


def trailing_z(value: str, order: str, width: int, least: int) -> Column:
    """Deviation from the trailing mean in sample deviations; null below `least` values."""
    w = Window.orderBy(order).rowsBetween(-(width - 1), 0)
    return F.when(F.count(value).over(w) >= least, (F.col(value) - F.avg(value).over(w)) / (F.stddev_samp(value).over(w) + 1e-9))


def with_anomalies(series: DataFrame, value: str = "aliveness_index", width: int = 30, least: int = 7, limit: float = 2.5) -> DataFrame:
    """series with z_score, anomaly_flag and anomaly_reason: spike, drop or empty."""
    df = series.withColumn("z_score", trailing_z(value, "date", width, least))
    z = F.coalesce("z_score", F.lit(0.0))
    return df.withColumns({"anomaly_flag": (F.abs(z) > limit).cast("int"), "anomaly_reason": F.when(z > limit, "spike").when(z < -limit, "drop").otherwise("")})


def composite_index(daily: DataFrame, width: int = 21, min_docs: int = 10, limit: float = 2.5) -> DataFrame:
    return with_anomalies(smoothed(composite(daily, min_docs=min_docs), width=width), limit=limit)
