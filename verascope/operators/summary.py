"""Summaries: corpus, edit patterns, latest scores, dashboard numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verascope.operators.index import MEDIAN_DIGITS


def corpus_summary(scored: DataFrame, score: str = "aliveness_score") -> DataFrame:
    """(level, key, n_rows, n_scored, mean, median, std, pct_below_50, pct_below_30): all, each source, each category, in one pass.

    Rows are first reduced to one for each source, category and score of MEDIAN_DIGITS decimals, so that what is expanded into
    levels, and what a median holds, doesn't grow with the corpus. The median is that of these scores; all else is exact.
    """
    s = F.col(score).cast("double")
    per = scored.groupBy("source", "category", F.round(s, MEDIAN_DIGITS).alias("x")).agg(
        F.count("*").alias("rows"), F.count(s).alias("k"), F.avg(s).alias("mu"), (F.var_pop(s) * F.count(s)).alias("m2"), F.count(F.when(s < 50, 1)).alias("below_50"), F.count(F.when(s < 30, 1)).alias("below_30")
    )
    n, total = F.sum("k"), F.sum(F.col("k") * F.col("mu"))
    m2 = F.sum(F.col("m2") + F.col("k") * F.col("mu") * F.col("mu")) - total * F.try_divide(total, n)
    share = lambda c: F.try_divide(F.sum(c) * 100.0, n)
    out = per.groupingSets([[], ["source"], ["category"]], "source", "category").agg(
        F.grouping_id().alias("g"), F.sum("rows").alias("n_rows"), n.alias("n_scored"), F.try_divide(total, n).alias("mean"), F.percentile("x", 0.5, F.col("k")).alias("median"),
        F.sqrt(F.try_divide(F.greatest(m2, F.lit(0.0)), F.when(n > 1, n - 1))).alias("std"), share("below_50").alias("pct_below_50"), share("below_30").alias("pct_below_30"),
    )
    return out.select(
        F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "source").otherwise("category").alias("level"),
        F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.col("source")).otherwise(F.col("category")).alias("key"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"), "mean", "median", "std", "pct_below_50", "pct_below_30",
    )


def edit_patterns(edits: DataFrame) -> DataFrame:
    """One row of shares, sizes and editors of edit events; no row for no event.

    Columns read: user, timestamp (ISO, Z), comment, tags, bot, anon, oldlen, newlen.
    """
    flag = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    bot, anon = F.coalesce("bot", F.lit(False)), F.coalesce("anon", F.lit(False))
    tagged = F.coalesce(F.exists("tags", lambda t: F.contains(t, F.lit("mw-"))), F.lit(False))
    comment = F.lower(F.coalesce("comment", F.lit("")))
    hour = F.hour(F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    by_hour = edits.groupBy(hour.alias("h")).count().where("h is not null").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "count")))).alias("hourly_distribution"))
    one = edits.agg(
        F.count("*").alias("total_edits"),
        flag(bot | tagged).alias("bot_edit_ratio"),
        flag(comment.rlike("revert|rv |undid")).alias("revert_ratio"),
        F.avg(F.abs(F.coalesce("newlen", F.lit(0)) - F.coalesce("oldlen", F.lit(0)))).alias("avg_edit_size_bytes"),
        F.countDistinct(F.when(~anon & ~bot & (F.col("user") != ""), F.col("user"))).alias("unique_human_editors"),
        flag(anon).alias("anon_editor_ratio"),
    ).where("total_edits > 0")
    return one.crossJoin(by_hour)  # one row each


def latest_rows(daily: DataFrame) -> DataFrame:
    """All rows of each source's newest scored day."""
    known = daily.where("mean_score is not null")
    newest = known.groupBy("source").agg(F.max("date").alias("date"))
    return known.join(newest, ["source", "date"])


def latest_source_scores(daily: DataFrame) -> DataFrame:
    """(source, category 'all', date, mean_score, n_docs): categories of the newest day weighted by documents."""
    n = F.coalesce("n_docs", F.lit(0))
    return (
        latest_rows(daily)
        .groupBy("source", "date")
        .agg(F.coalesce(F.try_divide(F.sum(F.col("mean_score") * n), F.sum(n)), F.avg("mean_score")).alias("mean_score"), F.sum(n).alias("n_docs"))
        .select("source", F.lit("all").alias("category"), "date", "mean_score", "n_docs")
    )


def latest_by_source(daily: DataFrame) -> DataFrame:
    """One row of each source: the newest day's, the least category's of several."""
    w = Window.partitionBy("source").orderBy(F.desc("date"), "category")
    return daily.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def weekly_index(composite: DataFrame) -> DataFrame:
    return composite.groupBy(F.date_trunc("week", "date").cast("date").alias("week")).agg(F.avg("aliveness_index").alias("aliveness_index"), F.avg("smoothed_index").alias("smoothed_index"), F.sum("n_docs").alias("n_docs"))


def yearly_source_scores(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.year("date").alias("year"), "source").agg(F.avg("mean_score").alias("mean_score"), F.sum("n_docs").alias("n_docs"))


def total_docs(daily: DataFrame) -> DataFrame:
    return daily.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("total_docs"))


def mean_by_source(daily: DataFrame) -> DataFrame:
    return daily.groupBy("source").agg(F.avg("mean_score").alias("mean_score")).orderBy(F.desc("mean_score"), "source")


def top_domains(domains: DataFrame, n: int = 20, on=None) -> DataFrame:
    d = domains if on is None else domains.where(F.col("date") == F.lit(on))
    return d.orderBy(F.desc("n_docs"), "domain", "date").limit(n)


def timeline(composite: DataFrame, as_of, days: int) -> DataFrame:
    """Rows of the last `days` days before as_of."""
    return composite.where(F.col("date") >= F.date_sub(F.lit(as_of), days)).orderBy("date")


def latest_score(composite: DataFrame, default: float | None = 41.3) -> DataFrame:
    """(score) of the newest day; an empty composite gives the default, or no row without one."""
    one = composite.agg(F.max_by("smoothed_index", "date").alias("score"))
    return one.where("score is not null") if default is None else one.select(F.coalesce("score", F.lit(default)).alias("score"))


def upsert_meta(old: DataFrame, new: DataFrame, keep_old: bool = False) -> DataFrame:
    """Key-value rows of both; of equal keys the new value, or the old one if keep_old."""
    first, second = (old, new) if keep_old else (new, old)
    return first.unionByName(second.join(first.select("key"), "key", "left_anti"))


#: What any reader may see; of meta only the rows of public_meta(). All else is for the pipeline.
PUBLIC_TABLES = ("composite_index", "daily_index", "domain_scores", "latest_source_scores", "weekly_index", "yearly_source_scores", "meta")


def public_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Of named tables those that any reader may see, and of meta its public rows."""
    return {n: public_meta(t) if n == "meta" else t for n, t in tables.items() if n in PUBLIC_TABLES}


def positive(scored: DataFrame, score: str = "aliveness_score") -> DataFrame:
    """Rows with a score above zero: the others are not drawn."""
    return scored.where(F.col(score) > 0)


def public_meta(meta: DataFrame, keys: tuple[str, ...] = ("total_scored_count", "last_scored_at", "last_updated_at")) -> DataFrame:
    return meta.where(F.col("key").isin(list(keys)))
