"""Ordered work on keys of any size: rows dealt by ranges of (key, time), and what crosses a range's border carried over.

A window over a key sorts all its rows in one task. Here a range holds a share of all rows, whatever their keys: a hot
key spans many ranges, each of which is worked on alone, and gives one row to a small scan over ranges that joins them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verascope.session import written

PART = "_part"


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df in a written table with _part, the number of its range of (keys, order): the same for all who read it."""
    return written(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def gap_moments(events: DataFrame, account: str, ts: str) -> DataFrame:
    """(account, n_ts, n_gaps, mu, sd): times, and mean and population deviation of the positive gaps between successive ones.

    Equal times leave no gap, so distinct ones are dealt, with their counts. Accounts without a time have n_ts = 0.
    """
    times = events.where(F.col(ts).isNotNull()).groupBy(account, ts).agg(F.count("*").alias("times"))
    parts = dealt(times, [account], [ts])
    inside = Window.partitionBy(PART, account).orderBy(ts)
    gap = parts.withColumn("gap", (F.col(ts) - F.lag(ts).over(inside)).cast("double"))
    per = gap.groupBy(PART, account).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.sum("times").alias("n_ts"), F.count("gap").alias("n"), F.avg("gap").alias("mu"), (F.var_pop("gap") * F.count("gap")).alias("m2")
    )
    # a row for each range of an account: the gap to the range before is a group of one
    before = Window.partitionBy(account).orderBy(PART)
    border = (F.col("first") - F.lag("last").over(before)).cast("double")
    groups = F.array(F.struct("n_ts", "n", "mu", "m2"), F.struct(F.lit(0).cast("long").alias("n_ts"), F.when(border.isNull(), 0).otherwise(1).cast("long").alias("n"), border.alias("mu"), F.lit(0.0).alias("m2")))
    groups = per.select(account, groups.alias("g")).select(account, F.explode("g").alias("g")).select(account, "g.*")
    total = groups.groupBy(account).agg(F.sum("n_ts").alias("n_ts"), F.sum("n").alias("n_gaps"), F.try_divide(F.sum(F.col("n") * F.col("mu")), F.sum("n")).alias("mean"))
    spread = groups.join(total.select(F.col(account).alias("_a"), "mean"), F.col(account).eqNullSafe(F.col("_a")))
    spread = spread.groupBy(account).agg(F.sum(F.col("m2") + F.col("n") * (F.col("mu") - F.col("mean")) * (F.col("mu") - F.col("mean"))).alias("m2"))
    known = total.join(spread.withColumnRenamed(account, "_a"), F.col(account).eqNullSafe(F.col("_a"))).select(account, "n_ts", "n_gaps", F.col("mean").alias("mu"), F.sqrt(F.try_divide("m2", "n_gaps")).alias("sd"))
    every = events.select(F.col(account).alias("_b")).distinct()
    out = every.join(known, F.col("_b").eqNullSafe(F.col(account)), "left")
    return out.select(F.col("_b").alias(account), F.coalesce("n_ts", F.lit(0)).alias("n_ts"), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), "mu", "sd")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of right's last row at or before left_time in the same key, null if none; of rows of one time the greatest.

    No row pairs are made. Rows of both sides are dealt by ranges; the last right row of each key and range is carried to the
    ranges after it. Null keys are a key. Rows without a time find nothing and are found by none.
    """
    found = F.struct(*[F.col(v) for v in values])
    kind = right.select(found.alias("v")).schema["v"].dataType
    l = left.select(*on, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"), F.lit(None).cast(kind).alias("_v"))
    r = right.where(F.col(right_time).isNotNull()).select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), found.alias("_v"))
    parts = dealt(l.unionByName(r), on, ["_t", "_side"])
    w = Window.partitionBy(PART, *on).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    here = parts.withColumn("_here", F.last(F.when(F.col("_side") == 0, F.col("_v")), ignorenulls=True).over(w)).where("_side = 1")
    ends = parts.groupBy(PART, *on).agg(F.max_by("_v", F.when(F.col("_side") == 0, F.struct("_t", "_v"))).alias("_end"))
    before = Window.partitionBy(*on).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(PART).alias("_p"), *[F.col(c).alias(f"_k_{c}") for c in on], F.last("_end", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")
    same = F.col(PART) == F.col("_p")
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = here.join(carried, same, "left").withColumn("_f", F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_carried")))
    return out.select("_l.*", *[F.col(f"_f.{v}").alias(v) for v in values])
