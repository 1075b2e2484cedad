"""Change points as a stream: two cumulative sums a key, kept between batches, that restart on an alarm.

A batch of any size continues where the last one ended, so any cut of a series that keeps its order gives the alarms of the
whole. The series is measured against a reference mean and deviation of its key, as a stream does not know its own future.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that arbitrary state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def alarms(series: DataFrame, reference: DataFrame, key: str, order: str, value: str, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """(key, order, value, kind 'alarm') of whole series: rows at which a sum of (value - mu) / sd passes h; both sums restart.

    reference: key, mu, sd; a deviation that is null or zero counts as one. Rows without a value, or of a key without a
    reference, are left out. A series has a row for each order, so a key's rows fit a task.
    """
    known = _measured(series, reference, key, value).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "deviation", value))).alias("xs"))
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        p, n = F.greatest(F.lit(0.0), a["p"] + x["deviation"] - k), F.greatest(F.lit(0.0), a["n"] - x["deviation"] - k)
        hit = (p > h) | (n > h)
        return F.struct(
            F.when(hit, 0.0).otherwise(p).alias("p"), F.when(hit, 0.0).otherwise(n).alias("n"), F.when(hit, F.array_append(a["at"], a["i"])).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i")
        )

    hits = known.select(key, "xs", F.explode(F.aggregate("xs", start, step, lambda a: a["at"])).alias("i"))
    return hits.select(key, F.get("xs", F.col("i"))[order].alias(order), F.get("xs", F.col("i"))[value].alias(value), F.lit("alarm").alias("kind"))


def _measured(series: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return series.where(F.col(value).isNotNull()).join(reference.select(key, "mu", "sd").where("mu is not null"), key).withColumn("deviation", (F.col(value) - F.col("mu")) / sd).drop("mu", "sd")


class _Sums(StatefulProcessor):
    def __init__(self, names: tuple[str, str, str], kind: str, k: float, h: float):
        self.names, self.kind, self.k, self.h = names, kind, k, h

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", f"last {self.kind}, p double, n double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        by, order, value = self.names
        got = pd.concat(list(rows), ignore_index=True).sort_values([order, "deviation"], kind="stable")
        last, p, n = self.sums.get() if self.sums.exists() else (None, 0.0, 0.0)
        # what is not after the last row that was seen comes too late for the sums
        late = got[order].map(lambda t: last is not None and _plain(t) <= last)
        out = [(key[0], t, v, "late") for t, v in zip(got.loc[late, order], got.loc[late, value], strict=True)]
        for t, x, v in got.loc[~late, [order, "deviation", value]].itertuples(index=False, name=None):
            p, n = max(0.0, p + x - self.k), max(0.0, n - x - self.k)
            if p > self.h or n > self.h:
                p = n = 0.0
                out.append((key[0], t, v, "alarm"))
            last = _plain(t)
        if last is not None:
            self.sums.update((last, p, n))
        yield pd.DataFrame(out, columns=[by, order, value, "kind"])

    def close(self) -> None:
        pass


def _plain(t):
    return t.to_pydatetime() if hasattr(t, "to_pydatetime") else t


def alarm_stream(series: DataFrame, reference: DataFrame, key: str, order: str, value: str, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """alarms() of a streaming series, batch by batch; rows not after the last one of their key are given as kind 'late'.

    The state is a row a key. Give it a checkpoint: a restart goes on behind the last committed batch.
    """
    spark = series.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    types = {c: series.schema[c].dataType.simpleString() for c in (key, order, value)}
    processor = _Sums((key, order, value), types[order], k, h)
    schema = ", ".join(f"{c} {t}" for c, t in types.items()) + ", kind string"
    return _measured(series, reference, key, value).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "None")
