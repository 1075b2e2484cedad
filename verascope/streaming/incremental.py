"""The incremental path as a stream: new files become scored rows once, and merge into the daily index.

Late documents of any past day are welcome and merge into that day, so the index path has no watermark; batches
are applied once by number: a batch that runs again finds its version written and leaves it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verascope.operators.index import daily_of_state, daily_state, merge_states
from verascope.session import shared_dir
from verascope.sources.segments import SegmentRegistry
from verascope.sources.sinks import RunStore

class DailyIndexSink:
    """The daily index and the known ids under one path, renewed batch by batch.

    A batch reads and writes only the days of its own new rows, looks its ids up through the registry's filters, and counts
    once its commit is made. The state behind the index merges exactly, so any cut of the stream into batches gives the
    same medians and deviations.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.store, self.known = RunStore(spark, self.path), SegmentRegistry(spark, f"{path.rstrip('/')}/registry", key)

    def read(self, part: str = "daily") -> DataFrame | None:
        """The `daily` index, or the `registry` of all ids; None before the first batch. Files that are gone are an error."""
        if part == "registry":
            return self.known.read(self.store.last())
        state = self.store.dated("state")
        return None if state is None else daily_of_state(state)

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Merge what is new in a batch of scored rows: key, date, source, category, aliveness_score."""
        last, run = self.store.last(), number + 1
        if run <= last:
            return
        fresh = batch.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        rows = self.store.write("rows", run, self.known.unseen(fresh, last))
        days = [r["date"] for r in rows.select("date").distinct().collect()]  # a row a day
        new, old = daily_state(rows), self.store.dated("state", only=days)
        self.store.upsert("state", run, new if old is None else merge_states(old, new).select(*new.columns))
        self.known.add(rows.select(self.key), run)
        self.store.commit(run, ("rows",), ("state",))


def run_available(source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that a streaming source has now, in batches, and stop."""
    source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def distinct_stream(source: DataFrame, key: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """A stream without repeated keys; with a time column, keys are forgotten once they are later than `late`."""
    if time is None:
        return source.dropDuplicates([key])
    return source.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def live_counts(source: DataFrame, time: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts in tumbling windows of event time, for monitoring: state is bounded by the watermark."""
    return source.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), by).agg(F.count("*").alias("n"))


def events_by_batches(spark: SparkSession, sf: str, files: int = 4) -> DataFrame:
    """The daily index of events, read as a stream of files in several batches. It equals that of one batch."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(
        F.col("event_id").cast("string").alias("doc_id"), F.to_date("ts").alias("date"), F.col("event_type").alias("source"), F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string")).alias("category"),
        F.least("value", F.lit(100.0)).alias("aliveness_score"),
    )
    rows.repartition(files, "doc_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    sink = DailyIndexSink(spark, f"{root}/index")
    run_available(stream, sink, f"{root}/progress")
    shown = [F.round(c, 8).alias(c) for c in ("mean_score", "median_score", "std_score", "pct_below_50")]
    return sink.read().select("date", "source", "category", "n_docs", *shown)
