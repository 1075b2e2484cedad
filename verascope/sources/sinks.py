"""Writers: bronze batches, silver by source, gold, registry, versioned upserts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verascope.operators.dedup import keep_last


def write_bronze(df: DataFrame, root: str, source: str, collector: str, at: str | None = None) -> None:
    """Append records as JSON lines under root/source with when, whence and by whom they came."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if at is None else F.lit(at)
    df.withColumns({"_ingested_at": stamp, "_source": F.lit(source), "_minion": F.lit(collector)}).write.mode("append").json(f"{root}/{source}")


def stream_bronze(df: DataFrame, root: str, source: str, collector: str, checkpoint: str):
    """A stream of records as JSON lines under root/source, each record once however often the query restarts; returns the query."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    stamped = df.withColumns({"_ingested_at": stamp, "_source": F.lit(source), "_minion": F.lit(collector)})
    return stamped.writeStream.format("json").option("path", f"{root}/{source}").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(df: DataFrame, skipped: Column, failed: Column, name: str = "run") -> tuple[DataFrame, Observation]:
    """df and its counters fetched, processed, skipped and errors, taken while df is computed for something else."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    is_skipped, is_failed = F.coalesce(skipped, F.lit(False)), F.coalesce(failed, F.lit(False))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return df.observe(seen, F.count(F.lit(1)).alias("fetched"), n(~is_skipped & ~is_failed).alias("processed"), n(is_failed).alias("errors"), n(is_skipped & ~is_failed).alias("skipped")), seen


def write_silver(df: DataFrame, root: str, source: str) -> str:
    """One source's documents, overwriting; returns the path."""
    path = f"{root}/{source.replace('/', '_')}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def write_registry(ids: DataFrame, path: str, key: str = "doc_id") -> None:
    """Distinct ids in order: files hold ranges, so that a look-up reads few."""
    ids.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).write.mode("overwrite").parquet(path)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def marks(spark: SparkSession, path: str) -> list[int]:
    """The numbers that mark() has left under path, rising."""
    fs, p = file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def mark(spark: SparkSession, path: str, n: int) -> None:
    """An empty file of that number: it is there or not, so a reader sees the whole step or nothing of it."""
    fs, p = file_system(spark, f"{path}/{n}")
    fs.mkdirs(p.getParent())
    fs.create(p, True).close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small file, whole or not there: written beside its place, then renamed."""
    fs, p = file_system(spark, path)
    _, aside = file_system(spark, f"{path}.writing")
    fs.mkdirs(p.getParent())
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(aside, p):
        raise OSError(f"{path} cannot be put in place")


def read_json(spark: SparkSession, path: str):
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


class Manifests:
    """Numbered descriptions of a table's state under path, one a run; those of runs that were not committed count for nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/_manifest"

    def newest(self, upto: int):
        """The description of the last run up to a number; None before the first."""
        known = [n for n in marks(self.spark, self.path) if n <= upto]
        return read_json(self.spark, f"{self.path}/{known[-1]}") if known else None

    def write(self, run: int, value) -> None:
        write_json(self.spark, f"{self.path}/{run}", value)


class VersionedTable:
    """A Parquet table whose every state is a numbered directory; the newest one whose mark was left afterwards counts.

    States and marks are only added, so a reader, or a run after a crash, always finds a whole state. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame | None:
        """The newest state; None before the first. A state whose mark is there but whose files are gone is an error."""
        done = marks(self.spark, f"{self.path}/_done")
        return self.spark.read.parquet(f"{self.path}/{done[-1]}") if done else None

    def replace(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        n = max(marks(self.spark, f"{self.path}/_done"), default=0) + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{n}")
        mark(self.spark, f"{self.path}/_done", n)
        return self.spark.read.parquet(f"{self.path}/{n}")

    def append_latest(self, new: DataFrame, key: str, order: str) -> DataFrame:
        """Old and new rows, of equal keys the one of largest order; columns that only one side has are null in the other."""
        old = self.read()
        both = new if old is None else old.unionByName(new, allowMissingColumns=True)
        return self.replace(keep_last(both, key, [order]))


class RunStore:
    """Tables that change together, run by run: what a run wrote counts once the run is committed, and not before.

    A table is appended to (each run's rows stay), replaced (the last run's rows are the table), or dated (a run's rows take the
    place of all rows of their dates; other dates' files are not touched). A run that failed left no commit; the next one has
    its number and overwrites what it wrote.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def last(self) -> int:
        """The last committed run; 0 before the first."""
        return max(marks(self.spark, f"{self.path}/_commits"), default=0)

    def write(self, name: str, run: int, df: DataFrame, by: str | None = None) -> DataFrame:
        path = f"{self.path}/{name}/run={run}"
        writer = df.write.mode("overwrite")
        if by:
            # rows of a date come together, those of a large one split over tasks
            writer = df.hint("rebalance", by).write.mode("overwrite").partitionBy(by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def current(self, name: str) -> DataFrame | None:
        """A replaced table; None before the first run. Missing files of a committed run are an error."""
        n = self.last()
        return self.spark.read.parquet(f"{self.path}/{name}/run={n}") if n else None

    def whole(self, name: str) -> DataFrame | None:
        """An appended table, columns that a run did not have being null; None before the first run."""
        n = self.last()
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}").where(F.col("run") <= n).drop("run") if n else None

    def upsert(self, name: str, run: int, df: DataFrame, by: str = "date") -> None:
        """A dated table's rows of the dates in df: a directory for each, and a manifest that says which run has which date."""
        path = f"{self.path}/{name}/run={run}"
        self.write(name, run, df, by)
        fs, p = file_system(self.spark, path)
        written = [f.getPath().getName().split("=", 1)[1] for f in fs.listStatus(p) if f.getPath().getName().startswith(f"{by}=")]
        manifests = Manifests(self.spark, f"{self.path}/{name}")
        old = manifests.newest(run - 1) or {"dates": {}}
        manifests.write(run, {"by": by, "schema": df.schema.json(), "dates": old["dates"] | {d: run for d in written}})

    def dated(self, name: str, run: int | None = None, only: list | None = None) -> DataFrame | None:
        """A dated table as of a run (the last committed one), or its rows of some dates alone; None before the first.

        Only the files of these dates are listed and read.
        """
        run = self.last() if run is None else run
        if not run:
            return None
        found = Manifests(self.spark, f"{self.path}/{name}").newest(run)
        if found is None:
            raise FileNotFoundError(f"PATH_NOT_FOUND: {self.path}/{name} has no manifest up to run {run}")
        wanted = None if only is None else {str(d) for d in only}
        schema, by = StructType.fromJson(json.loads(found["schema"])), found["by"]
        paths = [f"{self.path}/{name}/run={n}/{by}={d}" for d, n in sorted(found["dates"].items()) if wanted is None or d in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths).select(*schema.names)

    def commit(self, run: int, replaced: tuple[str, ...] = (), dated: tuple[str, ...] = ()) -> None:
        """From here on the run counts. What no state but those before the last two needs goes: a reader may still hold the one before."""
        mark(self.spark, f"{self.path}/_commits", run)
        for name in replaced:
            remove(self.spark, f"{self.path}/{name}/run={run - 2}")
        for name in dated:
            manifests = Manifests(self.spark, f"{self.path}/{name}")
            old, now = (manifests.newest(n) or {"dates": {}} for n in (run - 2, run - 1))
            for d, n in old["dates"].items():
                if now["dates"].get(d) != n:
                    remove(self.spark, f"{self.path}/{name}/run={n}/{now['by']}={d}")


def insert_new(existing: DataFrame, rows: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(all rows, rows that were really inserted): of rows, those of a new, non-null key, each key once."""
    fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True), fresh


def slim_registry(documents: DataFrame, registry: DataFrame, now) -> DataFrame:
    """The registry with ids of documents added: when scored, else when ingested, else now."""
    ids = documents.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("scored_at", "ingested_at", F.lit(now))).alias("scored_at"))
    return registry.unionByName(ids.join(registry.select("doc_id"), "doc_id", "left_anti"))
