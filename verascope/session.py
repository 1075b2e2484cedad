"""Session defaults shared by scripts, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(
    app: str = "verascope",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
    **conf: str,
) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; other settings stay the cluster's."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its files give fewer: costly expressions then use them all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    On one machine, where that is unset, a temporary folder serves. Elsewhere an unset folder is an error: other machines
    would not see what one wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="verascope-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str, release: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, is computed once, outlives executors.

    release: files that were shuffled for it go when it is written, not when the driver happens to collect garbage.
    """
    path, conf = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(RELEASE, None)
    if release:
        conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            conf.unset(RELEASE) if before is None else conf.set(RELEASE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(spark: SparkSession) -> SparkSession:
    """spark, with this package's folder on the path of Python workers that start from now on, one numeric thread in each, and
    Arrow batches of a few MB.

    The path serves machines which see the folder; elsewhere ship the package with --py-files. Without a limit in bytes a
    batch holds ten thousand texts, tens of MB in the JVM and as much in the worker. What is set already stays.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    # tasks share the cores already; more threads only wait for one another on small matrices
    env.setdefault("OMP_NUM_THREADS", "1")
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in known:
        env["PYTHONPATH"] = ":".join([root, *known])
    return spark
