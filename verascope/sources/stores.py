"""Relational stores, snapshots of small databases, state files, crawl progress: what the indices are read from and kept in.

A relational store is reached by a function that connects (any DB-API driver); without one every read is empty and every
write does nothing, as runs without a store are normal.
"""

from __future__ import annotations

import hashlib
import sqlite3
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from verascope.operators.index import KEYS, VALUES
from verascope.session import written
from verascope.sources.sinks import exists, file_system, remove

PAGE = 500


def snapshot_path(content: bytes, revision: str, folder: str) -> str:
    """A local copy of a database file, named by its revision and content; the same content is written once."""
    path = Path(folder) / f"snapshot-{revision[:12]}-{hashlib.sha256(content).hexdigest()[:16]}.db"
    if not path.exists():
        part = path.with_suffix(f".{uuid.uuid4().hex}")
        part.write_bytes(content)
        part.rename(path)
    return str(path)


def snapshot_query(spark: SparkSession, path: str, sql: str, schema: str, params: tuple = (), most: int = 1_000_000) -> DataFrame:
    """Rows of a query on a snapshot, opened read-only by the driver. For results of at most `most` rows; more are an error."""
    with sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True) as con:
        rows = con.execute(sql, params).fetchmany(most + 1)
    if len(rows) > most:
        raise ValueError(f"over {most} rows: read the table by parts")
    return spark.createDataFrame(rows, schema)


class Relational:
    """A registry of ids, a daily index and counters in a relational store.

    connect: opens a DB-API connection, on the driver and on executors; None: no store. mark: the driver's parameter mark.
    """

    def __init__(self, spark: SparkSession, connect: Callable[[], object] | None, mark: str = "?"):
        self.spark, self.connect, self.mark = spark, connect, mark

    def _rows(self, sql: str, params: tuple = ()) -> list[tuple]:
        if self.connect is None:
            return []
        con = self.connect()
        try:
            cur = con.cursor()
            cur.execute(sql, params)
            return cur.fetchall()
        finally:
            con.close()

    def total(self) -> int:
        """The kept count of all scored documents; 0 without a store."""
        found = self._rows("SELECT value FROM meta WHERE key = 'total_scored_count'")
        return int(found[0][0]) if found else 0

    def known(self, ids: DataFrame, key: str = "doc_id") -> DataFrame:
        """Of the ids (each once, nulls left out) those that the registry has, asked in pages by the executors."""
        connect, mark = self.connect, self.mark
        asked = ids.select(F.col(key).cast("string").alias(key)).where(f"{key} <> ''").distinct()
        if connect is None:
            return asked.where("false")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            con = None
            for b in batches:
                values = b.column(0).to_pylist()
                for at in range(0, len(values), PAGE):
                    con = con or connect()
                    page = values[at : at + PAGE]
                    cur = con.cursor()
                    cur.execute(f"SELECT doc_id FROM doc_registry WHERE doc_id IN ({', '.join([mark] * len(page))})", page)
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in cur.fetchall()], pa.string())], [key])
            if con:
                con.close()

        return asked.mapInArrow(run, f"{key} string")

    def read(self, sql: str, schema: str, predicates: tuple[str, ...] = ("1 = 1",)) -> DataFrame:
        """Rows of `sql WHERE predicate`, a task for each predicate, fetched in pages by the executors; none without a store.

        Predicates that part a table, such as ranges of its key, read it side by side; each holds one page at a time.
        """
        connect, given = self.connect, list(predicates)
        if connect is None:
            return self.spark.createDataFrame([], schema)
        kinds = self.spark.createDataFrame([], schema).schema
        arrow = to_arrow_schema(kinds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    con = connect()
                    try:
                        cur = con.cursor()
                        cur.execute(f"{sql} WHERE {given[i]}")
                        while page := cur.fetchmany(PAGE):
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*page, strict=True), arrow, strict=True)], schema=arrow)
                    finally:
                        con.close()

        return self.spark.range(0, len(given), 1, len(given)).mapInArrow(run, kinds)

    def _send(self, rows: DataFrame, statement: Callable[[list], tuple[str, list]], answer: Callable[[list], tuple[str, list]] | None = None) -> DataFrame:
        """Runs a statement for each page of rows on the executors, and gives what an answering query says after it (keys as text)."""
        connect = self.connect

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            con = None
            for b in batches:
                values = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
                for at in range(0, len(values), PAGE):
                    con = con or connect()
                    cur, page = con.cursor(), values[at : at + PAGE]
                    cur.execute(*statement(page))
                    con.commit()
                    if answer:
                        cur.execute(*answer(page))
                        yield pa.RecordBatch.from_arrays([pa.array([str(r[0]) for r in cur.fetchall()], pa.string())], ["key"])
            if con:
                con.close()

        return written(rows.mapInArrow(run, "key string"), "sent")

    def register(self, documents: DataFrame, at: str, key: str = "doc_id", run: str | None = None) -> DataFrame | None:
        """Adds the documents' ids; returns those that this run inserted, None without a store.

        A claim of each id by the run's name decides: of two runs at once one has it, and a task that runs again, or a run that
        failed and is repeated under its name, gets the answer
        that it had before.
        """
        if self.connect is None:
            return None
        mark, run = self.mark, run or uuid.uuid4().hex
        asked = documents.select(F.col(key).cast("string").alias(key)).where(f"{key} <> ''").distinct()
        asked = asked.join(self.known(asked, key), key, "left_anti")
        claim = lambda page: (f"INSERT INTO registrations (doc_id, run) VALUES {', '.join([f'({mark}, {mark})'] * len(page))} ON CONFLICT (doc_id) DO NOTHING", [x for r in page for x in (r[0], run)])
        mine = lambda page: (f"SELECT doc_id FROM registrations WHERE run = {mark} AND doc_id IN ({', '.join([mark] * len(page))})", [run, *(r[0] for r in page)])
        fresh = self._send(asked, claim, mine).withColumnRenamed("key", key)
        add = lambda page: (f"INSERT INTO doc_registry (doc_id, scored_at) VALUES {', '.join([f'({mark}, {mark})'] * len(page))} ON CONFLICT (doc_id) DO NOTHING", [x for r in page for x in (r[0], at)])
        self._send(fresh, add)
        return fresh

    def merge_daily(self, delta: DataFrame, batch: str) -> int:
        """Merges a delta (a row a day and group) into daily_index, once for each batch; returns the rows merged.

        Executors put the rows beside the index; one statement merges them, in the transaction that notes the batch. Means are
        weighted by counts, of which a null counts as none; median and deviation are those of the newer batch.
        """
        if self.connect is None:
            return 0
        mark, names = self.mark, (*KEYS, *VALUES)
        rows = delta.select(F.col("date").cast("string").alias("date"), *names[1:])
        one = f"({', '.join([mark] * (len(names) + 1))})"
        stage = lambda page: (f"INSERT INTO daily_staged (batch, {', '.join(names)}) VALUES {', '.join([one] * len(page))} ON CONFLICT (batch, date, source, category) DO NOTHING", [x for r in page for x in (batch, *r)])
        self._send(rows, stage)
        n = "COALESCE(daily_index.n_docs, 0)"
        means = ", ".join(f"{c} = (daily_index.{c} * {n} + EXCLUDED.{c} * EXCLUDED.n_docs) / NULLIF({n} + EXCLUDED.n_docs, 0)" for c in ("mean_score", "pct_below_50", "bot_fraction", "aliveness_index"))
        con = self.connect()
        try:
            cur = con.cursor()
            cur.execute(f"INSERT INTO applied_batches (batch) VALUES ({mark}) ON CONFLICT (batch) DO NOTHING", (batch,))
            merged = 0
            if cur.rowcount > 0:
                cur.execute(f"SELECT count(*) FROM daily_staged WHERE batch = {mark}", (batch,))
                merged = int(cur.fetchone()[0])
                cur.execute(
                    f"INSERT INTO daily_index ({', '.join(names)}) SELECT {', '.join(names)} FROM daily_staged WHERE batch = {mark} ON CONFLICT (date, source, category) DO UPDATE SET "
                    f"n_docs = {n} + EXCLUDED.n_docs, {means}, median_score = EXCLUDED.median_score, std_score = EXCLUDED.std_score",
                    (batch,),
                )
            cur.execute(f"DELETE FROM daily_staged WHERE batch = {mark}", (batch,))
            con.commit()
            return merged
        finally:
            con.close()

    def count_again(self) -> int:
        """The kept count set to the registry's own; 0 without a store."""
        if self.connect is None:
            return 0
        con = self.connect()
        try:
            cur = con.cursor()
            cur.execute("SELECT count(*) FROM doc_registry")
            n = int(cur.fetchone()[0])
            cur.execute(f"INSERT INTO meta (key, value) VALUES ('total_scored_count', {self.mark}) ON CONFLICT (key) DO UPDATE SET value = EXCLUDED.value", (str(n),))
            con.commit()
            return n
        finally:
            con.close()


_DAILY = "date TEXT, source TEXT, category TEXT, n_docs BIGINT, mean_score DOUBLE PRECISION, median_score DOUBLE PRECISION, std_score DOUBLE PRECISION, pct_below_50 DOUBLE PRECISION, bot_fraction DOUBLE PRECISION, aliveness_index DOUBLE PRECISION"
#: The tables that Relational works on: the store's own, and those that claims and deltas pass through.
TABLES = (
    "CREATE TABLE IF NOT EXISTS doc_registry (doc_id TEXT PRIMARY KEY, scored_at TEXT)",
    "CREATE TABLE IF NOT EXISTS meta (key TEXT PRIMARY KEY, value TEXT)",
    "CREATE TABLE IF NOT EXISTS applied_batches (batch TEXT PRIMARY KEY)",
    f"CREATE TABLE IF NOT EXISTS daily_index ({_DAILY}, PRIMARY KEY (date, source, category))",
    "CREATE TABLE IF NOT EXISTS registrations (doc_id TEXT PRIMARY KEY, run TEXT)",
    f"CREATE TABLE IF NOT EXISTS daily_staged (batch TEXT, {_DAILY}, PRIMARY KEY (batch, date, source, category))",
)


def restore(spark: SparkSession, origin: str, root: str, names: tuple[str, ...]) -> list[str]:
    """Copies the named state files that origin has to root, over what is there; returns their names. Missing ones have no prior state."""
    conf = spark._jsc.hadoopConfiguration()
    found = [n for n in names if exists(spark, f"{origin}/{n}")]
    for n in found:
        (a, p), (b, q) = file_system(spark, f"{origin}/{n}"), file_system(spark, f"{root}/{n}")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, conf)
    return found


class Progress:
    """Which ids of a long crawl are done: an empty file each, left when the id's data is there, so that a restart goes on behind it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def done(self) -> set[str]:
        fs, p = file_system(self.spark, self.path)
        return {f.getPath().getName() for f in fs.listStatus(p)} if fs.exists(p) else set()

    def finish(self, name: str) -> None:
        fs, p = file_system(self.spark, f"{self.path}/{name}")
        fs.mkdirs(p.getParent())
        fs.create(p, True).close()

    def remaining(self, names: list[str]) -> list[str]:
        """Of the names, in order, those not done; once all are, everything begins anew."""
        done = self.done()
        left = [n for n in names if n not in done]
        if not left and names:
            remove(self.spark, self.path)
            return list(names)
        return left
