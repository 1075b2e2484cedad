"""Queries that write and read back: bronze, silver, registries, versions, relational stores, progress; and the dashboard's remaining rows."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verascope.functions import scalars
from verascope.operators import index, summary, timeseries
from verascope.plans.standins import DAILY, SCORED, SERIES, daily, daily_sql, scored, series, silver, table
from verascope.session import shared_dir
from verascope.sources import bronze, segments, sinks, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_RECORDS = "SELECT CAST(doc_id AS VARCHAR) AS id, text, source AS title, 'tester' AS collector, 'stackoverflow' AS stamped FROM documents"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("question_id"), "text", F.col("source").alias("title"))


def _read_back(spark: SparkSession, root: str) -> DataFrame:
    lines = bronze.read_bronze(spark, root, "stackoverflow")
    raw = spark.read.option("recursiveFileLookup", "true").json(f"{root}/stackoverflow").select(F.col("question_id").alias("id"), F.col("_minion").alias("collector"), F.col("_source").alias("stamped"))
    return lines.select(F.col("raw.question_id").cast("string").alias("id"), "raw.text", "raw.title").join(raw, "id")


@query("bronze_append", _RECORDS)
def _bronze(spark: SparkSession, sf: str) -> DataFrame:
    root, d = _place(spark, "bronze"), _records(spark, sf)
    late = F.crc32(F.col("question_id").cast("binary")) % 2 == 1
    for batch in (d.where(~late), d.where(late)):
        sinks.write_bronze(batch, root, "stackoverflow", "tester")
    return _read_back(spark, root)


@query("bronze_stream", _RECORDS)
def _bronze_stream(spark: SparkSession, sf: str) -> DataFrame:
    root, place, d = _place(spark, "bronze"), _place(spark, "stream"), _records(spark, sf)
    d.write.parquet(f"{place}/in")
    # the second run finds all done
    for _ in range(2):
        stream = spark.readStream.schema(d.schema).parquet(f"{place}/in")
        sinks.stream_bronze(stream, root, "stackoverflow", "tester", f"{place}/progress").awaitTermination()
    return _read_back(spark, root)


@query("silver_by_source", "SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE source IS NOT NULL GROUP BY source")
def _silver(spark: SparkSession, sf: str) -> DataFrame:
    root, d = _place(spark, "silver"), silver(spark, sf).where("source is not null")
    # a source is a file of configuration, so there are few; the first is written twice
    names = sorted(r["source"] for r in d.select("source").distinct().collect())
    for s in names[:1] + names:
        sinks.write_silver(d.where(F.col("source") == s), root, s)
    return spark.read.parquet(f"{root}/*.parquet").groupBy("source").agg(F.count("*").alias("n"), F.sum("text_length").alias("chars"))


@query("registry_sorted", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE doc_id % 3 = 0)")
def _registry(spark: SparkSession, sf: str) -> DataFrame:
    path, d = _place(spark, "registry"), silver(spark, sf).where("ord % 3 = 0")
    sinks.write_registry(d.unionByName(d), path)
    # files hold ranges: the order of files and of rows in them is that of the ids
    found = bronze.read_registry(spark, path).withColumns({"f": F.col("_metadata.file_name"), "k": F.monotonically_increasing_id()})
    return found.selectExpr("doc_id", "cast(row_number() over (order by f, k) as bigint) as place")


@query("registry_migration", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 2020 WHEN doc_id % 2 = 0 THEN 2021 ELSE 2022 END AS year FROM documents")
def _migration(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda y: F.lit(f"{y}-06-01").cast("timestamp")
    d = silver(spark, sf).select("doc_id", "ord")
    known = d.where("ord % 3 = 0").select("doc_id", at(2020).alias("scored_at"))
    found = d.unionByName(d).select("doc_id", F.when(F.col("ord") % 2 == 0, at(2021)).alias("scored_at"), at(2022).alias("ingested_at"))
    import datetime

    return sinks.slim_registry(found, known, datetime.datetime(2030, 1, 1)).select("doc_id", F.year("scored_at").cast("int").alias("year"))


@query("gold_versions", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM documents WHERE doc_id % 5 <> 4 OR doc_id % 2 = 0")
def _versions(spark: SparkSession, sf: str) -> DataFrame:
    t, d = sinks.VersionedTable(spark, _place(spark, "gold")), silver(spark, sf).select("doc_id", "ord")
    t.append_latest(d.where("ord % 5 <> 4").withColumn("version", F.lit(1)), "doc_id", "version")
    t.append_latest(d.where("ord % 2 = 0").withColumn("version", F.lit(2)), "doc_id", "version")
    return t.read().select("doc_id", "version")


@query("composite_rewrite", f"WITH {DAILY}, c AS (SELECT date, CAST(sum(n_docs) AS BIGINT) AS n_docs FROM daily GROUP BY date) SELECT * FROM c")
def _rewrite(spark: SparkSession, sf: str) -> DataFrame:
    t, d = sinks.VersionedTable(spark, _place(spark, "composite")), daily(spark, sf)
    for part in (d.where("date < '2024-01-10'"), d):
        t.replace(part.groupBy("date").agg(F.sum("n_docs").alias("n_docs")))
    return t.read()


@query("run_counters", "SELECT count(*) AS fetched, count(CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN 1 END) AS processed, count(CASE WHEN doc_id % 7 = 0 THEN 1 END) AS errors, count(CASE WHEN doc_id % 5 = 0 AND doc_id % 7 <> 0 THEN 1 END) AS skipped FROM documents")
def _counters(spark: SparkSession, sf: str) -> DataFrame:
    d, seen = sinks.counted(table(spark, sf, "documents").select("doc_id"), F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0)
    d.write.parquet(_place(spark, "counted"))
    names = ("fetched", "processed", "errors", "skipped")
    return spark.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


def _store(spark: SparkSession) -> stores.Relational:
    """A store in a file of its own, which the executors of this machine reach, too."""
    path = f"{_place(spark, 'store').removeprefix('file://')}.db"
    connect = lambda: sqlite3.connect(path, timeout=60)
    con = connect()
    for t in stores.TABLES:
        con.execute(t)
    con.commit()
    con.close()
    return stores.Relational(spark, connect)


@query("store_register", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END AS batch, (SELECT count(DISTINCT doc_id) FROM documents) AS total FROM (SELECT DISTINCT doc_id FROM documents)")
def _register(spark: SparkSession, sf: str) -> DataFrame:
    s, d = _store(spark), silver(spark, sf).select("doc_id", "ord")
    first = s.register(d.where("ord % 4 = 0"), "2024-01-01").withColumn("batch", F.lit(1))
    second = s.register(d.unionByName(d), "2024-01-02").withColumn("batch", F.lit(2))
    s.count_again()
    return first.unionByName(second).withColumn("total", F.lit(s.total()).cast("long"))


@query("store_known", "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 = 0")
def _known(spark: SparkSession, sf: str) -> DataFrame:
    s, d = _store(spark), silver(spark, sf).select("doc_id", "ord")
    s.register(d.where("ord % 4 = 0"), "2024-01-01")
    nothing = stores.Relational(spark, None)
    return s.known(d.where("ord % 3 = 0")).unionByName(nothing.known(d)).where(F.lit(nothing.total() == 0 and nothing.register(d, "now") is None))


_OLD_NEW = f"{SCORED}, old AS ({daily_sql('(SELECT * FROM scored WHERE ord % 3 < 2)')}), new AS ({daily_sql('(SELECT * FROM scored WHERE ord % 3 >= 1)')})"


@query(
    "store_daily_merge",
    f"""WITH {_OLD_NEW}, o AS (SELECT date, source, category, mean_score, CASE WHEN source = 'src1' THEN NULL ELSE n_docs END AS n_docs FROM old)
 SELECT CAST(coalesce(n.date, o.date) AS VARCHAR) AS date, coalesce(n.source, o.source) AS source, coalesce(n.category, o.category) AS category, CAST(CASE WHEN n.date IS NULL THEN o.n_docs ELSE coalesce(o.n_docs, 0) + n.n_docs END AS BIGINT) AS n_docs,
 round(CASE WHEN n.date IS NULL THEN o.mean_score WHEN o.date IS NULL THEN n.mean_score ELSE (o.mean_score * coalesce(o.n_docs, 0) + n.mean_score * n.n_docs) / (coalesce(o.n_docs, 0) + n.n_docs) END, 8) AS mean_score
 FROM o FULL JOIN new n ON n.date = o.date AND n.source = o.source AND n.category = o.category""",
)
def _merge(spark: SparkSession, sf: str) -> DataFrame:
    s, d = _store(spark), scored(spark, sf)
    old = index.daily_index(d.where("ord % 3 < 2")).withColumn("n_docs", F.when(F.col("source") != "src1", F.col("n_docs")))
    s.merge_daily(old, "a")
    # a batch that comes again changes nothing
    for _ in range(2):
        s.merge_daily(index.daily_index(d.where("ord % 3 >= 1")), "b")
    # read by four tasks, each a range of days
    days = ("date < '2024-01-15'", "date >= '2024-01-15' AND date < '2024-02-01'", "date >= '2024-02-01' AND date < '2024-02-15'", "date >= '2024-02-15'")
    rows = s.read("SELECT date, source, category, n_docs, mean_score FROM daily_index", "date string, source string, category string, n_docs bigint, mean_score double", days)
    return rows.withColumn("mean_score", F.round("mean_score", 8))


@query(
    "merge_null_counts",
    f"""WITH {_OLD_NEW}, b AS (SELECT date, source, category, mean_score, CASE WHEN source <> 'src1' THEN n_docs END AS n_docs FROM old UNION ALL SELECT date, source, category, mean_score, n_docs FROM new)
 SELECT date, source, category, CAST(sum(coalesce(n_docs, 0)) AS BIGINT) AS n_docs, round(sum(mean_score * coalesce(n_docs, 0)) / nullif(sum(coalesce(n_docs, 0)), 0), 8) AS mean_score FROM b GROUP BY date, source, category""",
)
def _null_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = scored(spark, sf)
    old = index.daily_index(d.where("ord % 3 < 2")).withColumn("n_docs", F.when(F.col("source") != "src1", F.col("n_docs")))
    return index.merge_delta(old, index.daily_index(d.where("ord % 3 >= 1"))).select("date", "source", "category", "n_docs", F.round("mean_score", 8).alias("mean_score"))


@query("snapshot_query", f"WITH {DAILY} SELECT source, count(*) AS n, CAST(sum(n_docs) AS BIGINT) AS n_docs FROM daily WHERE date >= DATE '2024-01-03' GROUP BY source")
def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """A small database of the daily index, a row a day and group, as a file that is queried as it is."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE d (date TEXT, source TEXT, n_docs BIGINT)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?)", [(str(r[0]), r[1], r[2]) for r in daily(spark, sf).select("date", "source", "n_docs").collect()])
    con.commit()
    folder = shared_dir(spark).removeprefix("file://")
    path = stores.snapshot_path(con.serialize(), "revision-of-the-day", folder)
    assert path == stores.snapshot_path(con.serialize(), "revision-of-the-day", folder)
    return stores.snapshot_query(spark, path, "SELECT source, count(*), sum(n_docs) FROM d WHERE date >= ? GROUP BY source", "source string, n bigint, n_docs bigint", ("2024-01-03",))


_FINISHED = "SELECT source, count(*) % 3 = 0 AS early FROM documents WHERE source IS NOT NULL GROUP BY source"


@query("crawl_progress", f"WITH s AS ({_FINISHED}) SELECT 1 AS step, source AS remaining FROM s UNION ALL SELECT 2, source FROM s WHERE NOT early UNION ALL SELECT 3, source FROM s")
def _progress(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as the ids of a crawl: all, those left after the early ones, and all again once none is left."""
    found = table(spark, sf, "documents").where("source is not null").groupBy("source").agg((F.count("*") % 3 == 0).alias("early")).orderBy("source").collect()
    p, rows = stores.Progress(spark, _place(spark, "progress")), []
    for step, early in ((1, True), (2, False), (3, None)):
        rows += [(step, x) for x in p.remaining([r["source"] for r in found])]
        for r in found:
            if r["early"] == early:
                p.finish(r["source"])
    return spark.createDataFrame(rows, "step int, remaining string")


@query("state_restore", f"WITH {DAILY} SELECT 'daily' AS name, count(*) AS n, CAST(sum(n_docs) AS BIGINT) AS total FROM daily UNION ALL SELECT 'registry', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents")
def _restore(spark: SparkSession, sf: str) -> DataFrame:
    origin, root = _place(spark, "origin"), _place(spark, "root")
    daily(spark, sf).write.parquet(f"{origin}/daily")
    table(spark, sf, "documents").select("doc_id").write.parquet(f"{origin}/registry")
    found = stores.restore(spark, origin, root, ("daily", "composite", "registry"))
    total = {"daily": "n_docs", "registry": "doc_id"}
    parts = [spark.read.parquet(f"{root}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(total[n]).alias("total")) for n in found]
    return parts[0].unionByName(parts[1])


@query(
    "readable_tables",
    f"""WITH {SERIES}, {DAILY} SELECT 'composite_index' AS name, count(*) AS n FROM series UNION ALL SELECT 'daily_index', count(*) FROM daily UNION ALL SELECT 'latest_source_scores', count(DISTINCT source) FROM daily
 UNION ALL SELECT 'meta', count(*) FROM (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'total_scored_count' ELSE 'secret' || CAST(doc_id AS VARCHAR) END AS key FROM documents) WHERE key = 'total_scored_count'""",
)
def _readable(spark: SparkSession, sf: str) -> DataFrame:
    docs, by_day = table(spark, sf, "documents"), daily(spark, sf)
    meta = docs.select(F.when(F.col("doc_id") % 2 == 0, "total_scored_count").otherwise(F.concat(F.lit("secret"), F.col("doc_id").cast("string"))).alias("key")).distinct()
    tables = {"documents": docs, "doc_registry": docs.select("doc_id"), "composite_index": series(spark, sf), "daily_index": by_day, "latest_source_scores": summary.latest_by_source(by_day), "meta": meta}
    parts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in summary.public_tables(tables).items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("registry_segments", "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE doc_id % 7 >= 5")
def _segments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents come in five runs, whose segments merge; of all documents then those of no run are new."""
    reg, d = segments.SegmentRegistry(spark, _place(spark, "segments")), silver(spark, sf).select("doc_id", "ord")
    for run in range(1, 6):
        reg.add(d.where(F.col("ord") % 7 == run - 1).select("doc_id").distinct(), run)
    return reg.unseen(d, 5).select("doc_id")


_DAYS = "date, source, category, n_docs, round(mean_score, 8) AS mean_score"


@query("index_upsert_dates", f"WITH {SCORED}, old AS ({daily_sql('(SELECT * FROM scored WHERE ord % 3 < 2)')}), new AS ({daily_sql('scored')}) SELECT {_DAYS} FROM old WHERE day(date) % 4 <> 1 UNION ALL SELECT {_DAYS} FROM new WHERE day(date) % 4 = 1")
def _upsert_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The second run has some days anew; the first one's files of all others stay."""
    store, s = sinks.RunStore(spark, _place(spark, "dated")), scored(spark, sf)
    for run, rows in ((1, index.daily_index(s.where("ord % 3 < 2"))), (2, index.daily_index(s).where("day(date) % 4 = 1"))):
        store.upsert("daily", run, rows)
        store.commit(run, (), ("daily",))
    return store.dated("daily").select("date", "source", "category", "n_docs", F.round("mean_score", 8).alias("mean_score"))


@query("positive_scores", f"WITH {SCORED} SELECT doc_id, aliveness_score FROM scored WHERE aliveness_score > 0")
def _positive(spark: SparkSession, sf: str) -> DataFrame:
    return summary.positive(scored(spark, sf)).select("doc_id", "aliveness_score")


@query("top_domains_of_a_day", f"WITH {SCORED} SELECT domain, round(avg(aliveness_score), 8) AS mean_score, count(*) AS n_docs FROM scored WHERE date = DATE '2024-01-05' GROUP BY domain HAVING avg(aliveness_score) IS NOT NULL ORDER BY n_docs DESC, domain LIMIT 5")
def _day(spark: SparkSession, sf: str) -> DataFrame:
    d = index.domain_index(scored(spark, sf), "ord")
    return summary.top_domains(d, 5, F.lit("2024-01-05").cast("date")).select("domain", F.round("mean_score", 8).alias("mean_score"), "n_docs")


@query(
    "kpi_texts",
    f"""WITH {SERIES}, l AS (SELECT max(date) AS d, arg_max(aliveness_index, date) AS score, CAST(sum(n_docs) AS BIGINT) AS n FROM series), p AS (SELECT arg_max(aliveness_index, date) AS past FROM series, l WHERE date <= l.d - 30)
 SELECT CASE WHEN score - past > 0 THEN '↑' ELSE '↓' END || ' ' || printf('%.1f', abs(score - past)) || ' vs 30 days prior' AS delta, CASE WHEN n >= 1000000 THEN printf('%.2fM', n / 1e6) ELSE format('{{:,}}', n) END AS documents FROM l, p""",
)
def _texts(spark: SparkSession, sf: str) -> DataFrame:
    s = series(spark, sf)
    now = s.agg(F.max_by("aliveness_index", "date").alias("score"), F.sum("n_docs").alias("n"))
    both = now.crossJoin(timeseries.as_of(s, "aliveness_index", 30).select(F.col("aliveness_index").alias("past")))  # one row each
    return both.select(scalars.delta_text(F.col("score"), F.col("past")).alias("delta"), scalars.short_count(F.col("n")).alias("documents"))


@query("title_names", "SELECT DISTINCT event_type, upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Of Day' AS shown FROM events")
def _title_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_type", scalars.display_name(F.concat("event_type", F.lit("_of_day"))).alias("shown")).distinct()


@query("scores_by_model", f"WITH {SCORED} SELECT source, CASE WHEN source = 'src1' THEN NULL ELSE 0.25::DOUBLE END AS score_perplexity, count(*) AS n FROM scored GROUP BY source")
def _by_model(spark: SparkSession, sf: str) -> DataFrame:
    from verascope.functions.text import score_documents

    d = score_documents(silver(spark, sf).select("source", "text"), perplexity=F.lit(0.25), where=F.col("source") != "src1")
    return d.groupBy("source", "score_perplexity").agg(F.count("*").alias("n"))
