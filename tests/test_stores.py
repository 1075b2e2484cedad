"""Mergeable daily state, tables by date, and the registry of segments: what is exact, and which files are touched."""

import hashlib
import random
import sqlite3
import statistics
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from verascope.operators import index
from verascope.sources import segments, sinks, stores

SCORED = "date date, source string, category string, aliveness_score double"


def rows(n, seed=3):
    rng = random.Random(seed)
    hot = (date(2024, 1, 1), "s0", "c0")
    other = lambda: (date(2024, 1, 1) + timedelta(rng.randint(0, 3)), f"s{rng.randint(0, 2)}", rng.choice(["c0", "c1", None]))
    out = [(*(hot if rng.random() < 0.5 else other()), rng.choice([None, round(rng.uniform(0, 100), 2), 50.0, 0.0, -0.0, 49.999])) for _ in range(n)]
    return out + [(date(2024, 3, 1), "only", "unscored", None), (date(2024, 3, 2), "one", "score", 7.25)]


def shown(df):
    return {(r.date, r.source, r.category): pytest.approx(tuple(None if x is None else float(x) for x in r[3:]), abs=1e-9, nan_ok=True) for r in df.collect()}


def plain(r):
    groups = {}
    for d, s, c, x in r:
        if c is not None:
            groups.setdefault((d, s, c), []).append(x)
    out = {}
    for k, xs in groups.items():
        known = [x for x in xs if x is not None]
        if known:
            m = statistics.fmean(known)
            out[k] = (len(xs), m, statistics.median([round(x, 2) for x in known]), statistics.stdev(known) if len(known) > 1 else None, 100 * sum(x < 50 for x in known) / len(known), 0.0, m)
    return out


def test_states_merge_exactly_in_any_order(spark):
    all_rows = rows(900)
    expected = plain(all_rows)
    whole = spark.createDataFrame(all_rows, SCORED)
    assert shown(index.daily_of_state(index.daily_state(whole))) == expected
    rng = random.Random(1)
    for k in (2, 5):
        cut = [[] for _ in range(k)]
        for r in all_rows:
            rng.choice(cut).append(r)
        rng.shuffle(cut)
        state = None
        for part in cut:
            new = index.daily_state(spark.createDataFrame(part, SCORED))
            state = new if state is None else index.merge_states(state, new)
        assert shown(index.daily_of_state(state)) == expected
    empty = index.daily_state(whole.limit(0))
    assert empty.count() == 0 and shown(index.daily_of_state(index.merge_states(empty, index.daily_state(whole)))) == expected


def test_the_state_of_a_hot_group_is_bounded(spark):
    d = spark.range(50_000).select(F.lit(date(2024, 1, 1)).alias("date"), F.lit("s").alias("source"), F.lit("c").alias("category"), (F.rand(1) * 100).alias("aliveness_score"))
    r = index.daily_state(d).select("n_scored", F.size("histogram").alias("n")).first()
    assert r.n_scored == 50_000 and r.n <= 10_001


def digests(path):
    return {str(p.relative_to(path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(Path(path).rglob("*.parquet"))}


def test_an_upsert_touches_its_dates_alone(spark, tmp_path):
    store = sinks.RunStore(spark, str(tmp_path))
    frame = lambda items: spark.createDataFrame([(date(2024, 1, d), v) for d, v in items], "date date, v long")
    read = lambda **k: sorted((r.date.day, r.v) for r in store.dated("t", **k).collect())
    assert store.dated("t") is None
    store.upsert("t", 1, frame([(1, 1), (1, 2), (2, 3), (3, 4)]))
    assert store.dated("t") is None  # not committed
    store.commit(1)
    before = digests(tmp_path / "t")
    store.upsert("t", 2, frame([(2, 30), (4, 5)]))
    assert read() == [(1, 1), (1, 2), (2, 3), (3, 4)] and read(run=2) == [(1, 1), (1, 2), (2, 30), (3, 4), (4, 5)]
    # the run failed before its commit: the next one has its number and other rows
    store.upsert("t", 2, frame([(3, 40)]))
    store.commit(2, (), ("t",))
    assert read() == [(1, 1), (1, 2), (2, 3), (3, 40)] and store.dated("t").columns == ["date", "v"]
    assert read(only=[date(2024, 1, 1), date(2024, 1, 9)]) == [(1, 1), (1, 2)]
    after = digests(tmp_path / "t")
    assert all(after[f] == before[f] for f in before)
    opened = store.dated("t", only=[date(2024, 1, 3)]).inputFiles()
    assert opened and all("run=2/date=2024-01-03" in f for f in opened)
    store.upsert("t", 3, frame([(3, 41)]))
    store.commit(3, (), ("t",))
    # the rows that run 2 replaced are gone now, others are where they were
    assert not list((tmp_path / "t/run=1/date=2024-01-03").glob("*")) and read() == [(1, 1), (1, 2), (2, 3), (3, 41)]
    store.upsert("t", 4, frame([]))
    store.commit(4)
    assert read() == [(1, 1), (1, 2), (2, 3), (3, 41)]


def ids(spark, low, high, step=1):
    return spark.range(low, high, step).select(F.format_string("id%08d", "id").alias("doc_id"))


@pytest.fixture
def uncoalesced(spark):
    """Small tables keep their partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, old)


def test_new_ids_open_no_id_file(uncoalesced, tmp_path):
    spark = uncoalesced
    reg = segments.SegmentRegistry(spark, str(tmp_path))
    assert reg.segments(0) == [] and reg.unseen(ids(spark, 0, 5), 0).count() == 5
    # even numbers only: odd ones lie within all ranges
    reg.add(ids(spark, 0, 20_000, 2).repartition(6), 1)
    reg.add(ids(spark, 20_000, 24_000, 2), 2)
    total = sum(len(s["files"]) for s in reg.segments(2))
    assert total >= 5
    fresh = ids(spark, 1, 24_000, 600)
    possible = sum(reg.possible(fresh, s).count() for s in reg.segments(2))
    assert possible <= 1 and len(reg.files_for(fresh, 2)) == possible
    assert reg.files_for(ids(spark, 900_000, 900_500), 2) == []
    # a known id opens the file whose range holds it, and no other
    assert len(reg.files_for(ids(spark, 4000, 4001), 2)) == 1
    batch = ids(spark, 3990, 4010).unionByName(spark.createDataFrame([(None,)], "doc_id string")).withColumn("x", F.lit(1))
    left = reg.unseen(batch, 2)
    assert left.columns == ["doc_id", "x"] and sorted(r.doc_id or "" for r in left.collect()) == ["", *(f"id{i:08d}" for i in range(3991, 4010, 2))]
    # every known id is found
    assert reg.unseen(ids(spark, 0, 24_000, 2), 2).count() == 0


def test_segments_merge_and_a_crash_loses_nothing(spark, tmp_path, monkeypatch):
    reg = segments.SegmentRegistry(spark, str(tmp_path))
    for n in range(1, 4):
        reg.add(ids(spark, 100 * n, 100 * n + 90), n)
    assert len(reg.segments(3)) == 3

    def crash(*_):
        raise RuntimeError

    monkeypatch.setattr(sinks.Manifests, "write", crash)
    with pytest.raises(RuntimeError):
        reg.add(ids(spark, 400, 490), 4)
    monkeypatch.undo()
    assert len(reg.segments(4)) == 3 and reg.read(4).count() == 270 and reg.unseen(ids(spark, 400, 490), 4).count() == 90
    reg.add(ids(spark, 500, 590), 4)
    assert len(reg.segments(4)) == 1 and reg.read(4).count() == 360 and len(reg.segments(3)) == 3
    assert reg.unseen(ids(spark, 0, 1000), 4).count() == 640
    reg.add(ids(spark, 0, 0), 5)
    assert reg.segments(5) == reg.segments(4)


def store(spark, path):
    def connect():
        return sqlite3.connect(path, timeout=60)

    con = connect()
    for t in stores.TABLES:
        con.execute(t)
    con.commit()
    con.close()
    return stores.Relational(spark, connect)


def test_runs_at_once_share_no_id(spark, tmp_path):
    s = store(spark, f"{tmp_path}/s.db")
    s.register(ids(spark, 0, 50), "a")
    # both runs found the same ids new before either inserted; what each is told it inserted is disjoint
    known, s.known = s.known, lambda asked, key: asked.where(f"{key} < 'id00000050'")
    one = s.register(ids(spark, 0, 700), "b", run="one")
    two = s.register(ids(spark, 40, 800), "c", run="two")
    again = s.register(ids(spark, 0, 700), "d", run="one")
    s.known = known
    got = [sorted(r[0] for r in x.collect()) for x in (one, two, again)]
    assert len(got[0]) == 650 and got[1] == [f"id{i:08d}" for i in range(700, 800)] and got[2] == got[0]
    assert s.count_again() == 800
    read = s.read("SELECT doc_id, scored_at FROM doc_registry", "doc_id string, at string", ("doc_id < 'id00000400'", "doc_id >= 'id00000400'"))
    assert read.rdd.getNumPartitions() == 2 and read.groupBy("at").count().count() == 3 and read.count() == 800


def test_a_staged_delta_counts_once(spark, tmp_path):
    s = store(spark, f"{tmp_path}/s.db")
    delta = index.daily_index(spark.createDataFrame(rows(60), SCORED))
    n = delta.count()
    assert (s.merge_daily(delta, "a"), s.merge_daily(delta, "a"), s.merge_daily(delta, "b")) == (n, 0, n)
    found = s.read("SELECT n_docs FROM daily_index", "n_docs bigint").agg(F.sum("n_docs")).first()[0]
    assert found == 2 * delta.agg(F.sum("n_docs")).first()[0] and s._rows("SELECT count(*) FROM daily_staged") == [(0,)]
    nothing = stores.Relational(spark, None)
    assert nothing.read("SELECT 1", "x int").count() == 0 and nothing.merge_daily(delta, "a") == 0
