import random
import statistics

import pytest
from pyspark.sql import functions as F

from verascope.operators import bots, ranges


@pytest.fixture
def many_ranges(spark):
    """Settings under which small tables have 24 ranges."""
    new = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def events(n=4000, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.9 else f"a{rng.randint(0, 40)}", rng.randint(0, 100_000) / 4) for _ in range(n)]
    return rows + rows[:200] + [("hot", None), ("none", None), (None, 5.0), (None, 9.0), (None, 10.0), ("same", 3.0), ("same", 3.0)]


def plain(rows):
    out = {}
    for account in {a for a, _ in rows}:
        ts = sorted(t for a, t in rows if a == account and t is not None)
        gaps = [b - a for a, b in zip(ts, ts[1:], strict=False) if b > a]
        out[account] = (len(ts), len(gaps), pytest.approx(statistics.fmean(gaps)) if gaps else None, pytest.approx(statistics.pstdev(gaps), abs=1e-9) if gaps else None)
    return out


def test_gaps_of_a_hot_account(many_ranges):
    spark, rows = many_ranges, events()
    df = spark.createDataFrame(rows, "account string, ts double")
    assert {r[0]: tuple(r[1:]) for r in ranges.gap_moments(df, "account", "ts").collect()} == plain(rows)
    sizes = [r["count"] for r in ranges.dealt(df.where("ts is not null"), ["account"], ["ts"]).groupBy("_part").count().collect()]
    assert max(sizes) < 0.1 * len(rows) and len(sizes) == 24


def test_gaps_of_whole_numbers_and_none(spark):
    df = spark.createDataFrame([("a", 1 << 60), ("a", (1 << 60) + 1), ("a", (1 << 60) + 3)], "account string, ts long")
    assert tuple(ranges.gap_moments(df, "account", "ts").first()) == ("a", 3, 2, 1.5, 0.5)
    assert bots.burstiness(df.limit(0)).collect() == []


def test_as_of_on_a_hot_key(many_ranges):
    spark, rng = many_ranges, random.Random(7)
    key = lambda: "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
    left = [(i, key(), rng.randint(0, 5000) if rng.random() < 0.98 else None) for i in range(3000)]
    right = [(key(), rng.randint(0, 5000) if rng.random() < 0.95 else None, rng.randint(0, 9)) for _ in range(400)] + [("late", 10, 1)]
    left += [(9000, "late", 9), (9001, "late", 10), (9002, "gone", 4)]
    expected = {}
    for i, k, t in left:
        before = [(rt, v) for rk, rt, v in right if rk == k and t is not None and rt is not None and rt <= t]
        expected[i] = max(before)[1] if before else None
    l = spark.createDataFrame(left, "id long, k string, t long")
    r = spark.createDataFrame(right, "k string, rt long, v long")
    found = ranges.asof_join(l, r, ["k"], "t", "rt", ["v"])
    assert found.columns == ["id", "k", "t", "v"]
    assert {x.id: x.v for x in found.collect()} == expected and found.count() == len(left)
    assert ranges.asof_join(l.limit(0), r, ["k"], "t", "rt", ["v"]).collect() == []
    assert ranges.asof_join(l, r.limit(0), ["k"], "t", "rt", ["v"]).where(F.col("v").isNotNull()).count() == 0
