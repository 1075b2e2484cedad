import random

import pytest

from verascope.streaming import changepoints

SCHEMA = "source string, day int, score double"


def series(seed=4):
    rng = random.Random(seed)
    level = {"a": 0.0, "b": 5.0}
    rows = []
    for day in range(120):
        for s in level:
            if rng.random() < 0.05:
                level[s] += rng.choice([-3, 3])
            rows.append((s, day, None if rng.random() < 0.03 else round(level[s] + rng.gauss(0, 1), 3)))
    return rows + [("unknown", 3, 1.0)]


def plain(rows, reference, k=0.5, h=4.0):
    out = []
    for s, (mu, sd) in reference.items():
        p = n = 0.0
        for _, day, v in sorted((r for r in rows if r[0] == s and r[2] is not None), key=lambda r: r[1]):
            x = (v - mu) / (sd or 1.0)
            p, n = max(0.0, p + x - k), max(0.0, n - x - k)
            if p > h or n > h:
                p = n = 0.0
                out.append((s, day, v, "alarm"))
    return sorted(out)


REFERENCE = {"a": (0.5, 2.0), "b": (5.0, 0.0)}


@pytest.mark.parametrize("cuts", [[40], [7, 8, 90]])
def test_any_cut_gives_the_alarms_of_the_whole(spark, tmp_path, cuts):
    rows = series()
    expected = plain(rows, REFERENCE)
    assert len(expected) > 10
    reference = spark.createDataFrame([(s, *x) for s, x in REFERENCE.items()], "source string, mu double, sd double")
    whole = changepoints.alarms(spark.createDataFrame(rows, SCHEMA), reference, "source", "day", "score")
    assert sorted(map(tuple, whole.collect())) == expected

    def go_on():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        found = changepoints.alarm_stream(stream, reference, "source", "day", "score")
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        found.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()

    # each part is a run of its own: the state comes from the checkpoint
    for low, high in zip([0, *cuts], [*cuts, 120], strict=True):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        go_on()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").drop("batch").collect())) == expected
    if len(cuts) == 1:
        # nothing new: nothing is said again; a day that was passed is late
        go_on()
        spark.createDataFrame([("a", 5, 50.0)], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        go_on()
        after = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").drop("batch").collect()))
        assert [x for x in after if x[3] == "late"] == [("a", 5, 50.0, "late")] and [x for x in after if x[3] == "alarm"] == expected
