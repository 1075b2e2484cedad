"""The whole path on files, the optional model, the synthetic index."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from verascope.functions import perplexity, text
from verascope.plans import ingest
from verascope.sources import demo, sinks


def test_runs_twice_add_nothing_and_new_files_add_their_own(spark, tmp_path):
    words = "Plain words of a story that goes on. It has sentences. They end here."
    (tmp_path / "bronze/news/2024/01").mkdir(parents=True)
    (tmp_path / "bronze/steam").mkdir()
    write = lambda p, rows: (tmp_path / "bronze" / p).write_text("\n".join(map(json.dumps, rows)))
    write("news/2024/01/a.jsonl", [{"url": f"u{i}", "text": f"{words} {i}", "content_hash": f"h{i // 2}", "pub_date": "2024-01-05", "domain": "d"} for i in range(24)])
    write("steam/b.jsonl", [{"review_id": str(i), "text": f"Review {words} {i}", "timestamp_created": 1704412800} for i in range(4)])
    s = ingest.Settings(date(2024, 2, 1), ("news", "steam"), smooth=3)
    out = ingest.run(spark, str(tmp_path / "bronze"), str(tmp_path / "out"), s)
    assert out["silver"].count() == out["gold"].count() == out["registry"].count() == 16
    daily = {(r.source, r.n_docs): r.mean_score for r in out["daily"].collect()}
    assert set(daily) == {("news", 12), ("steam", 4)} and out["composite"].first().n_docs == 16
    again = ingest.run(spark, str(tmp_path / "bronze"), str(tmp_path / "out"), s)
    assert again["gold"].count() == 16 and {(r.source, r.n_docs): r.mean_score for r in again["daily"].collect()} == pytest.approx(daily)
    write("steam/c.jsonl", [{"review_id": "new", "text": f"Another {words}"}])
    more = ingest.run(spark, str(tmp_path / "bronze"), str(tmp_path / "out"), s)
    assert more["gold"].count() == 17
    assert {(r.date, r.n_docs) for r in more["daily"].where("source = 'steam'").collect()} == {(date(2024, 1, 5), 4), (date(2024, 2, 1), 1)}
    capped = ingest.run(spark, str(tmp_path / "bronze"), str(tmp_path / "other"), ingest.Settings(date(2024, 2, 1), ("news",), cap=5))
    assert capped["gold"].count() == 5


def test_a_run_that_fails_anywhere_changes_nothing(spark, tmp_path, monkeypatch):
    words = "Plain words of a story that goes on. It has sentences. They end here."
    (tmp_path / "bronze/steam").mkdir(parents=True)
    write = lambda p, ids: (tmp_path / "bronze" / p).write_text("\n".join(json.dumps({"review_id": str(i), "text": f"Review {words} {i}", "timestamp_created": 1704412800}) for i in ids))
    write("steam/a.jsonl", range(12))
    s = ingest.Settings(date(2024, 2, 1), ("steam",), smooth=3)
    bronze, out = str(tmp_path / "bronze"), str(tmp_path / "out")
    plain_write, plain_commit = sinks.RunStore.write, sinks.RunStore.commit

    class Crash(Exception):
        pass

    def run_failing_at(step):
        calls = []

        def failing(f, after):
            def call(self, *args):
                calls.append(args[0])
                if len(calls) - 1 == step and not after:
                    raise Crash
                found = f(self, *args)
                if len(calls) - 1 == step:
                    raise Crash
                return found

            return call

        # a write fails once its files are there, a commit before it is made
        monkeypatch.setattr(sinks.RunStore, "write", failing(plain_write, True))
        monkeypatch.setattr(sinks.RunStore, "commit", failing(plain_commit, False))
        try:
            return ingest.run(spark, bronze, out, s)
        finally:
            monkeypatch.setattr(sinks.RunStore, "write", plain_write)
            monkeypatch.setattr(sinks.RunStore, "commit", plain_commit)

    steps = 7
    for n, ids in ((12, range(12)), (17, range(12, 17))):
        write(f"steam/{n}.jsonl", ids)
        before = sinks.RunStore(spark, out).last()
        for step in range(steps):
            with pytest.raises(Crash):
                run_failing_at(step)
            assert sinks.RunStore(spark, out).last() == before
        found = run_failing_at(steps)
        assert found["gold"].count() == found["registry"].count() == n
        assert found["daily"].agg(F.sum("n_docs")).first()[0] == n and found["domains"].agg(F.sum("n_docs")).first()[0] == n
    # state that is gone is an error, not a beginning
    import shutil

    shutil.rmtree(tmp_path / "out/registry")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ingest.run(spark, bronze, out, s)


def test_sources_without_the_model(spark, tmp_path):
    (tmp_path / "bronze/steam").mkdir(parents=True)
    (tmp_path / "bronze/common_crawl").mkdir()
    text = "Some words of a text. It goes on."
    (tmp_path / "bronze/steam/a.jsonl").write_text(json.dumps({"review_id": "1", "text": text}))
    (tmp_path / "bronze/common_crawl/a.jsonl").write_text(json.dumps({"url": "u", "text": text, "domain": "d"}))
    model = perplexity.scorer(lambda: lambda t: 2.0)
    out = ingest.run(spark, str(tmp_path / "bronze"), str(tmp_path / "out"), ingest.Settings(date(2024, 2, 1), ("steam", "common_crawl"), perplexity=model))
    got = {r.source: r.score_perplexity for r in out["gold"].collect()}
    assert got == {"steam": pytest.approx(perplexity.normalised(2.0)), "common_crawl": None}
    assert out["gold"].where("aliveness_score is null").count() == 0


def test_model_plug(spark):
    def load():
        def loss(t):
            if "fail" in t:
                raise ValueError
            return 3.0

        return loss

    d = spark.createDataFrame([("some words",), ("",), (None,), ("fail",)], "text string")
    score = perplexity.scorer(load)
    assert [r[0] for r in d.select(score("text")).collect()] == pytest.approx([perplexity.normalised(3.0), 0.5, 0.5, 0.5])
    assert (perplexity.normalised(-1), perplexity.normalised(99)) == (0.0, pytest.approx(1.0)) and not perplexity.enabled()
    assert "score_perplexity" in text.score_documents(d, perplexity=score("text")).columns


def test_demo(spark):
    d = demo.demo_timeline(spark, noise=F.lit(0.0))
    assert d.count() == demo.DAYS * len(demo.SOURCES)
    r = {x.date: x.mean_score for x in d.where("source = 'reddit'").collect()}
    assert r[date(2024, 1, 1)] > 75 and 10 <= min(r.values()) < 45
