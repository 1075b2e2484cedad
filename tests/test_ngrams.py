import json
import math
import random
from collections import Counter
from datetime import date
from pathlib import Path

import pytest

from verascope.functions import perplexity
from verascope import session
from verascope.operators import ngrams
from verascope.session import shared_dir
from verascope.plans import ingest


def texts(n=60):
    rng = random.Random(3)
    words = ["the", "sea", "and", "old", "man", "boat", "was", "long"]
    return [(i, " ".join(rng.choices(words, weights=range(1, 9), k=rng.randint(0, 40)))) for i in range(n)] + [(900, "zebra xylophone quagga"), (901, None), (902, "1 2 x"), (903, "the " * 700 + "sea " * 300)]


def plain(rows, train):
    """Probabilities by their definition."""
    triples = lambda t, most=None: [tuple(x) for w in [["<s>", "<s>", *(t or "").split()][: None if most is None else most + 2]] for x in zip(w, w[1:], w[2:], strict=False)]
    clean = lambda t: " ".join(x for x in (t or "").split() if len(x) > 1 and x.isalpha())
    three = Counter(x for _, t in train for x in triples(clean(t)))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)
    d = lambda c: round(n1 / (n1 + 2 * sum(x == 2 for x in c.values())), 6) if (n1 := sum(x == 1 for x in c.values())) else 0.5
    d3, d2 = d(three), d(two)

    def p(u, v, w):
        p1 = (one[w] + 0.5) / (sum(one.values()) + 0.5 * (len(one) + 1))
        after = {x: c for (y, x), c in two.items() if y == v}
        p2 = (max(after.get(w, 0) - d2, 0) + d2 * len(after) * p1) / sum(after.values()) if after else p1
        after = {x: c for (y, z, x), c in three.items() if (y, z) == (u, v)}
        return (max(after.get(w, 0) - d3, 0) + d3 * len(after) * p2) / sum(after.values()) if after else p2

    out = {}
    for i, t in rows:
        logs = [math.log(p(*x)) for x in triples(clean(t), 512)]
        out[i] = perplexity.normalised(-sum(logs) / len(logs)) if logs else 0.5
    return out, p


def test_scores_by_definition(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngrams.train(df.where("doc_id < 900"))
    want, p = plain(rows, [r for r in rows if r[0] < 900])
    got = {r.doc_id: r.score_perplexity for r in ngrams.scores(df, model).collect()}
    assert got == {i: pytest.approx(x) for i, x in want.items()}
    assert got[900] > max(got[i] for i in range(60)) and got[901] == got[902] == 0.5
    # what follows two words has a probability of one together, an unseen word included
    for u, v in (("the", "sea"), ("<s>", "<s>"), ("no", "such")):
        seen = [r.w for r in model.one.select("w").collect()]
        after = spark.createDataFrame([(u, v, w) for w in [*seen, "unseen"]], "u string, v string, w string")
        assert sum(r.p for r in ngrams.probabilities(after, model).collect()) == pytest.approx(1)


def test_nothing_learned_and_nothing_asked(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = ngrams.train(df)
    assert ngrams.scores(df, model).collect() == []
    one = ngrams.scores(spark.createDataFrame([(1, "some words"), (None, "more")], "doc_id long, text string"), model).collect()
    assert {r.doc_id for r in one} == {1, None} and all(r.score_perplexity == 0 for r in one)


def test_ingest_with_a_model(spark, tmp_path):
    (tmp_path / "bronze/steam").mkdir(parents=True)
    (tmp_path / "bronze/common_crawl").mkdir()
    text = "Some words of a text. It goes on."
    (tmp_path / "bronze/steam/a.jsonl").write_text(json.dumps({"review_id": "1", "text": text}))
    (tmp_path / "bronze/common_crawl/a.jsonl").write_text(json.dumps({"url": "u", "text": text, "domain": "d"}))
    model = ngrams.train(spark.createDataFrame([("some words go on and on",)], "text string"))
    out = ingest.run(spark, str(tmp_path / "bronze"), str(tmp_path / "out"), ingest.Settings(date(2024, 2, 1), ("steam", "common_crawl"), language_model=model))
    got = {r.source: r.score_perplexity for r in out["gold"].collect()}
    assert got["common_crawl"] is None and 0 < got["steam"] < 1
    assert out["gold"].where("aliveness_score is null").count() == 0


def test_scores_write_no_triples_and_shuffle_them_for_look_ups_alone(spark):
    df = spark.createDataFrame([(i, "some words go on and on") for i in range(4)], "doc_id long, text string")
    model = ngrams.train(df)
    root = Path(shared_dir(spark).removeprefix("file://"))
    before = set(root.iterdir())
    found = ngrams.scores(df, model)
    assert set(root.iterdir()) == before
    # five look-ups of triples, the sum, the ids, and their join; nothing is grouped to be joined back
    text = found._jdf.queryExecution().sparkPlan().toString()
    assert text.count("HashAggregate") <= 4 and len({r.score_perplexity for r in found.collect()}) == 1


def test_own_scores_are_those_of_the_model_of_the_same_texts(spark):
    rows = [r for r in texts() if r[0] != 902] + [(5, "the sea the sea and"), (None, "old boat"), (None, "the man")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score_perplexity for r in ngrams.own_scores(df).collect()}
    want = {r.doc_id: r.score_perplexity for r in ngrams.scores(df, ngrams.train(df)).collect()}
    assert got == {i: pytest.approx(x) for i, x in want.items()} and len(got) == len({i for i, _ in rows})
    alone = [r for r in texts() if r[0] < 900]
    want, _ = plain(alone, alone)
    got = {r.doc_id: r.score_perplexity for r in ngrams.own_scores(spark.createDataFrame(alone, "doc_id long, text string")).collect()}
    assert got == {i: pytest.approx(x) for i, x in want.items()}
    assert ngrams.own_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_query_shuffles_triples_three_times_and_leaves_no_files_of_them(spark, sf, monkeypatch):
    """Once each to count them and look them up below, once home; the files of what was written are gone."""
    seen, files = [], lambda: sum("shuffle_" in f.getName() for f in map(blocks.apply, range(blocks.size())))
    real = ngrams.written

    def written(df, tag, **how):
        seen.append((tag, str(df._jdf.queryExecution().optimizedPlan()).count("RepartitionByExpression")))
        return real(df, tag, **how)

    monkeypatch.setattr(ngrams, "written", written)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    blocks = disk.getAllFiles()
    before = files()
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = ngrams.own_scores(df)
    blocks = disk.getAllFiles()
    # the discounts' and the words' totals leave a few, of one row a task
    assert files() - before <= 40 and dict(seen)["own-triples"] == 1
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 2 and "Window" not in plan
    assert spark.conf.get(session.RELEASE) == "false"


def test_the_catalogue_scores_by_three_shuffles(spark, sf, monkeypatch):
    from verascope.plans import catalogue

    monkeypatch.setattr(ngrams, "train", None)
    assert catalogue.QUERIES["perplexity_scores"](spark, sf).count() > 0
