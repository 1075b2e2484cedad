"""Very long texts, clashing columns, ties, repeats and empty tables for every operator and stage; plain twins of what is trained."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verascope.llm import bpe, decontaminate, html_text, langid, lm, passages, quality_fm, quality_rules, secrets, simhash
from verascope.llm import queries as q

RANKS = public_tokenizers.path(q.RANKS)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "a plain text of some common words that goes on for a while and then ends here with a full stop. "
LONG = {
    1: PROSE * 8_000,
    2: "x" * 150_000,
    3: "\n" * 200_000 + "end",
    4: " ".join(f"w{i}" for i in range(90_000)),
    5: "ab" * 60_000 + " " + "é" * 60_000,
    6: PROSE * 8_000,
    7: None,
    8: "",
}
CLASH = ("fp", "uid", "word", "key", "words", "score", "found", "between", "ids", "component_id", "_text", "row", "values", "values", "at", "n", "tokens", "item_id", "held_out", "lang_pred", "_bad", "region", "decoded", "order", "tf", "x", "y")


@pytest.fixture(scope="module")
def long_docs(spark):
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in LONG.items()], SCHEMA)
    return d.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def model(spark, sf):
    return langid.train(spark.read.parquet(f"{sf}/documents.parquet"), F.lit(True))


def test_simhash(long_docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(long_docs).collect()}
    assert len(got) == 8 and got[1] == got[6] and got[1][1] == 1 and got[7][0] == got[8][0] == "0" * 16


def test_language(long_docs, model):
    got = {r.doc_id: r.lang_pred for r in langid.predict(long_docs, model).collect()}
    assert len(got) == 8 and got[7] == got[8] == "und" and got[1] == got[6] == "en"
    assert langid.accepted(long_docs, model, min_score=0.0).columns == long_docs.columns


def test_passages(long_docs):
    got = passages.repeated_passages(long_docs).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(1, 1), (6, 1)}
    assert max(r.n_words for r in got) == len(LONG[1].split())


def test_passages_of_texts_that_repeat_themselves(spark):
    line = " ".join(f"v{i}" for i in range(9))
    fresh = lambda k: " ".join(f"u{k}-{i}" for i in range(60))
    texts = [f"{fresh(k)} {' '.join([line] * n)} {fresh(k + 100)}" for k, n in enumerate((400, 90, 7, 6, 700))] + [fresh(999)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = passages.repeated_passages(d).collect()
    covered = {(r.doc_id, k) for r in got for k in range(r.first_word, r.first_word + r.n_words - 49)}
    want = {(k, 60 + at) for k, n in enumerate((400, 90, 7, 6, 700)) for at in range(9 * n - 49)}
    assert want <= covered and len(got) < 3000 and not any(r.doc_id == 5 for r in got)


def test_quality(spark, sf, long_docs):
    m = quality_fm.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    got = {r.doc_id: r.score for r in quality_fm.score(long_docs, m).collect()}
    assert len(got) == 8 and got[1] == got[6] and got[7] == got[8] and all(0 <= x <= 1 for x in got.values())


def test_lm(long_docs):
    m, table = lm.train(long_docs, F.col("doc_id") < 6, lm.Settings(vocabulary=200, rounds=1))
    got = {r.doc_id: r for r in lm.score(long_docs, m, table).collect()}
    assert len(got) == 8 and got[1].score == pytest.approx(got[6].score) and got[7].n_tokens == got[8].n_tokens == 1
    assert all(math.isfinite(r.score) for r in got.values()) and got[4].n_known == 90_001


def test_secrets(spark, long_docs):
    forest = secrets.train(secrets.built_in_findings(spark))
    assert secrets.findings(long_docs, forest).count() == 0
    same = spark.createDataFrame([(1, "password=Xk29fLq81zTb and password=Xk29fLq81zTb"), (1, "password=Xk29fLq81zTb and password=Xk29fLq81zTb")], "doc_id bigint, text string")
    assert sorted(r.nth for r in secrets.findings(same, forest).collect()) == [0, 0, 1, 1]
    back = secrets.redacted(long_docs, forest)
    assert back.columns == long_docs.columns and back.where("text is not null").count() == 7


def test_no_tail_is_left(spark):
    r = random.Random(2)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    forest = secrets.train(secrets.built_in_findings(spark))
    rows, values = [], []
    for i in range(200):
        v = "".join(r.choice(letters) for _ in range(r.randrange(6, 12))) + r.choice("!@#$&%*^") + "".join(r.choice(letters) for _ in range(r.randrange(4, 9))) + str(r.randrange(10, 99))
        values.append(v)
        rows.append((i, r.choice(("password=%s next", 'token: "%s" next', "api_key = %s, next", "see https://me:%s@db.example/x next")) % v.replace("@", "!") if i % 4 == 3 else f"password={v} next"))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x.text for x in secrets.redacted(d, forest).collect()}
    marked = [i for i in got if "[SECRET]" in got[i]]
    assert len(marked) > 190
    # of a marked value nothing is left: four characters of it in a row nowhere
    for i in marked:
        v = values[i].replace("@", "!") if i % 4 == 3 else values[i]
        assert not any(v[k : k + 4] in got[i] for k in range(len(v) - 3)), (rows[i], got[i])


def test_rules(long_docs):
    got = {r.doc_id: r for r in quality_rules.judged(long_docs).collect()}
    assert len(got) == 8 and got[1].n_repeat_words == got[1].n_words == len(LONG[1].split()) and got[4].n_repeat_words == 0 and got[4].n_words == 90_000
    assert got[7].base_failed and got[8].base_failed


def test_bpe(spark, long_docs):
    got = {r.doc_id: r for r in bpe.encode(long_docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(bytes(got[i].decoded) == (t or "").encode() for i, t in LONG.items())
    assert got[1].ids == got[6].ids and not got[7].ids and not got[8].ids
    assert bpe.decode(spark.createDataFrame([], "doc_id bigint, ids binary"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_decontamination(spark, long_docs):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500, 540)), "c"), (2, LONG[4], "c"), (3, "not in there at all, but long enough to be an item of its own here", "c")], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(long_docs, items).collect()}
    assert got == {(4, 1), (4, 2)}


def test_html(spark):
    page = "<article>" + "<p>" + PROSE + "</p>" * 1 + "".join(f"<p>{PROSE}</p>" for _ in range(3000)) + "</article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, "<p>One text of some length stands in here alone.</p>"), (2, "u", "<p></p>")]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars", "tag")})
    got = html_text.extract(d).collect()
    assert sorted(r.n_chars for r in got) == [0, len("One text of some length stands in here alone."), 3001 * len(PROSE) - 1, 3001 * len(PROSE) - 1]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf, long_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, long_docs, sf)
    assert stage(spark, long_docs.where("false"), sf).count() == 0
    if name == "tokenization":
        assert out.count() == 8 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
        return
    assert out.columns == long_docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept == {"language_id": kept & set(range(1, 7)), "near_dedup": {1, 2, 3, 4, 5, 7}, "decontamination": set(LONG), "secret_scan": set(LONG)}[name]
    assert 1 in kept


# ── plain twins ──


def test_ftrl_by_its_definition():
    s = langid.Settings(bits=5, epochs=2)
    r = np.random.default_rng(3)
    rows = [(np.sort(r.choice(32, 6, replace=False)), r.random(6)) for _ in range(40)]
    labels = r.integers(0, 3, 40)
    got = langid.ftrl(rows, labels, 3, 32, s)
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= s.l1:
            return 0.0
        return -(z[k] - math.copysign(s.l1, z[k])) / ((s.beta + math.sqrt(n[k])) / s.alpha + s.l2)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            x = {int(a): float(v) for a, v in zip(*rows[i], strict=True)} | {32: 1.0}
            w = {(a, c): weight((a, c)) for a in x for c in range(3)}
            e = [math.exp(sum(x[a] * w[a, c] for a in x)) for c in range(3)]
            for a in x:
                for c in range(3):
                    g = (e[c] / sum(e) - (labels[i] == c)) * x[a]
                    step = (math.sqrt(n.get((a, c), 0.0) + g * g) - math.sqrt(n.get((a, c), 0.0))) / s.alpha
                    z[a, c] = z.get((a, c), 0.0) + g - step * w[a, c]
                    n[a, c] = n.get((a, c), 0.0) + g * g
    assert got == pytest.approx(np.array([[weight((a, c)) for c in range(3)] for a in range(33)]))
    # the first-order penalty leaves weights at zero
    assert (langid.ftrl(rows, labels, 3, 32, langid.Settings(bits=5, l1=2.0)) == 0).mean() > 0.5


def test_features_of_language_by_brute_force(spark):
    texts = ["ab ba", "ab", "", "xyz ab"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    seen, n = langid.document_frequency(d, 12)
    grams = lambda t: [t[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1)]
    bucket = {g: int(langid.buckets(g, 12)[-1]) for t in texts for g in grams(t)}
    assert n == 4 and seen.sum() == sum(len({bucket[g] for g in grams(t)}) for t in texts)
    for t in texts:
        at, tf = langid.counts(t, 12)
        want = {}
        for g in grams(t):
            want[bucket[g]] = want.get(bucket[g], 0) + 1
        assert {int(a): v for a, v in zip(at, tf, strict=True)} == pytest.approx({b: 1 + math.log(c) for b, c in want.items()})


def test_ties_between_languages():
    # equal logits: the first language in order
    m = langid.Model(["a", "b"], np.ones(1 << 5), np.zeros(((1 << 5) + 1, 2)), 1.0, 5)
    assert m.predict("some text") == ("a", 0.5)


def test_factorisation_machine_by_its_definition():
    s = quality_fm.Settings(bits=3, rank=2, epochs=3)
    size = 8 + quality_fm.STATISTICS
    r = np.random.default_rng(5)
    rows = [(np.sort(r.choice(size, 5, replace=False)), r.random(5)) for _ in range(30)]
    labels = r.integers(0, 2, 30).astype(float)
    got = quality_fm.fit(rows, labels, s)
    rng = np.random.default_rng(11)
    bias = math.log(labels.mean() / (1 - labels.mean()))
    w, v = [0.0] * size, rng.normal(0, s.init, (size, s.rank)).tolist()
    gw, gv, gb = [1e-6] * size, [[1e-6] * s.rank for _ in range(size)], 1e-6
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            x = {int(a): float(z) for a, z in zip(*rows[i], strict=True)}
            pairs = sum(sum(v[a][f] * v[b][f] for f in range(s.rank)) * x[a] * x[b] for a in x for b in x if a < b)
            g = 1 / (1 + math.exp(-(bias + sum(w[a] * x[a] for a in x) + pairs))) - labels[i]
            sums = [sum(v[a][f] * x[a] for a in x) for f in range(s.rank)]
            gb += g * g
            bias -= s.rate * g / math.sqrt(gb)
            for a in x:
                d = g * x[a] + s.l2 * w[a]
                gw[a] += d * d
                w[a] -= s.rate * d / math.sqrt(gw[a])
                for f in range(s.rank):
                    d = g * x[a] * (sums[f] - v[a][f] * x[a]) + s.l2 * v[a][f]
                    gv[a][f] += d * d
                    v[a][f] -= s.rate * d / math.sqrt(gv[a][f])
    assert got.bias == pytest.approx(bias) and got.linear == pytest.approx(w) and got.factors == pytest.approx(np.array(v))


def test_quality_query_by_a_plain_path(spark, sf):
    # the query's scores are those of the model that the learnable rows give, whatever the partitions
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    import zlib

    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0 and r.doc_id in texts and r.quality in (0, 1)}
    order = {r.doc_id: r.k for r in spark.createDataFrame([(i,) for i in known], "doc_id bigint").select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(31)).alias("k")).collect()}
    rows, y = [], []
    for i in sorted(known, key=order.get):
        _, at, x = quality_fm.features([texts[i].encode()], quality_fm.Settings().bits)
        rows.append((at, x.astype(np.float32).astype(float)))
        y.append(float(known[i]))
    m = quality_fm.fit(rows, np.array(y), quality_fm.Settings())
    got = {r.doc_id: r.score for r in q.op5_quality_classifier(spark, sf).collect()}
    ids = list(texts)
    assert [got[i] for i in ids] == pytest.approx(m.scores([texts[i].encode() for i in ids]))
