"""Text signals against an independent version, and their neutral values."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verascope.functions import scalars, text


def py_tokens(s):
    return [w for w in re.findall(r"\w+", s.lower()) if re.fullmatch("[a-z]{2,}", w)]


def py_mtld(t, limit=0.72):
    if len(t) < 10:
        return 0.0

    def one(seq):
        factors, types, n = 0.0, set(), 0
        for w in seq:
            n += 1
            types.add(w)
            if len(types) / n <= limit:
                factors, types, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(types) / n) / (1 - limit)
        return len(seq) / factors if factors > 0 else len(seq)

    return (one(t) + one(t[::-1])) / 2


def py_entropy(t):
    c = Counter(t)
    return -sum(v / len(t) * math.log2(v / len(t)) for v in c.values()) if t else 0.0


TEXTS = ["", None, "One two.", "café abc1 foo_bar A don't ok", "The the. The cat sat! A dog ran? end", "word " * 60, "alpha beta gamma delta epsilon zeta eta theta iota. " * 3, "tail without end " * 12, "a. b. c.", "ÜBER über straße it is. x"]


def test_signals_equal_an_independent_version(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("t", text.tokens(F.col("text")))
    got = d.select("id", "t", text.mtld(F.col("t")).alias("m"), text.entropy(F.col("t")).alias("h"), text.type_token_ratio(F.col("t")).alias("r"), text.repetition(F.col("t")).alias("p")).orderBy("id").collect()
    for row, s in zip(got, TEXTS, strict=True):
        t = py_tokens(s or "")
        assert row.t == t
        assert row.m == pytest.approx(py_mtld(t))
        assert row.h == pytest.approx(py_entropy(t), abs=1e-9)
        assert row.r == pytest.approx(len(set(t[:200])) / min(200, len(t)) if t else 0)
        pairs = list(zip(t, t[1:], strict=False))
        assert row.p == pytest.approx(1 - len(set(pairs)) / len(pairs) if len(t) >= 4 else 0)


@pytest.mark.parametrize("n,zipf", [(29, 0.5), (30, None)])
def test_zipf_needs_thirty_tokens(spark, n, zipf):
    s = " ".join(["aa", "bb", "cc", "dd", "ee", "ff"][i % 6 if i % 3 else 0] for i in range(n))
    assert len(set(s.split())) == 5
    v = spark.range(1).select(text.zipf_alignment(text.tokens(F.lit(s)))).first()[0]
    assert v == 0.5 if zipf else v != 0.5 and 0 <= v <= 1


def test_sentence_variation(spark):
    of = lambda s: spark.range(1).select(text.sentence_variation(F.lit(s))).first()[0]
    assert of("One two. Three.") == 0.5
    assert of("aa bb. cc dd. ee ff.") == 0
    assert of("1. 2. 3.") == 0
    assert of("aa. bb cc dd. ee ff.") == pytest.approx(math.sqrt(2 / 3) / 2)


def test_scores_stay_in_bounds(spark, sf):
    d = text.score_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    r = d.agg(F.min("aliveness_score"), F.max("aliveness_score"), *[F.min(f"score_{k}") for k in text.WEIGHTS], *[F.max(f"score_{k}") for k in text.WEIGHTS]).first()
    assert 0 <= r[0] <= r[1] <= 100
    assert all(0 <= x <= 1 for x in r[2:])


def test_perplexity_joins_the_weights(spark):
    assert sum(text.weights(True).values()) == pytest.approx(1, abs=1e-3)
    d = spark.createDataFrame([("Plain words here. And more.",)], "text string")
    low, high = (text.score_documents(d, perplexity=F.lit(x)).first().aliveness_score for x in (0.0, 1.0))
    assert high - low == pytest.approx(15, abs=0.02)


def test_strip_and_hosts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.strip(F.lit(" \t a b\n"))) == "a b"
    hosts = {"https://www.washingtonpost.com/x": "ashingtonpost.com", "http://www.wired.com": "ired.com", "https://www.wikipedia.org": "ikipedia.org", "https://Host.example:80/p": "host.example:80", "nothing": ""}
    for url, h in hosts.items():
        assert one(scalars.host(F.lit(url))) == h
    assert one(scalars.host(F.lit("https://www.wired.com"), strict=True)) == "wired.com"
    assert one(scalars.host_category(F.lit("netflix.com"))) == "social"
    assert one(scalars.host_category(F.lit("netflix.com"), strict=True)) == "web"


def test_times(spark):
    one = lambda c: spark.range(1).select(c.cast("string")).first()[0]
    for s in ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05", "Tue, 02 Jan 2024 03:04:05 GMT", "20240102030405", "2024-01-02T03:04:05.000000+00:00", "2024-01-02T03:04:05.000Z"):
        assert one(scalars.any_time(F.lit(s))) == "2024-01-02 03:04:05", s
    assert one(scalars.any_time(F.lit("2024-01-02"))) == "2024-01-02 00:00:00"
    assert one(scalars.any_time(F.lit("junk"))) is None
    assert one(scalars.any_time(F.lit(""))) is None
    assert one(scalars.unix_time(F.lit("86400"))) == "1970-01-02 00:00:00"
    assert one(scalars.unix_time(F.lit("x"))) is None
    assert one(scalars.archive_time(F.lit("2020"))) == "2020-01-01 00:00:00"
