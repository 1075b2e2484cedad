"""Index algebra, series, dedup, accounts, bronze, streaming: one test per rule that is easy to get wrong."""

import json
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verascope.functions import dom, html
from verascope.operators import bots, dedup, index, normalise, ranges, summary, timeseries
from verascope.plans.standins import scored
from verascope.sources import bronze
from verascope.streaming import incremental


def days(spark, values, start=date(2024, 1, 1)):
    return spark.createDataFrame([(start + timedelta(i), v, 20) for i, v in enumerate(values)], "date date, aliveness_index double, n_docs bigint")


def test_counts_hold_unscored_rows_and_single_rows_have_no_deviation(spark):
    d = spark.createDataFrame([(date(2024, 1, 1), "a", "x", 40.0), (date(2024, 1, 1), "a", "x", None), (date(2024, 1, 1), "b", "x", None), (None, "a", "x", 1.0)], "date date, source string, category string, aliveness_score double")
    r = index.daily_index(d).collect()
    assert [(x.source, x.n_docs, x.mean_score, x.std_score, x.pct_below_50) for x in r] == [("a", 2, 40.0, None, 100.0)]


def test_merge_equals_one_batch_in_counts_and_means(spark, sf):
    s = scored(spark, sf, nulls=False)
    whole = index.daily_index(s)
    halves = index.merge_delta(index.daily_index(s.where("ord % 2 = 0")), index.daily_index(s.where("ord % 2 = 1")))
    both = whole.alias("w").join(halves.alias("h"), ["date", "source", "category"], "full")
    assert both.where("w.n_docs <> h.n_docs or abs(w.mean_score - h.mean_score) > 1e-9 or w.n_docs is null or h.n_docs is null").count() == 0


def test_composite_weights_and_floor(spark):
    rows = [(date(2024, 1, 1), "reddit", "a", 9, 10.0), (date(2024, 1, 1), "elsewhere", "a", 1, 60.0), (date(2024, 1, 2), "news", "a", 9, 10.0)]
    d = spark.createDataFrame(rows, "date date, source string, category string, n_docs bigint, mean_score double")
    r = index.composite(d).collect()
    assert len(r) == 1 and r[0].aliveness_index == pytest.approx((10 * 0.15 + 60 * 0.1) / 0.25)


@pytest.mark.parametrize("width", [4, 7, 21])
def test_centred_mean_is_pandas(spark, width):
    v = [float(x * x % 17) for x in range(40)]
    got = [r.smoothed_index for r in index.smoothed(days(spark, v), width=width).orderBy("date").collect()]
    assert got == pytest.approx(pd.Series(v).rolling(width, min_periods=1, center=True).mean().tolist())


def test_trailing_z_and_reasons(spark):
    v = [50.0 + (i % 3) for i in range(40)] + [90.0, 50.0]
    s = pd.Series(v)
    z = (s - s.rolling(30, min_periods=7).mean()) / (s.rolling(30, min_periods=7).std() + 1e-9)
    r = index.with_anomalies(days(spark, v)).orderBy("date").collect()
    assert [x.z_score for x in r][:6] == [None] * 6
    assert [x.z_score for x in r][6:] == pytest.approx(z.tolist()[6:])
    assert r[40].anomaly_reason == "spike" and r[40].anomaly_flag == 1 and r[0].anomaly_flag == 0


def py_cusum(x, k=0.5, h=4.0):
    x = np.array(x)
    sd = x.std() or 1.0
    p = n = 0.0
    out = []
    for i, v in enumerate((x - x.mean()) / sd):
        p, n = max(0.0, p + v - k), max(0.0, n - v - k)
        if p > h or n > h:
            out.append(i)
            p = n = 0.0
    return out


@pytest.mark.parametrize("values", [[1.0] * 10, [0.0] * 20 + [5.0] * 20, list(np.random.default_rng(1).normal(0, 1, 80).cumsum())])
def test_change_points(spark, values):
    values = [float(v) for v in values]
    got = [(r.date - date(2024, 1, 1)).days for r in timeseries.cusum(days(spark, values), "aliveness_index").orderBy("date").collect()]
    assert got == py_cusum(values)


def test_no_change_points_in_an_empty_series(spark):
    assert timeseries.cusum(days(spark, [1.0]).where("false"), "aliveness_index").count() == 0


def test_slopes_need_a_full_frame(spark):
    v = [float(3 * i + i % 2) for i in range(40)]
    r = timeseries.enrich_timeline(days(spark, v), digits=None).orderBy("date").collect()
    assert all(x.decay_rate_30d is None and x.trend == "unknown" for x in r[:29])
    assert r[29].decay_rate_30d == pytest.approx(np.polyfit(range(30), v[:30], 1)[0]) and r[29].trend == "recovering"
    assert all(x.decay_rate_90d is None for x in r)


def test_ties_at_the_cut_stay(spark):
    d = spark.createDataFrame([(i, 1.0, z, "spike", True) for i, z in enumerate([3.0, -4.0, 4.0, 3.0])], "date int, aliveness_index double, z_score double, anomaly_type string, is_anomaly boolean")
    assert timeseries.notable_anomalies(d, 1).count() == 2
    assert timeseries.notable_anomalies(d, 3).count() == 4


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (3, 4)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c"), (3, 3, None)], "k int, rt int, v string")
    got = {(r.k, r.t): r.v for r in ranges.asof_join(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None, (3, 4): None}


def test_keep_first_and_last_mirror(spark):
    d = spark.createDataFrame([("s", "a", "h1", 3), ("s", "b", "h1", 1), ("s", "c", "", 2), ("t", "d", "h1", 5)], "source string, doc_id string, content_hash string, n int")
    assert {r.doc_id for r in dedup.keep_first(d, ["n"]).collect()} == {"b", "c", "d"}
    assert {r.doc_id for r in dedup.keep_last(d.where("content_hash <> ''"), "content_hash", ["n"]).collect()} == {"d"}


def test_null_keys_are_never_known(spark):
    d = spark.createDataFrame([("a",), (None,), ("b",)], "doc_id string")
    assert {r.doc_id for r in dedup.new_rows(d, d.where("doc_id = 'a' or doc_id is null")).collect()} == {None, "b"}


def test_newest_puts_nulls_last(spark):
    d = spark.createDataFrame([("a", None), ("b", date(2024, 1, 1)), ("c", date(2024, 1, 2))], "doc_id string, created_dt date")
    assert [r.doc_id for r in dedup.newest(d, 2).collect()] == ["c", "b"]


def test_accounts(spark):
    rows = [("reg", float(i * 60)) for i in range(10)] + [("two", 1.0), ("two", 2.0)] + [("same", 5.0)] * 5
    e = spark.createDataFrame(rows, "account string, ts double")
    b = {r.account: r.burstiness for r in bots.burstiness(e).collect()}
    assert b["reg"] == 0 and b["two"] == 0.5 and b["same"] == 0.5
    r = {x.account: x.regularity for x in bots.regularity(e).collect()}
    assert r == {"reg": 1.0, "two": 0.0, "same": 0.0}
    v = {x.account: x.velocity for x in bots.velocity(e).collect()}
    assert v["reg"] == 10 and v["same"] == 5


def test_cloning(spark):
    t = spark.createDataFrame([("a", 1, "x y z"), ("a", 2, "Z Y x"), ("a", 3, "other"), ("b", 1, "alone"), ("c", 1, ""), ("c", 2, "")], "account string, id int, text string")
    for most in (200, None):
        got = {r.account: (r.n_pairs, r.cloning) for r in bots.cloning(t, max_pairs=most).collect()}
        assert got == {"a": (3, pytest.approx(1 / 3)), "b": (0, 0.0), "c": (1, 0.0)}
    many = spark.range(60).select(F.lit("m").alias("account"), "id", F.lit("same words").alias("text"))
    r = bots.cloning(many).first()
    assert r.n_pairs == 200 and r.cloning == 1


def test_bot_score_is_the_mean_of_what_is_there(spark):
    d = spark.createDataFrame([(0.2, 0.6), (None, 0.6), (None, None)], "a double, b double")
    assert [r[0] for r in d.select(bots.bot_score([F.col("a"), F.col("b")])).collect()] == [pytest.approx(0.4), 0.6, 0.0]


def test_edit_patterns_of_nothing(spark):
    e = spark.createDataFrame([], "user string, timestamp string, comment string, tags array<string>, bot boolean, anon boolean, oldlen bigint, newlen bigint")
    assert summary.edit_patterns(e).count() == 0


def test_edit_patterns(spark):
    rows = [("u", "2024-01-01T05:00:00Z", "Undid it", ["mw-undo"], False, False, 10, 4), ("v", "bad", None, None, True, False, 0, 5), ("", "2024-01-01T05:10:00Z", "rv x", [], False, True, None, 3)]
    r = summary.edit_patterns(spark.createDataFrame(rows, "user string, timestamp string, comment string, tags array<string>, bot boolean, anon boolean, oldlen bigint, newlen bigint")).first()
    assert (r.total_edits, r.unique_human_editors, r.hourly_distribution) == (3, 1, {5: 2})
    assert (r.bot_edit_ratio, r.revert_ratio, r.anon_editor_ratio) == pytest.approx((2 / 3, 2 / 3, 1 / 3))


def test_default_score(spark):
    d = spark.createDataFrame([], "date date, smoothed_index double")
    assert summary.latest_score(d).first().score == 41.3
    assert summary.latest_score(d, None).count() == 0


def test_meta(spark):
    old, new = (spark.createDataFrame(r, "key string, value string") for r in ([("a", "1"), ("b", "2")], [("b", "3")]))
    assert dict(summary.upsert_meta(old, new).collect()) == {"a": "1", "b": "3"}
    assert dict(summary.upsert_meta(old, new, keep_old=True).collect()) == {"a": "1", "b": "2"}


def test_bronze_files(spark, tmp_path):
    (tmp_path / "reddit/2024/01").mkdir(parents=True)
    comments = [{"id": "c1", "text": "a comment that is long enough"}, {"id": "c2", "text": "short"}]
    lines = [json.dumps({"id": "1", "text": "  \n", "title": "only title", "comments": []}), "", "BAD", '{"id": "2", "te', json.dumps({"id": "3", "text": "", "title": "T", "comments": comments}), "[1, 2]", json.dumps({"id": "4", "text": None, "title": None})]
    (tmp_path / "reddit/2024/01/a.jsonl").write_text("\n".join(lines))
    (tmp_path / "reddit/top.jsonl").write_text(json.dumps({"id": "5", "text": "at the root", "content_hash": "h"}))
    got = normalise.normalise(bronze.read_bronze(spark, str(tmp_path), "reddit"), "reddit").collect()
    # white space alone does not fall back to the title
    assert sorted((r.text, r.crawl_partition) for r in got) == [("T", "2024/01"), ("a comment that is long enough", "2024/01"), ("at the root", "unknown")]


def test_null_prints_none_and_absent_does_not(spark):
    lines = spark.createDataFrame([('{"question_id": "7", "answer_id": null, "text": "q"}',), ('{"question_id": "7", "text": "q"}',)], "value string").withColumn("partition", F.lit("p"))
    got = sorted(r.content_hash for r in normalise.normalise(bronze.parse_lines(lines, "stackoverflow"), "stackoverflow").collect())
    assert got == ["7:", "7:None"]


def test_unknown_source(spark):
    with pytest.raises(KeyError):
        normalise.normalise(spark.range(1), "elsewhere/x")


def test_missing_registry_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bronze.read_registry(spark, str(tmp_path / "none")).count()


def test_archive_blocks(spark, tmp_path):
    import gzip

    body = "the cat is on the mat and it was not in a box for the day " * 3
    head = "WARC-Type: conversion\r\nWARC-Target-URI: https://www.bbc.com/a\r\nWARC-Date: 2024-01-01T00:00:00Z"
    raw = "".join("WARC/1.0\r\n" + b for b in ("WARC-Type: warcinfo\r\n\r\nx\r\n\r\n", f"{head}\r\n\r\n{body}\r\n\r\n", f"{head}\r\n\r\ntoo short\r\n\r\n", f"{head}\r\n\r\n{body} again\r\n\r\n"))
    (tmp_path / "a.wet.gz").write_bytes(gzip.compress(raw.encode()))
    got = bronze.parse_archive_blocks(bronze.read_archive_blocks(spark, str(tmp_path)), per_file=1).collect()
    assert [(r.domain, r.category, r.text_length) for r in got] == [("bbc.com", "news", len(body.strip()))]


def test_dom_rules():
    page = "<html><nav>menu</nav><div class='post-content x'>" + "<p>Sentence of the story, which goes on for a while here.</p>" * 3 + "<script>no()</script></div><footer>f</footer></html>"
    assert dom.article_body(page).count("Sentence") == 3 and "menu" not in dom.article_body(page)
    assert dom.article_body("<p>short</p>") == "" and dom.article_body(None) == ""
    assert dom.profile_body('<meta property="og:description" content=" hello ">') == "hello"
    assert dom.parse("<ul><li>a<li>b</ul>").text(" ") == "a b"


def test_a_paragraph_below_an_open_bold_word_counts_once():
    """An article of 79 characters whose paragraphs stand below one another: twice their text would pass for an article."""
    short, story = "A word.", "The rest of the story, which goes on a bit further than that, and ends."
    page = f"<article><p><b>{short}<br><p>{story}</p></article>"
    assert len(dom.parse(page).text(" ")) == 79 and dom.article_body(page) == dom.article_body(page, dom.ARCHIVE_BODIES, dom.ARCHIVE_NOISE) == ""
    assert [n.text() for n in dom.parse(page).walk() if n.tag == "p"] == [short, story]
    # blocks end a paragraph, a paragraph in a block ends none around the block
    root = dom.parse("<p>a<i>b<div class=ad><p>c<p>d</div><p>e")
    assert [n.text() for n in root.walk() if n.tag == "p"] == ["ab", "c", "d", "e"]
    root.drop(".ad")
    assert root.text() == "abe"
    assert sum(n.tag == "p" for n in dom.parse("<i><p>x</p>" * 30_000).walk()) == 30_000


def test_html_expressions(spark):
    page = '<meta content="2024-01-01" name="date"><meta property="og:title" content="Big &amp; news"><h1>Other</h1><title>T</title>'
    r = spark.range(1).select(html.title(F.lit(page)), html.published(F.lit(page)), html.clean_post(F.lit("a<br>b &gt; <i>c</i> ")), html.title(F.lit("<p>x</p>")), html.published(F.lit("<p>"))).first()
    assert tuple(r) == ("Big & news", "2024-01-01", "a\nb > c", "", None)


def test_a_cut_reference_stays_as_it_is(spark):
    """A title of which the cut left `&amp`: names count with their semicolon, numbers without one, too."""
    told = "Q &amp; A &quot;x&quot; &#38 &amp"
    page = f"<title>{told}</title><article><h1>{told}</h1><p>{'word ' * 30}</p><script>a&&b</script></article>"
    want = 'Q & A "x" & &amp'
    r = spark.range(1).select(html.title(F.lit(page)), html.strip_tags(F.lit(f"<b>{told}</b>")), html.title(F.lit(f'<meta property="og:title" content="{told}">')), html.unescape(F.lit("&amp"))).first()
    assert tuple(r) == (want, want, want, "&")
    assert dom.article_body(page).split("\n")[0] == want and dom.profile_body(page).endswith("a&&b")
    assert dom.profile_body('<meta property="og:description" content="x &amp y &lt;">') == "x &amp y <"


def test_stream_applies_a_batch_once_and_keeps_ids(spark, tmp_path):
    schema = "doc_id string, date date, source string, category string, aliveness_score double"
    rows = [(str(i), date(2024, 1, 1 + i % 3), "s", "c", float(i)) for i in range(12)]
    sink = incremental.DailyIndexSink(spark, f"file://{tmp_path}/index")
    first, second = spark.createDataFrame(rows[:8], schema), spark.createDataFrame(rows[4:] + [(None, date(2024, 1, 1), "s", "c", 1.0)], schema)
    sink(first, 0)
    sink(first, 0)
    sink(second, 1)
    got = {r.date: (r.n_docs, round(r.mean_score, 9)) for r in sink.read().collect()}
    want = {r.date: (r.n_docs, round(r.mean_score, 9)) for r in index.daily_index(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and sink.read("registry").count() == 12


def test_live_streams_plan(spark, tmp_path):
    spark.createDataFrame([("a", date(2024, 1, 1))], "k string, d date").withColumn("at", F.col("d").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, d date, at timestamp").parquet(str(tmp_path / "in"))
    assert incremental.live_counts(s, "at", "k").isStreaming and incremental.distinct_stream(s, "k", "at").isStreaming


def test_records_are_parsed_once_and_dedup_carries_what_is_wanted(spark):
    from verascope.plans import bronze_queries

    silver = bronze_queries.silver_of(spark, "/root/testdata/sf0.001", "steam")
    plan = silver.select("doc_id", "text_length")._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(x) for x in ("from_json", "StructsToJsonEvaluator", "parseJson", "jsonObjectKeys")] == [1, 1, 1, 0]
    rows = [("s", "h", "a", 2, "late"), ("s", "h", "b", 1, "early"), ("s", "", "c", 3, "alone")]
    d = spark.createDataFrame(rows, "source string, content_hash string, doc_id string, line int, text string")
    kept = dedup.keep_first(d, ["line"], columns=["source", "line"])
    assert kept.columns == ["source", "line"] and sorted(r.line for r in kept.collect()) == [1, 3]
    assert "text" not in kept._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
