"""Captured responses to bronze records; writers."""

import base64
import json
import shutil
import sqlite3
import time
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from verascope.functions import dom
from verascope.plans import payload_queries
from verascope.sources import payloads, sinks, stores
from verascope.streaming import incremental


def bodies(spark, *values, **columns):
    names = list(columns)
    return spark.createDataFrame([(*columns.values(), json.dumps(v)) for v in values], ", ".join([*(f"{n} string" for n in names), "body string"]))


def test_reddit_posts(spark):
    post = lambda **k: {"kind": "t3", "data": {"id": "1", "title": "T", "selftext": "", "permalink": "/r/x/1", "created_utc": 86400.0, **k}}
    page = {"data": {"children": [post(), post(id="2", selftext="body"), post(id="3", title="[removed]"), {"kind": "t1", "data": {"id": "4"}}, post(id="5", selftext="[deleted]")]}}
    got = {r.id: r for r in payloads.reddit_posts(bodies(spark, page)).collect()}
    assert {i: r.text for i, r in got.items()} == {"1": "T", "2": "T\n\nbody", "5": "T"}
    assert got["1"].permalink == "https://reddit.com/r/x/1" and str(got["1"].created_dt) == "1970-01-02 00:00:00"


def test_reddit_comment_trees(spark):
    node = lambda i, text, *kids: {"kind": "t1", "data": {"id": i, "body": text, "replies": {"data": {"children": list(kids)}} if kids else None}}
    long = "a text that is long enough"
    deep = node("d0", long, node("d1", long, node("d2", long, node("d3", long, node("d4", long, node("d5", long))))))
    tree = [node("a", long, node("b", "short"), node("c", long)), {"kind": "more", "data": {"id": "m"}}, node("r", "[removed]"), deep]
    got = payloads.reddit_comments(bodies(spark, tree, post_id="p")).orderBy("path").collect()
    assert [(r.id, r.depth) for r in got] == [("a", 0), ("c", 1), ("d0", 0), ("d1", 1), ("d2", 2), ("d3", 3), ("d4", 4)]
    many = [node(f"x{i:03}", long) for i in range(70)]
    assert payloads.reddit_comments(bodies(spark, many, post_id="p")).count() == 50


def test_atom_feed(spark):
    feed = '<feed><entry><id>t3_1</id><title>A &amp;amp; B</title><content>&lt;p&gt;Hello there&lt;/p&gt;</content><updated>2024-01-01T00:00:00+00:00</updated><author><name>/u/me</name></author><link href="https://reddit.com/r/x/comments/abc/t/"/></entry></feed>'
    r = payloads.atom_entries(spark.createDataFrame([("x", feed)], "subreddit string, body string")).first()
    assert (r.id, r.title, r.text, r.author) == ("abc", "A & B", "Hello there", "me")


def test_hackernews(spark):
    hits = {"hits": [{"objectID": "1", "title": "T", "story_text": "<p>b &amp; c", "url": None, "created_at_i": 5}, {"objectID": "2", "title": "L", "url": "https://Www.site.example/x"}, {"objectID": "3", "title": None}]}
    got = {r.id: r for r in payloads.hackernews_stories(bodies(spark, hits)).collect()}
    assert got["1"].text == "T\n\nb & c" and got["1"].domain == "news.ycombinator.com" and got["2"].domain == "Www.site.example"
    assert set(got) == {"1", "2"}
    comments = {"hits": [{"objectID": str(i), "comment_text": "x" * (10 + i)} for i in range(10)]}
    assert [r.id for r in payloads.hackernews_comments(bodies(spark, comments, story_id="s"), 3).orderBy("id").collect()] == ["5", "6", "7"]


def test_queries_of_comments_and_profiles_keep_what_their_sql_keeps(spark, tmp_path):
    """Short turns, one of them among the first five, and a link that was fetched twice."""
    turns = [(1, t, "user", "short one" if t in (2, 3) else f"turn {t} of some length") for t in range(8)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    page = f"<h1>T &amp x</h1><article>{'word ' * 40}</article>"
    spark.createDataFrame([(i, "http://a.example/x", page) for i in range(2)], "page_id bigint, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name, n in (("payload_hn_comments", 3), ("payload_hn_items", 3), ("payload_profile_articles", 2)):
        got = sorted(tuple(r) for r in payload_queries.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(con.execute(payload_queries.ORACLES[name]).fetchall()) and len(got) == n, name


def test_pages_of_changes_stop_after_the_cap(spark):
    page = {"query": {"recentchanges": [{"title": "t", "newlen": 3}] * 4}}
    d = spark.createDataFrame([(i, json.dumps(page)) for i in range(5)], "page int, body string")
    assert payloads.recent_changes(d, cap=6).select("page").distinct().count() == 2


def test_archive_index(spark):
    rows = [("u", "20200601000000", "200"), ("u", "20200601120000", "200"), ("u", "20200702000000", "200"), ("u", "20200802000000", "404"), ("u", "20200902000000", "200"), ("u", "20201002000000", "200"), ("u", "20201202000000", "200"), ("u", "20180702000000", "200")]
    got = payloads.archive_snapshots(spark.createDataFrame(rows, "url string, timestamp string, status string"), (2019, 2021), 3)
    assert sorted(r.timestamp for r in got.collect()) == ["20200601000000", "20200702000000", "20200902000000"]


def test_short_posts(spark):
    posts = {"posts": [{"uri": "at://a/1", "cid": "c", "author": {"handle": "h"}, "record": {"text": "hi", "langs": ["en", "de"]}}, {"uri": "at://a/1", "record": {"text": "hi"}}, {"uri": "at://a/2", "record": {"text": ""}}]}
    got = payloads.bluesky_posts(bodies(spark, posts, category="social")).collect()
    assert [r.uri for r in got] == ["at://a/1"]
    thread = {"posts": [{"no": 1, "resto": 0, "com": "a<br>b &gt;c", "sub": "S"}, {"no": 2, "resto": 1, "com": ""}, {"no": 3, "resto": 1, "com": "late"}]}
    got = payloads.board_posts(bodies(spark, thread, board="g"), 2).collect()
    assert [(r.post_no, r.is_op, r.text) for r in got] == [(1, True, "a\nb >c")]


def test_reviews_videos_and_tweets(spark):
    names = spark.createDataFrame([("10", "Game")], "app_id string, game_name string")
    page = {"reviews": [{"recommendationid": "r", "review": " good ", "author": {"steamid": "s"}}, {"recommendationid": "e", "review": " "}]}
    d = bodies(spark, page, app_id="10").union(bodies(spark, page, app_id="11"))
    assert {(r.app_id, r.game_name, r.text) for r in payloads.game_reviews(d, names).collect()} == {("10", "Game", "good"), ("11", "11", "good")}
    item = {"items": [{"snippet": {"totalReplyCount": 2, "topLevelComment": {"id": "c", "snippet": {"textDisplay": "<b>nice</b> one", "publishedAt": "2024"}}}}]}
    r = payloads.video_comments(bodies(spark, item, video_id="v", video_title="t", channel_id="c", channel_title="ct")).first()
    assert (r.comment_id, r.comment_text, r.reply_count, r.like_count) == ("c", "nice one", 2, 0)
    assert payloads.tweets(bodies(spark, {"data": [{"id": "7", "text": "x", "public_metrics": {"like_count": 1}}]}, search_term="q")).first().tweet_id == "7"
    m = spark.createDataFrame([("q", "l", None, "<p>text", "a", "now")], "search_term string, link string, title string, description string, author string, published string")
    assert len(payloads.mirrored_tweets(m).first().tweet_id) == 16


def test_questions(spark):
    q = bodies(spark, {"items": [{"question_id": 1, "title": "Q", "body": "<p>ask</p>", "tags": ["t"], "link": "l", "creation_date": 0}, {"question_id": 1, "title": "again"}]}, search_tag="t")
    a = bodies(spark, {"items": [{"answer_id": i, "question_id": 1, "body": f"<p>answer {i}", "score": i} for i in range(4)]})
    got = sorted((r.record_type, r.answer_id, r.title, r.created_at) for r in payloads.questions_and_answers(q.limit(1), a).collect())
    assert [x[:2] for x in got] == [("answer", 2), ("answer", 3), ("question", None)] and all(x[3] is None for x in got)


def test_statuses_and_newsletters(spark):
    s = lambda i, **k: {"id": i, "content": "<p>a text of twenty chars</p>", "account": {"acct": "me"}, "language": "en", **k}
    page = [s("1"), s("1"), s("2", language=None), s("3", language="de"), s("4", reblog={"id": "9"}), s("5", content="short"), s("6", account={"acct": "you@other"})]
    got = {r.status_id: r.author_acct for r in payloads.statuses(bodies(spark, page, instance="i.example")).collect()}
    assert got == {"1": "me@i.example", "2": "me@i.example", "6": "you@other"}
    posts = [{"id": "1", "title": "t", "body_html": "<p>" + "w " * 60}, {"id": "2", "title": "t", "body_html": "", "subtitle": "s " * 60}, {"id": "3", "title": "t", "body_html": "tiny"}]
    assert {r.post_id: r.word_count for r in payloads.newsletters(bodies(spark, posts, publication="p")).collect()} == {"1": 60, "2": 60}


def test_repositories(spark):
    content = base64.b64encode(("é" * 250).encode()).decode()
    d = spark.createDataFrame([("r", 1, None, None, "u", "now", json.dumps({"content": content[:60] + "\n" + content[60:]})), ("s", 1, None, None, "u", "now", json.dumps({"content": "YQ=="}))], "repo_full_name string, stars bigint, language string, description string, url string, pushed_at string, body string")
    got = payloads.readmes(d).collect()
    assert [(r.repo_full_name, len(r.text)) for r in got] == [("r", 250)]
    page = [{"number": i, "title": "T", "body": None if i % 2 else "B", **({"pull_request": {"url": "x"}} if i == 0 else {})} for i in range(9)]
    assert [(r.issue_number, r.text) for r in payloads.issues(bodies(spark, page, repo_full_name="r")).orderBy("issue_number").collect()] == [(1, "T"), (2, "T\n\nB"), (3, "T"), (4, "T\n\nB"), (5, "T")]


def test_articles(spark):
    page = "<h1>Head</h1><article>" + "<p>A sentence of some length for the body.</p>" * 4 + "</article>"
    rows = [("f", i, f"https://www.bbc.com/{i}", page if i else "<p>no") for i in range(3)]
    d = spark.createDataFrame(rows, "feed_url string, position int, url string, html string").withColumns({"published": F.lit("p"), "summary": F.lit("s"), "tags": F.array(F.lit("t"))})
    assert [(r.url, r.title, r.domain) for r in payloads.articles(d, 2).collect()] == [("https://www.bbc.com/1", "Head", "bbc.com")]
    d = spark.createDataFrame([("u", "f", "<article>" + "word " * 40 + "</article>"), ("v", "f", "<p>x")], "url string, source_feed string, html string")
    assert [r.url for r in payloads.profile_articles(d).collect()] == ["u"]


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "doc_id string, n int")
    sinks.write_bronze(d, str(tmp_path / "bronze"), "news/2024/01", "tester", at="now")
    assert spark.read.json(str(tmp_path / "bronze/news/2024/01")).where("_source = 'news/2024/01' and _ingested_at = 'now'").count() == 3
    assert spark.read.parquet(sinks.write_silver(d, str(tmp_path / "silver"), "x/y")).count() == 3
    sinks.write_registry(d, str(tmp_path / "registry"))
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "registry")).collect()] == ["a", "b"]
    t = sinks.VersionedTable(spark, str(tmp_path / "gold"))
    assert t.read() is None
    t.append_latest(d.where("doc_id is not null"), "doc_id", "n")
    t.append_latest(spark.createDataFrame([("b", 9, 0.5)], "doc_id string, n int, score_perplexity double"), "doc_id", "n")
    assert sorted((r.doc_id, r.n, r.score_perplexity) for r in t.read().collect()) == [("a", 1, None), ("b", 9, 0.5)]
    whole, fresh = sinks.insert_new(d.where("n = 1"), d.union(d))
    assert [r.doc_id for r in fresh.collect()] == ["b"] and whole.count() == 2
    old = spark.createDataFrame([("a", datetime(2020, 1, 1))], "doc_id string, scored_at timestamp")
    docs = spark.createDataFrame([("a", None, None), ("b", None, datetime(2021, 1, 1)), ("c", None, None), (None, None, None)], "doc_id string, scored_at timestamp, ingested_at timestamp")
    got = {r.doc_id: r.scored_at.year for r in sinks.slim_registry(docs, old, datetime(2024, 1, 1)).collect()}
    assert got == {"a": 2020, "b": 2021, "c": 2024}


def test_versions_survive_a_crash(spark, tmp_path, monkeypatch):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.range(3))
    monkeypatch.setattr(sinks, "mark", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError, match="stopped"):
        t.replace(spark.range(9))
    monkeypatch.undo()
    assert t.read().count() == 3
    t.replace(spark.range(5))
    assert t.read().count() == 5
    shutil.rmtree(tmp_path / "t/2")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        t.read()


def test_stream_merges_segments_of_ids(spark, tmp_path):
    sink = incremental.DailyIndexSink(spark, str(tmp_path / "index"))
    rows = lambda ids: spark.createDataFrame([(str(i), date(2024, 1, 1), "s", "c", float(i)) for i in ids], "doc_id string, date date, source string, category string, aliveness_score double")
    for n in range(8):
        for _ in range(2):
            sink(rows([n, n + 1, n]), n)
    assert sorted(int(r.doc_id) for r in sink.read("registry").collect()) == list(range(9))
    r = sink.read().first()
    assert (r.n_docs, r.median_score, r.mean_score) == (9, 4.0, 4.0) and len(sink.known.segments(8)) < 6


def test_snapshots_and_progress(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("CREATE TABLE d (a)")
    con.executemany("INSERT INTO d VALUES (?)", [(i,) for i in range(5)])
    con.commit()
    path = stores.snapshot_path((tmp_path / "x.db").read_bytes(), "r1", str(tmp_path))
    assert stores.snapshot_query(spark, path, "SELECT a FROM d WHERE a > ?", "a bigint", (2,)).count() == 2
    with pytest.raises(ValueError, match="over 3"):
        stores.snapshot_query(spark, path, "SELECT a FROM d", "a bigint", most=3)
    with pytest.raises(sqlite3.OperationalError):
        stores.snapshot_query(spark, path, "DELETE FROM d RETURNING a", "a bigint")


def test_deep_pages_drop_in_linear_time():
    began = time.process_time()
    root = dom.parse("<div>" + "<aside>x</aside><p>y</p>" * 30_000)
    root.drop("aside")
    assert root.text() == "y" * 30_000 and time.process_time() - began < 20
