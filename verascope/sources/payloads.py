"""Captured responses of the collectors' services as bronze records: one function per service, DataFrame to DataFrame.

Fetching is outside of an analytics engine; what was fetched is a table of response bodies (column `body`, with the
request's own parameters as further columns), and these functions do the collectors' filtering and flattening on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verascope.functions import html
from verascope.functions.scalars import ARCHIVE_CATEGORIES, archive_time, content_hash, decoded, host, host_category, short_sha1, strip, text_or_empty, titled, unix_time, word_count
from verascope.operators.dedup import head_per_group

#: Texts that stand for removed ones.
REMOVED = ("[deleted]", "[removed]", "")
COMMENT_DEPTH, COMMENT_CAP = 4, 50


def _items(df: DataFrame, schema: str, path: str = "") -> DataFrame:
    """A row per element of the array at path in body, as struct `x` beside the request's columns."""
    parsed = df.withColumn("_j", F.from_json("body", schema))
    others = [c for c in df.columns if c != "body"]
    return parsed.select(*others, F.posexplode(F.col(f"_j.{path}" if path else "_j")).alias("pos", "x"))


def _comment_schema(depth: int) -> str:
    """Comment listings nested to a depth; the replies of the deepest are left unread."""
    leaf = "id: string, body: string, author: string, score: bigint, created_utc: double, controversiality: int"
    inner = f"{leaf}" if depth == 0 else f"{leaf}, replies: struct<data: struct<children: array<struct<kind: string, data: struct<{_comment_schema(depth - 1)}>>>>>"
    return inner


def reddit_posts(df: DataFrame) -> DataFrame:
    """Listing bodies (subreddit, body) to posts: kind t3, neither title nor text removed."""
    schema = (
        "data struct<children: array<struct<kind: string, data: struct<id: string, title: string, selftext: string, url: string, permalink: string, author: string, subreddit: string, score: bigint, "
        "upvote_ratio: double, num_comments: bigint, created_utc: double, link_flair_text: string, is_self: boolean, domain: string>>>>"
    )
    d = _items(df.select("body"), schema, "data.children").where("x.kind = 't3'").select("x.data.*")
    body = F.when(F.col("selftext").isin(*REMOVED), "").otherwise(F.col("selftext"))
    text = strip(titled(F.col("title"), body))
    d = d.where(~F.coalesce("title", F.lit("")).isin("[deleted]", "[removed]"))
    return d.select(
        "id", F.substring("title", 1, 300).alias("title"), F.substring(text, 1, 5000).alias("text"), F.length(text).cast("long").alias("text_length"), "url", F.concat(F.lit("https://reddit.com"), "permalink").alias("permalink"), "author", "subreddit", "score", "upvote_ratio",
        "num_comments", "created_utc", unix_time(F.col("created_utc")).alias("created_dt"), F.col("link_flair_text").alias("flair"), "is_self", "domain", content_hash(text).alias("content_hash"),
    )


def reddit_comments(df: DataFrame) -> DataFrame:
    """Comment trees (post_id, body: the listing's children) in pre-order: kind t1, depth 4 at most, over 10 characters, 50 a post.

    The depth is bounded, so each level is an explode; a path of positions keeps the order.
    """
    schema = f"array<struct<kind: string, data: struct<{_comment_schema(COMMENT_DEPTH)}>>>"
    level = df.select("post_id", F.posexplode(F.from_json("body", schema)).alias("p", "c")).select("post_id", F.array("p").alias("path"), "c")
    out: DataFrame | None = None
    for depth in range(COMMENT_DEPTH + 1):
        here = level.where("c.kind = 't1'")
        fields = [F.col(f"c.data.{k}").alias(k) for k in ("id", "body", "author", "score", "created_utc", "controversiality")]
        rows = here.select("post_id", "path", F.lit(depth).alias("depth"), *fields)
        out = rows if out is None else out.unionByName(rows)
        if depth < COMMENT_DEPTH:
            level = here.select("post_id", "path", F.posexplode("c.data.replies.data.children").alias("p", "k")).select("post_id", F.concat("path", F.array("p")).alias("path"), F.col("k").alias("c"))
    text = strip(F.coalesce("body", F.lit("")))
    out = out.withColumn("text", text).where((F.length("text") > 10) & ~F.col("text").isin(*REMOVED))
    return head_per_group(out, ["post_id"], ["path"], COMMENT_CAP).select(
        "post_id", "id", F.substring("text", 1, 2000).alias("text"), "author", "score", "created_utc", unix_time(F.col("created_utc")).alias("created_dt"), "depth", "controversiality", content_hash(F.col("text")).alias("content_hash"), "path"
    )


def atom_entries(df: DataFrame) -> DataFrame:
    """Atom feeds (subreddit, body) to posts without comments: the fallback where the listing is closed."""
    entry = F.from_xml("body", "entry array<struct<id: string, title: string, content: string, updated: string, author: struct<name: string>, link: struct<_href: string>>>", {"rowTag": "feed", "valueTag": "_VALUE"})
    d = df.select("subreddit", F.explode(entry["entry"]).alias("e")).select("subreddit", "e.*")
    text = html.strip_tags(html.unescape(F.coalesce("content", F.lit(""))))
    return d.select(
        F.regexp_extract("link._href", r"/comments/([^/]+)", 1).alias("id"), F.substring(html.unescape(F.col("title")), 1, 300).alias("title"), F.substring(text, 1, 5000).alias("text"), F.col("link._href").alias("permalink"),
        F.regexp_replace("author.name", "^/u/", "").alias("author"), "subreddit", F.col("updated").alias("created_dt"), content_hash(text).alias("content_hash"),
    )


def hackernews_stories(df: DataFrame) -> DataFrame:
    """Search pages to stories: title and text together, host of the link or the site's own."""
    schema = "hits array<struct<objectID: string, title: string, story_text: string, url: string, author: string, points: bigint, num_comments: bigint, created_at: string, created_at_i: bigint, _tags: array<string>>>"
    d = _items(df.select("body"), schema, "hits").select("x.*")
    text = strip(titled(F.col("title"), html.strip_tags(F.coalesce("story_text", F.lit("")))))
    link = F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID")
    site = host(F.col("url"), lower=False)
    return d.where(text != "").select(
        F.col("objectID").alias("id"), "title", F.substring(text, 1, 5000).alias("text"), F.length(text).cast("long").alias("text_length"), "url", link.alias("hn_url"), "author", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
        F.col("created_at_i").cast("double").alias("created_utc"), unix_time(F.col("created_at_i")).alias("created_dt"), F.col("_tags").alias("tags"), F.when(site != "", site).otherwise("news.ycombinator.com").alias("domain"), content_hash(text).alias("content_hash"),
    )


def _comment_text(raw: Column, least: int = 15, shown: bool = False) -> tuple[Column, Column]:
    """(text, whether it counts): `least` characters and more as sent, or, if shown, without tags; tags go where there are any."""
    sent = strip(text_or_empty(raw))
    counted = F.regexp_replace(text_or_empty(raw), r"<[^>]*>", "") if shown else sent
    return F.when(F.contains(sent, F.lit("<")), html.strip_tags(sent)).otherwise(sent), F.length(counted) >= least


def hackernews_comments(df: DataFrame, per_story: int = 20, shown: bool = False, per_page: int | None = None) -> DataFrame:
    """Search pages of comments (story_id, body): 15 characters and more (shown: tags not counted), tags gone, cut at 2000.

    per_story: comments that count; per_page: hits that were asked for, whether they count or not.
    """
    schema = "hits array<struct<objectID: string, comment_text: string, author: string, points: bigint, created_at_i: bigint>>"
    d = _items(df.select("story_id", "body"), schema, "hits").select("story_id", "pos", "x.*")
    d = d if per_page is None else d.where(F.col("pos") < per_page)
    text, counts = _comment_text(F.col("comment_text"), shown=shown)
    d = head_per_group(d.withColumn("text", text).where(counts), ["story_id"], ["pos"], per_story)
    return d.select(
        "story_id", F.col("objectID").alias("id"), F.substring("text", 1, 2000).alias("text"), "author", F.coalesce("points", F.lit(0)).alias("score"), F.col("created_at_i").cast("double").alias("created_utc"), unix_time(F.col("created_at_i")).alias("created_dt"), content_hash(F.col("text")).alias("content_hash")
    )


def hackernews_items(df: DataFrame, per_story: int = 20, least: int = 15) -> DataFrame:
    """Single comments of the item service (story_id, position, body), the first asked for of each story; deleted and dead ones go,
    and those of under `least` characters."""
    schema = "id bigint, by string, text string, time bigint, score bigint, deleted boolean, dead boolean"
    d = head_per_group(df, ["story_id"], ["position"], per_story).select("story_id", F.from_json("body", schema).alias("x")).select("story_id", "x.*")
    text, counts = _comment_text(F.col("text"), least)
    d = d.where(~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False))).withColumns({"_text": text, "_counts": counts}).where("_counts")
    return d.select(
        "story_id", F.col("id").cast("string").alias("id"), F.substring("_text", 1, 2000).alias("text"), text_or_empty(F.col("by")).alias("author"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("time", F.lit(0)).cast("double").alias("created_utc"),
        unix_time(F.when(F.col("time") > 0, F.col("time"))).alias("created_dt"), content_hash(F.col("_text")).alias("content_hash"),
    )


def random_titles(df: DataFrame, count: int) -> DataFrame:
    """Pages of drawn articles (page, body) to their first `count` titles, in order."""
    d = _items(df, "query struct<random: array<struct<id: bigint, title: string>>>", "query.random")
    return d.orderBy("page", "pos").limit(count).select("x.title")


def wiki_articles(df: DataFrame, min_chars: int = 80, max_chars: int = 5000) -> DataFrame:
    """Article answers (body) with text of min_chars and more, cut at max_chars; hash and length are those of the whole text."""
    revision = "struct<revid: bigint, user: string, timestamp: string, size: bigint, tags: array<string>>"
    schema = f"query struct<pages: array<struct<pageid: bigint, title: string, missing: boolean, canonicalurl: string, extract: string, revisions: array<{revision}>>>>"
    d = df.select(F.get(F.from_json("body", schema)["query"]["pages"], F.lit(0)).alias("x")).select("x.*").where("pageid is not null and not coalesce(missing, false)")
    d = d.withColumn("_text", strip(text_or_empty(F.col("extract")))).where(F.length("_text") >= min_chars)
    last = lambda k: text_or_empty(F.get("revisions", F.lit(0))[k])
    return d.select(
        text_or_empty(F.col("title")).alias("title"), "pageid", text_or_empty(F.col("canonicalurl")).alias("url"), F.substring("_text", 1, max_chars).alias("text"), F.length("_text").cast("long").alias("text_length"), F.lit("wiki").alias("category"), F.lit("en.wikipedia.org").alias("domain"),
        F.coalesce("revisions", F.array().cast(f"array<{revision}>")).alias("revisions"), last("user").alias("last_editor"), last("timestamp").alias("last_edit_ts"), content_hash(F.col("_text")).alias("content_hash"),
    )


def recent_changes(df: DataFrame, cap: int = 10_000) -> DataFrame:
    """Pages of changes (page, body) up to the page with which the cap is reached."""
    schema = "query struct<recentchanges: array<struct<title: string, user: string, timestamp: string, comment: string, tags: array<string>, bot: boolean, anon: boolean, oldlen: bigint, newlen: bigint>>>"
    d = _items(df, schema, "query.recentchanges")
    sizes = d.groupBy("page").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.page") < F.col("a.page"), "left").groupBy("a.page").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))  # pages of one run: a few dozen
    return d.join(before, "page").where(F.col("before") < cap).select("page", "pos", "x.*")


def archive_snapshots(df: DataFrame, years: tuple[int, int], per_year: int = 3) -> DataFrame:
    """Index rows (url, timestamp, status) of June to November, status 200, one a day, the first few of each year."""
    day, year = F.substring("timestamp", 1, 8), F.substring("timestamp", 1, 4).cast("int")
    d = df.where((F.col("status") == "200") & year.between(*years) & F.substring("timestamp", 5, 2).between("06", "11"))
    first = head_per_group(d.withColumns({"_day": day, "_year": year}), ["url", "_day"], ["timestamp"], 1)
    return head_per_group(first, ["url", "_year"], ["timestamp"], per_year).drop("_day", "_year")


def archived_pages(df: DataFrame, min_chars: int = 80, max_chars: int = 5000, root: str = "https://web.archive.org/web") -> DataFrame:
    """Snapshots (url, timestamp, status, content_type, html) that came back as pages with a body of min_chars and more."""
    d = df.where("status = 200 and (content_type like '%html%' or content_type like '%text%')").withColumn("_text", html.archived_body("html")).where(F.length("_text") >= min_chars)
    at = archive_time(F.col("timestamp"))
    return d.select(
        F.col("url").alias("sentinel_url"), F.concat(F.lit(f"{root}/"), "timestamp", F.lit("/"), "url").alias("wayback_url"), "timestamp", F.try_to_timestamp(F.substring("timestamp", 1, 14), F.lit("yyyyMMddHHmmss")).alias("snapshot_date"), F.year(at).alias("snapshot_year"),
        host(F.col("url"), lower=False).alias("domain"), host_category(host(F.col("url"), lower=False), ARCHIVE_CATEGORIES).alias("category"), F.substring("_text", 1, max_chars).alias("text"), F.length("_text").cast("long").alias("text_length"), content_hash(F.col("_text")).alias("content_hash"),
    )


def bluesky_posts(df: DataFrame, cap: int = 500) -> DataFrame:
    """Search pages (category, body) to distinct posts, cap a run."""
    schema = "posts array<struct<uri: string, cid: string, author: struct<did: string, handle: string>, record: struct<text: string, createdAt: string, langs: array<string>>, likeCount: bigint, repostCount: bigint, replyCount: bigint>>"
    d = _items(df.select("category", "body"), schema, "posts").select("category", "x.*").where(text_or_empty(F.col("record.text")) != "")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return d.dropDuplicates(["uri"]).select(
        "uri", "cid", F.col("author.did").alias("author_did"), F.col("author.handle").alias("author_handle"), F.col("record.text").alias("text"), F.col("record.createdAt").alias("created_at"), zero("likeCount").alias("like_count"), zero("repostCount").alias("repost_count"),
        zero("replyCount").alias("reply_count"), F.array_join(F.coalesce("record.langs", F.array()), ",").alias("langs"), "category",
    ).orderBy("uri").limit(cap)


def board_posts(df: DataFrame, per_thread: int = 20) -> DataFrame:
    """Threads (board, body) to the first posts of each; posts without text go."""
    schema = "posts array<struct<no: bigint, resto: bigint, sub: string, com: string, time: bigint, country: string, filename: string, replies: bigint>>"
    d = _items(df.select("board", "body"), schema, "posts").withColumn("thread_no", F.when(F.col("x.resto") > 0, F.col("x.resto")).otherwise(F.col("x.no")))
    d = head_per_group(d, ["board", "thread_no"], ["pos"], per_thread)
    text = html.clean_post(F.col("x.com"))
    return d.where(text != "").select(
        "board", "thread_no", F.col("x.no").alias("post_no"), (F.col("x.resto") == 0).alias("is_op"), html.clean_post(F.col("x.sub")).alias("subject"), text.alias("text"), F.col("x.time").alias("timestamp"), text_or_empty(F.col("x.country")).alias("country"),
        text_or_empty(F.col("x.filename")).alias("filename"), F.coalesce("x.replies", F.lit(0)).alias("replies_count"), F.lit("forum").alias("category"),
    )


def game_reviews(df: DataFrame, names: DataFrame) -> DataFrame:
    """Review pages (app_id, body) with names (app_id, game_name); an unknown app is named by its id."""
    schema = "reviews array<struct<recommendationid: string, author: struct<steamid: string, playtime_forever: bigint>, review: string, language: string, timestamp_created: bigint, voted_up: boolean, votes_up: bigint, votes_funny: bigint, received_for_free: boolean>>"
    d = _items(df.select("app_id", "body"), schema, "reviews").select("app_id", "x.*").where(strip(text_or_empty(F.col("review"))) != "")
    return d.join(names, "app_id", "left").select(
        "app_id", F.coalesce("game_name", F.col("app_id").cast("string")).alias("game_name"), F.col("recommendationid").alias("review_id"), F.col("author.steamid").alias("author_steam_id"), strip(F.col("review")).alias("text"), "language", "timestamp_created", "voted_up", "votes_up", "votes_funny",
        F.col("author.playtime_forever").alias("playtime_forever"), "received_for_free", F.lit("social").alias("category"),
    )


def video_comments(df: DataFrame) -> DataFrame:
    """Comment threads (video_id, video_title, channel_id, channel_title, body) to their top comments."""
    schema = "items array<struct<snippet: struct<totalReplyCount: bigint, topLevelComment: struct<id: string, snippet: struct<textDisplay: string, authorChannelId: struct<value: string>, likeCount: bigint, publishedAt: string>>>>>"
    d = _items(df, schema, "items").withColumn("c", F.col("x.snippet.topLevelComment"))
    text = html.strip_tags(F.col("c.snippet.textDisplay"))
    return d.where(text != "").select(
        "video_id", "video_title", "channel_id", "channel_title", F.col("c.id").alias("comment_id"), text.alias("comment_text"), text_or_empty(F.col("c.snippet.authorChannelId.value")).alias("author_channel_id"), F.coalesce("c.snippet.likeCount", F.lit(0)).alias("like_count"), F.col("c.snippet.publishedAt").alias("published_at"),
        F.coalesce("x.snippet.totalReplyCount", F.lit(0)).alias("reply_count"), F.lit("social").alias("category"),
    )


def profile_articles(df: DataFrame, cap: int = 100, distinct: bool = True) -> DataFrame:
    """Pages (url, source_feed, html) of a professional network: distinct links (or each fetch of them), 100 characters and more, cap
    accepted ones."""
    d = (df.dropDuplicates(["url"]) if distinct else df).withColumn("text", html.profile_body("html")).where(F.length("text") >= 100)
    return d.select("url", F.substring(html.title(F.col("html")), 1, 300).alias("title"), F.substring("text", 1, 5000).alias("text"), F.lit("").alias("published_at"), "source_feed", F.lit("professional").alias("category")).orderBy("url").limit(cap)


def tweets(df: DataFrame) -> DataFrame:
    """Search pages (search_term, body) of the official service."""
    schema = "data array<struct<id: string, text: string, author_id: string, created_at: string, lang: string, source: string, public_metrics: struct<like_count: bigint, retweet_count: bigint, reply_count: bigint>>>"
    d = _items(df.select("search_term", "body"), schema, "data").select("search_term", "x.*")
    return d.select("id", "text", "author_id", "created_at", "public_metrics.*", "lang", F.col("source").alias("source_app"), F.lit(False).alias("is_nitter"), "search_term", F.lit("social").alias("category")).withColumnRenamed("id", "tweet_id")


def mirrored_tweets(df: DataFrame) -> DataFrame:
    """Feed items (search_term, link, title, description, author, published) of a mirror; ids come of link and text."""
    text = html.strip_tags(F.coalesce("description", "title", F.lit("")), decoder=html.unescape)
    ident = short_sha1(F.concat(text_or_empty(F.col("link")), F.substring(text, 1, 40)), 16)
    return df.where(text != "").select(ident.alias("tweet_id"), text.alias("text"), text_or_empty(F.col("author")).alias("author_id"), F.col("published").alias("created_at"), F.lit(True).alias("is_nitter"), "search_term", F.lit("social").alias("category"))


def questions_and_answers(questions: DataFrame, answers: DataFrame, per_question: int = 2) -> DataFrame:
    """Distinct questions (search_tag, body) and the best answers (body), which take title, tags and link of theirs."""
    owner = "owner: struct<reputation: bigint>"
    q = _items(questions.select("search_tag", "body"), f"items array<struct<question_id: bigint, title: string, body: string, tags: array<string>, score: bigint, is_answered: boolean, view_count: bigint, answer_count: bigint, creation_date: bigint, link: string, {owner}>>", "items").select("search_tag", "x.*").dropDuplicates(["question_id"])
    a = _items(answers.select("body"), f"items array<struct<answer_id: bigint, question_id: bigint, body: string, score: bigint, is_accepted: boolean, creation_date: bigint, {owner}>>", "items").select("x.*")
    a = head_per_group(a, ["question_id"], [F.desc("score"), F.col("answer_id")], per_question)
    common = lambda kind, text, accepted, answer: [
        "question_id", answer.alias("answer_id"), F.lit(kind).alias("record_type"), html.unescape(F.col("title")).alias("title"), F.substring(text, 1, 5000).alias("text"), "tags", "score", accepted.alias("is_accepted"), F.coalesce("view_count", F.lit(0)).alias("view_count"), F.coalesce("answer_count", F.lit(0)).alias("answer_count"),
        F.col("owner.reputation").alias("owner_reputation"), unix_time(F.when(F.col("creation_date") > 0, F.col("creation_date"))).alias("created_at"), F.col("link").alias("url"), F.lit("qa").alias("category"), "search_tag",
    ]
    asked = q.select(*common("question", html.strip_tags(F.col("body")), F.lit(False), F.lit(None).cast("bigint")))
    parent = q.select("question_id", "title", "tags", "view_count", "answer_count", "link", "search_tag")
    answered = a.join(parent, "question_id").select(*common("answer", html.strip_tags(F.col("body")), F.coalesce("is_accepted", F.lit(False)), F.col("answer_id")))
    return asked.unionByName(answered).where("text <> ''")


def statuses(df: DataFrame) -> DataFrame:
    """Timelines (instance, body): no boosts, English or no language, 20 characters and more, each id once, accounts with their instance."""
    schema = "array<struct<id: string, content: string, account: struct<acct: string>, created_at: string, language: string, url: string, replies_count: bigint, reblogs_count: bigint, favourites_count: bigint, reblog: struct<id: string>, tags: array<struct<name: string>>>>"
    d = _items(df.select("instance", "body"), schema).select("instance", "x.*").where("reblog is null and coalesce(language, '') in ('', 'en')")
    text = html.strip_tags(F.col("content"))
    acct = F.when(F.contains("account.acct", F.lit("@")), F.col("account.acct")).otherwise(F.concat("account.acct", F.lit("@"), "instance"))
    return d.where(F.length(text) >= 20).dropDuplicates(["id"]).select(
        F.col("id").alias("status_id"), text.alias("text"), acct.alias("author_acct"), "instance", "created_at", text_or_empty(F.col("language")).alias("language"), "url", "replies_count", "reblogs_count", "favourites_count", F.transform("tags", lambda t: t["name"]).alias("tags"), F.lit("social").alias("category")
    )


def newsletters(df: DataFrame) -> DataFrame:
    """Archive pages (publication, body): text of the page or the subtitle, 100 characters and more."""
    schema = "array<struct<id: string, title: string, subtitle: string, body_html: string, canonical_url: string, post_date: string, publishedBylines: array<struct<name: string>>>>"
    d = _items(df.select("publication", "body"), schema).select("publication", "x.*")
    page = html.strip_tags(F.col("body_html"))
    text = F.when(page != "", page).otherwise(text_or_empty(F.col("subtitle")))
    return d.where(F.length(text) >= 100).select(
        F.coalesce(F.nullif("id", F.lit("")), short_sha1(text_or_empty(F.col("canonical_url")))).alias("post_id"), "publication", F.substring("title", 1, 300).alias("title"), F.substring(text, 1, 5000).alias("text"), text_or_empty(F.get("publishedBylines", F.lit(0))["name"]).alias("author"), F.col("post_date").alias("published_at"),
        F.col("canonical_url").alias("url"), word_count(text).alias("word_count"), F.lit("blog").alias("category"),
    )


def readmes(df: DataFrame) -> DataFrame:
    """Repositories (repo_full_name, stars, language, description, url, pushed_at, body: the readme's answer), 200 characters and more, each once."""
    text = strip(decoded(F.get_json_object("body", "$.content")))
    d = df.dropDuplicates(["repo_full_name"]).withColumn("text", text).where(F.length("text") >= 200)
    return d.select("repo_full_name", F.lit("readme").alias("record_type"), F.col("repo_full_name").alias("title"), F.substring("text", 1, 8000).alias("text"), "stars", "language", text_or_empty(F.col("description")).alias("description"), "url", "pushed_at", F.lit("code_doc").alias("category"))


def issues(df: DataFrame, per_repo: int = 5) -> DataFrame:
    """Issue pages (repo_full_name, body): pull requests left out, title and body, cut at 3000."""
    schema = "array<struct<number: bigint, title: string, body: string, user: struct<login: string>, created_at: string, state: string, html_url: string, labels: array<struct<name: string>>, pull_request: struct<url: string>>>"
    d = _items(df.select("repo_full_name", "body"), schema).select("repo_full_name", "pos", "x.*").where("pull_request is null")
    d = head_per_group(d, ["repo_full_name"], ["pos"], per_repo)
    text: Column = strip(titled(F.col("title"), F.col("body")))
    return d.where(text != "").select(
        "repo_full_name", F.lit("issue").alias("record_type"), F.col("number").alias("issue_number"), F.substring("title", 1, 300).alias("title"), F.substring(text, 1, 3000).alias("text"), F.col("html_url").alias("url"), F.col("user.login").alias("author"), "created_at", "state", F.transform("labels", lambda x: x["name"]).alias("labels"),
        F.lit("code_doc").alias("category"),
    )


def articles(df: DataFrame, per_feed: int = 20) -> DataFrame:
    """Feed entries (feed_url, position, url, title, published, summary, tags, html) with their fetched pages, the first of each feed."""
    d = head_per_group(df, ["feed_url"], ["position"], per_feed).withColumn("_body", html.article_body("html")).where("_body <> ''")
    return d.select(
        "url", host(F.col("url")).alias("domain"), F.substring(html.title(F.col("html")), 1, 300).alias("title"), F.substring("_body", 1, 5000).alias("text"), F.length("_body").cast("long").alias("text_length"), html.published(F.col("html")).alias("pub_date"), content_hash(F.col("_body")).alias("content_hash"), "feed_url",
        F.col("published").alias("feed_published"), F.substring("summary", 1, 500).alias("feed_summary"), F.col("tags").alias("feed_tags"), F.lit("news").alias("category"),
    )
