"""Bronze records to silver documents: one projection per source, comments exploded, all united by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verascope.functions.scalars import WHITE_SPACE, any_time, doc_id, either, last_segment, strip, unix_time

SILVER_COLUMNS = ("doc_id", "source", "category", "domain", "url", "title", "text", "text_length", "author", "created_dt", "crawl_partition", "ingested_at", "content_hash")


def _r(name: str) -> Column:
    """A field of the record as text; absent and null: empty."""
    return F.coalesce(F.col(f"raw.{name}").cast("string"), F.lit(""))


def _or(name: str, default: Column | str) -> Column:
    """A field, or the default where it is absent or null; an empty field stays empty."""
    return F.coalesce(F.col(f"raw.{name}").cast("string"), F.lit(default) if isinstance(default, str) else default)


def _printed(name: str, absent: str = "") -> Column:
    """A field as printed: null prints None, absent prints the default."""
    there = F.array_contains("keys", name)
    return F.when(F.col(f"raw.{name}").isNotNull(), F.col(f"raw.{name}").cast("string")).when(there, "None").otherwise(absent)


def _silver(
    df: DataFrame, source: str, text: Column, ident: Column, *, category: Column | str, domain: Column | str, url: Column | str = "", title: Column | str = "", author: Column | str = "",
    created: Column | None = None, content: Column | str = "", id_source: str | None = None, partition: Column | None = None, longer_than: int = 0, white: str = WHITE_SPACE,
) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    # exploded, so that the filter does not strip the text a second time
    d = df.withColumn("_text", F.explode(F.array(strip(F.coalesce(text, F.lit("")), white)))).where(F.length("_text") > longer_than)
    extra = [c for c in ("file", "line", "position") if c in d.columns]
    return d.select(
        doc_id(id_source or source, ident, F.col("_text")).alias("doc_id"), F.lit(source).alias("source"), lit(category).alias("category"), lit(domain).alias("domain"), lit(url).alias("url"), lit(title).alias("title"),
        F.col("_text").alias("text"), F.length("_text").cast("long").alias("text_length"), lit(author).alias("author"), (F.lit(None).cast("timestamp") if created is None else created).alias("created_dt"),
        (F.col("partition") if partition is None else partition).alias("crawl_partition"), _r("_ingested_at").alias("ingested_at"), lit(content).alias("content_hash"), *extra,
    )


def _comments(df: DataFrame, source: str, id_source: str, domain: str, url: Column, white: str) -> DataFrame:
    """A document per comment of more than 15 characters."""
    keep = [c for c in ("file", "line", "keys") if c in df.columns]
    c = df.select("raw", "partition", *keep, F.posexplode("raw.comments").alias("_p", "c")).withColumn("position", F.col("_p") + 1)
    of = lambda k: F.coalesce(F.col(f"c.{k}"), F.lit(""))
    return _silver(c, source, of("text"), of("id"), category="social", domain=domain, url=url, author=of("author"), created=any_time(F.col("c.created_dt")), content=of("content_hash"), id_source=id_source, longer_than=15, white=white)


def _posts_and_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    return posts.withColumn("position", F.lit(0)).unionByName(comments, allowMissingColumns=True)


def common_crawl(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    return _silver(df, "common_crawl", _r("text"), _r("url"), category=_or("category", "web"), domain=_r("domain"), url=_r("url"), created=any_time(_r("date")), content=_r("content_hash"), white=white)


def reddit(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    posts = _silver(df, "reddit", either(_r("text"), _r("title")), _r("id"), category="social", domain="reddit.com", url=_r("permalink"), title=_r("title"), author=_r("author"), created=any_time(_r("created_dt")), content=_r("content_hash"), white=white)
    return _posts_and_comments(posts, _comments(df, "reddit", "reddit_comment", "reddit.com", _r("permalink"), white))


def news(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    return _silver(df, "news", _r("text"), _r("url"), category="news", domain=_r("domain"), url=_r("url"), title=_r("title"), created=any_time(either(_r("pub_date"), _r("feed_published"))), content=_r("content_hash"), white=white)


def wikipedia(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    articles = df.where("raw.type = 'article_sample'")
    return _silver(articles, "wikipedia", _r("text"), _r("pageid"), category="wiki", domain="en.wikipedia.org", url=_r("url"), title=_r("title"), author=_r("last_editor"), created=any_time(_r("last_edit_ts")), content=_r("content_hash"), white=white)


def hackernews(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    site = "news.ycombinator.com"
    stories = _silver(df, "hackernews", either(_r("text"), _r("title")), _r("id"), category="social", domain=_or("domain", site), url=_or("hn_url", _r("url")), title=_r("title"), author=_r("author"), created=any_time(_r("created_dt")), content=_r("content_hash"), white=white)
    return _posts_and_comments(stories, _comments(df, "hackernews", "hn_comment", site, _r("hn_url"), white))


def wayback(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    ident = F.concat(_printed("sentinel_url"), F.lit(":"), _printed("snapshot_year"))
    year = F.coalesce(F.col("raw.snapshot_year"), F.when(F.array_contains("keys", "snapshot_year"), "None").otherwise(F.col("partition")))
    return _silver(df, "wayback", _r("text"), ident, category=_or("category", "web"), domain=_r("domain"), url=_or("wayback_url", _r("sentinel_url")), title=_r("sentinel_url"), created=any_time(_r("snapshot_date")), content=_r("content_hash"), partition=year, white=white)


def bluesky(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    url = F.concat(F.lit("https://bsky.app/profile/"), _r("author_handle"), F.lit("/post/"), last_segment(_r("uri")))
    return _silver(df, "bluesky", _r("text"), _r("uri"), category="social", domain="bsky.app", url=url, author=_r("author_handle"), created=any_time(_r("created_at")), content=_r("cid"), white=white)


def fourchan(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    url = F.concat(F.lit("https://boards.4chan.org/"), _printed("board"), F.lit("/thread/"), _printed("thread_no"))
    return _silver(df, "fourchan", _r("text"), F.concat(_printed("board"), F.lit("/"), _printed("post_no")), category="forum", domain="4chan.org", url=url, title=_r("subject"), author=_r("country"), created=unix_time(F.col("raw.timestamp")), white=white)


def steam(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    url = F.concat(F.lit("https://store.steampowered.com/app/"), _printed("app_id"))
    return _silver(df, "steam", _r("text"), _r("review_id"), category="social", domain="store.steampowered.com", url=url, title=_r("game_name"), author=_r("author_steam_id"), created=unix_time(F.col("raw.timestamp_created")), content=_r("review_id"), white=white)


def youtube(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    url = F.concat(F.lit("https://www.youtube.com/watch?v="), _printed("video_id"))
    return _silver(df, "youtube", _r("comment_text"), _r("comment_id"), category="social", domain="youtube.com", url=url, title=_r("video_title"), author=_r("author_channel_id"), created=any_time(_r("published_at")), content=_r("comment_id"), white=white)


def linkedin(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    return _silver(df, "linkedin", _r("text"), _r("url"), category="professional", domain="linkedin.com", url=_r("url"), title=_r("title"), created=any_time(_r("published_at")), white=white)


def twitter(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    return _silver(df, "twitter", _r("text"), _r("tweet_id"), category="social", domain="x.com", author=_r("author_id"), created=any_time(_r("created_at")), content=_r("tweet_id"), white=white)


def stackoverflow(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    ident = F.concat(_printed("question_id"), F.lit(":"), _printed("answer_id"))
    return _silver(df, "stackoverflow", _r("text"), ident, category="qa", domain="stackoverflow.com", url=_r("url"), title=_r("title"), author=_printed("owner_reputation"), created=any_time(_r("created_at")), content=ident, white=white)


def mastodon(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    return _silver(df, "mastodon", _r("text"), _r("status_id"), category="social", domain=_or("instance", "mastodon.social"), url=_r("url"), author=_r("author_acct"), created=any_time(_r("created_at")), content=_r("status_id"), white=white)


def substack(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    return _silver(df, "substack", _r("text"), _r("url"), category="blog", domain=F.concat(_printed("publication"), F.lit(".substack.com")), url=_r("url"), title=_r("title"), author=_r("author"), created=any_time(_r("published_at")), content=_r("post_id"), white=white)


def github(df: DataFrame, white: str = WHITE_SPACE) -> DataFrame:
    ident = F.concat(_printed("repo_full_name"), F.lit(":"), _printed("record_type"), F.lit(":"), _printed("issue_number", "readme"))
    return _silver(df, "github", _r("text"), ident, category="code_doc", domain="github.com", url=_r("url"), title=_r("title"), author=_r("author"), created=any_time(either(_r("pushed_at"), _r("created_at"))), content=ident, white=white)


NORMALISERS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (common_crawl, reddit, news, wikipedia, hackernews, wayback, bluesky, fourchan, steam, youtube, linkedin, twitter, stackoverflow, mastodon, substack, github)
}


def normalise(df: DataFrame, source: str, white: str = WHITE_SPACE) -> DataFrame:
    """Silver documents of records (raw, keys, partition, and file and line for order) of a source path; its first part names the rule.
    white: what texts lose at either end."""
    name = source.split("/")[0]
    if name not in NORMALISERS:
        raise KeyError(f"no rule for {source}")
    return NORMALISERS[name](df, white)


def silver(parts: list[DataFrame], columns: tuple[str, ...] = SILVER_COLUMNS) -> DataFrame:
    """All sources under one another."""
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out
