"""Schemas of bronze records by source, of the silver table and of the tables derived from it."""

from __future__ import annotations

_AUDIT = "_ingested_at string, _source string, _minion string"
_COMMENT = "id string, text string, author string, score bigint, created_utc double, created_dt string, depth int, controversiality int, content_hash string"

BRONZE = {
    "common_crawl": "url string, domain string, category string, date string, text string, text_length bigint, content_hash string",
    "reddit": f"id string, title string, text string, permalink string, author string, subreddit string, score bigint, created_utc double, created_dt string, content_hash string, comments array<struct<{_COMMENT.replace(' string', ': string').replace(' bigint', ': bigint').replace(' double', ': double').replace(' int', ': int')}>>",
    "news": "url string, domain string, title string, text string, text_length bigint, pub_date string, content_hash string, feed_url string, feed_published string, feed_summary string, feed_tags array<string>, category string",
    "wikipedia": "title string, pageid string, url string, text string, text_length bigint, category string, domain string, last_editor string, last_edit_ts string, content_hash string, type string",
    "hackernews": f"id string, title string, text string, url string, hn_url string, author string, points bigint, num_comments bigint, created_utc double, created_dt string, tags array<string>, domain string, category string, content_hash string, comments array<struct<{_COMMENT.replace(' string', ': string').replace(' bigint', ': bigint').replace(' double', ': double').replace(' int', ': int')}>>",
    "wayback": "sentinel_url string, wayback_url string, timestamp string, snapshot_date string, snapshot_year string, domain string, category string, text string, text_length bigint, content_hash string",
    "bluesky": "uri string, cid string, author_did string, author_handle string, text string, created_at string, like_count bigint, repost_count bigint, reply_count bigint, langs string, category string",
    "fourchan": "board string, thread_no string, post_no string, is_op boolean, subject string, text string, timestamp string, country string, filename string, replies_count bigint, category string",
    "steam": "app_id string, game_name string, review_id string, author_steam_id string, text string, language string, timestamp_created string, voted_up boolean, votes_up bigint, votes_funny bigint, playtime_forever bigint, received_for_free boolean, category string",
    "youtube": "video_id string, video_title string, channel_id string, channel_title string, comment_id string, comment_text string, author_channel_id string, like_count bigint, published_at string, reply_count bigint, category string",
    "linkedin": "url string, title string, text string, published_at string, source_feed string, scraped_at string, category string",
    "twitter": "tweet_id string, text string, author_id string, created_at string, like_count bigint, retweet_count bigint, reply_count bigint, lang string, source_app string, is_nitter boolean, search_term string, category string",
    "stackoverflow": "question_id string, answer_id string, record_type string, title string, text string, tags array<string>, score bigint, is_accepted boolean, view_count bigint, answer_count bigint, owner_reputation string, created_at string, url string, category string, search_tag string",
    "mastodon": "status_id string, text string, author_acct string, instance string, created_at string, language string, url string, replies_count bigint, reblogs_count bigint, favourites_count bigint, tags array<string>, category string",
    "substack": "post_id string, publication string, title string, text string, author string, published_at string, url string, word_count bigint, category string",
    "github": "repo_full_name string, record_type string, issue_number string, title string, text string, stars bigint, language string, description string, url string, author string, created_at string, state string, labels array<string>, pushed_at string, category string",
}
BRONZE = {k: f"{v}, {_AUDIT}" for k, v in BRONZE.items()}

SILVER = (
    "doc_id string, source string, category string, domain string, url string, title string, text string, text_length bigint, author string, "
    "created_dt timestamp, crawl_partition string, ingested_at string, content_hash string"
)
DAILY = (
    "date date, source string, category string, n_docs bigint, mean_score double, median_score double, std_score double, pct_below_50 double, bot_fraction double, aliveness_index double"
)
COMPOSITE = "date date, aliveness_index double, smoothed_index double, n_docs bigint, anomaly_flag int, anomaly_reason string"
DOMAINS = "date date, domain string, category string, mean_score double, n_docs bigint"
META = "key string, value string"
REGISTRY = "doc_id string"
