"""Scalar expressions of the ingestion and dashboard paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of hosts by category, tested in this order.
CRAWL_CATEGORIES = {
    "news": ("reuters.com", "bbc.com", "bbc.co.uk", "cnn.com", "nytimes.com", "theguardian.com", "washingtonpost.com", "apnews.com", "npr.org"),
    "social": ("reddit.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "tiktok.com", "linkedin.com", "tumblr.com", "mastodon.social"),
    "wiki": ("wikipedia.org", "wikimedia.org"),
    "blog": ("medium.com", "substack.com", "wordpress.com", "blogspot.com"),
}
ARCHIVE_CATEGORIES = {
    "news": ("reuters.com", "bbc.com", "bbc.co.uk", "theguardian.com", "apnews.com", "techcrunch.com"),
    "social": ("reddit.com", "old.reddit.com", "metafilter.com", "news.ycombinator.com", "lobste.rs"),
    "wiki": ("wikipedia.org",),
    "blog": ("marginalrevolution.com", "slatestarcodex.com", "substack.com"),
}
#: Words that mark a text as English.
ENGLISH_WORDS = (
    "the is are was were and or but in on at to for of a an that this with from by as it its not be have had has do did will would can could should may might"
).split()
#: Formats that time stamps come in, and labels of scores.
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd", "yyyyMMddHHmmss", "dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss z",
)
SCORE_LABELS = ((65, "Predominantly Human"), (50, "Mixed — Significant Synthetic Presence"), (35, "Synthetic Majority Detected"))
LOWEST_LABEL = "Critical — Internet Largely Synthetic"


#: Unicode's White_Space.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column, white: str = WHITE_SPACE) -> Column:
    """Without white space of any kind at either end."""
    # a pattern would look at every place for white space
    return F.trim(c, F.lit(white))


def either(*cs: Column) -> Column:
    """The first that is neither null nor empty; else the last."""
    return F.coalesce(*[F.when(c != "", c) for c in cs[:-1]], cs[-1])


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def doc_id(source: Column | str, identifier: Column, text: Column) -> Column:
    """24 hex digits of source, identifier and the text's first 64 characters."""
    source = F.lit(source) if isinstance(source, str) else source
    return F.substring(F.sha2(F.concat(source, F.lit(":"), identifier, F.lit(":"), F.substring(text, 1, 64)), 256), 1, 24)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def short_sha1(c: Column, n: int | None = None) -> Column:
    return F.sha1(c) if n is None else F.substring(F.sha1(c), 1, n)


def unix_time(c: Column) -> Column:
    """Seconds since 1970, a number or its text, as a time stamp; anything else: null."""
    return F.timestamp_seconds(c.cast("string").try_cast("double").try_cast("bigint"))


def any_time(c: Column) -> Column:
    """A time stamp in any of TIME_FORMATS, UTC where it names no zone; anything else: null."""
    plain = F.regexp_replace(c, r"^[A-Za-z]{3,9}, ", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in TIME_FORMATS])


def archive_time(c: Column) -> Column:
    """yyyyMMddHHmmss; failing that the start of its year; failing that null."""
    return F.coalesce(F.try_to_timestamp(F.substring(c, 1, 14), F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(F.substring(c, 1, 4), F.lit("yyyy")))


def day_or(c: Column, as_of: Column) -> Column:
    """The day of a time stamp; null: as_of."""
    return F.coalesce(F.to_date(c), as_of)


def host(url: Column, lower: bool = True, cut_www: bool = True, strict: bool = False) -> Column:
    """The network location of a URL. cut_www takes all leading w and dots off, as the data has it; strict: only 'www.'."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    found = F.lower(found) if lower else found
    if not cut_www:
        return found
    return F.regexp_replace(found, r"^www\." if strict else r"^[w.]+", "")


def host_category(h: Column, rules: dict[str, tuple[str, ...]] = CRAWL_CATEGORIES, strict: bool = False) -> Column:
    """The first category with a suffix of the host; strict: whole labels only."""
    out = None
    for name, ends in rules.items():
        hit = None
        for end in ends:
            one = ((h == end) | h.endswith("." + end)) if strict else h.endswith(end)
            hit = one if hit is None else hit | one
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("web")


def is_english(text: Column, least: int = 4) -> Column:
    """Whether the first 600 characters hold enough distinct common English words."""
    found = F.array_distinct(F.split(F.lower(F.substring(text, 1, 600)), r"(?U)\s+"))
    return F.size(F.array_intersect(found, F.array(*map(F.lit, ENGLISH_WORDS)))) >= least


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def last_segment(path: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(path, sep), -1)


def titled(title: Column, body: Column) -> Column:
    """Title, blank line, body; without a body the title alone."""
    return F.when(text_or_empty(body) != "", F.concat(text_or_empty(title), F.lit("\n\n"), body)).otherwise(text_or_empty(title))


def decoded(c: Column) -> Column:
    """Text of base64; bytes that are no UTF-8 become replacement characters, what is no base64 null."""
    return F.make_valid_utf8(F.try_to_binary(F.regexp_replace(c, r"\s+", ""), F.lit("base64")).cast("string"))


def score_label(score: Column) -> Column:
    out = F.when(score >= SCORE_LABELS[0][0], SCORE_LABELS[0][1])
    for least, label in SCORE_LABELS[1:]:
        out = out.when(score >= least, label)
    return out.otherwise(LOWEST_LABEL)


def bar_band(score: Column) -> Column:
    return F.when(score >= 65, "forest").when(score >= 45, "gold").otherwise("burgundy")


def bar_opacities(score: Column, segments: int = 10) -> Column:
    """Opacity of each segment of a health bar: lit, partly lit, dim."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)) * segments / 100
    full = F.floor(x)
    partial = F.round(0.12 + (x - full) * 0.88, 3)
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.when(i < full, 1.0).when((i == full) & (x > full), partial).otherwise(0.12))


def short_count(n: Column) -> Column:
    return F.when(n.isNull(), "Unavailable").when(n >= 1_000_000, F.format_string("%.2fM", n / 1e6)).otherwise(F.format_number(n, 0))


def delta_text(score: Column, past: Column, days: int = 30) -> Column:
    """How a score moved, as the dashboard says it; no past score: empty."""
    d = score - past
    return F.coalesce(F.concat(F.when(d > 0, "↑").otherwise("↓"), F.lit(" "), F.format_string("%.1f", F.abs(d)), F.lit(f" vs {days} days prior")), F.lit(""))


def display_name(c: Column) -> Column:
    """Title case: a letter is a capital if none is before it, after an apostrophe or a hyphen, too."""
    runs = F.regexp_extract_all(F.replace(c, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")
