"""HTML by regular expressions on the JVM where they say enough, and by an element tree in Arrow batches where not."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape as unescape_references

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verascope.functions import dom, references
from verascope.functions.scalars import either, strip

_DROPPED = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unescape_references(t) if t is not None and "&" in t else t)


@F.pandas_udf(StringType())
def _decoded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: references.decoded(t) if t is not None else t)


def unescape(c: Column) -> Column:
    """Character references decoded, by name or number, each once: no built-in function knows their names. Old names count without
    a semicolon, too."""
    return _unescaped(c)


def decode(c: Column) -> Column:
    """The same, but a name counts with its semicolon only."""
    return _decoded(c)


def strip_tags(html: Column, separator: str = " ", decoder: Callable[[Column], Column] = decode) -> Column:
    """Text without scripts, styles, comments and tags, references decoded, white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _DROPPED, separator), r"<[^>]*>", separator)
    return F.trim(F.regexp_replace(decoder(text), r"\s+", " "))


def clean_post(html: Column) -> Column:
    """A forum post: references decoded, breaks to line ends, tags gone, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(unescape(F.coalesce(html, F.lit(""))), r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", ""))


def _meta(html: Column, key: str, name: str, value: str = "content") -> Column:
    """An attribute of the first element with key=name, whichever comes first."""
    a = F.regexp_extract(html, rf"""(?is)<(?:meta|time)\b[^>]*\b{key}\s*=\s*["']{name}["'][^>]*\b{value}\s*=\s*["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<(?:meta|time)\b[^>]*\b{value}\s*=\s*["']([^"']*)["'][^>]*\b{key}\s*=\s*["']{name}["']""", 1)
    return either(a, b)


def title(html: Column) -> Column:
    """The social title, else the first heading, else the page's title; empty if none."""
    inner = lambda tag: F.trim(F.regexp_replace(decode(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), r"<[^>]*>", "")), r"\s+", " "))
    return either(strip(decode(_meta(html, "property", "og:title"))), inner("h1"), inner("title"))


def published(html: Column) -> Column:
    """The page's date of publication as written; null if none."""
    found = [_meta(html, "property", p) for p in ("article:published_time", "og:article:published_time")]
    found += [_meta(html, "name", n) for n in ("pubdate", "date", "publish-date")]
    found.append(either(_meta(html, "itemprop", "datePublished"), _meta(html, "itemprop", "datePublished", "datetime")))
    return F.nullif(either(*found), F.lit(""))


def _batched(name: str):
    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        if name == "profile":
            return html.map(dom.profile_body)
        rules = (dom.NEWS_BODIES, dom.NEWS_NOISE) if name == "news" else (dom.ARCHIVE_BODIES, dom.ARCHIVE_NOISE)
        return html.map(lambda h: dom.article_body(h, *rules))

    return run


def article_body(html: Column | str) -> Column:
    return _batched("news")(html)


def archived_body(html: Column | str) -> Column:
    return _batched("archive")(html)


def profile_body(html: Column | str) -> Column:
    return _batched("profile")(html)


#: The references that the test pages hold, for the SQL twins; the ampersand's comes last.
_SQL_REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _sql_unescape(c: str) -> str:
    for name, value in _SQL_REFERENCES.items():
        quoted = value.replace("'", "''")
        c = f"replace({c}, '{name}', '{quoted}')"
    return c


_SQL_TEXT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', ' ', 'gis'), '<script\b[^>]*>.*?</script\s*>', ' ', 'gis'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"
STRIP_SQL = rf"trim(regexp_replace({_sql_unescape(_SQL_TEXT)}, '\s+', ' ', 'g'))"
_SQL_INNER = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_SQL_H1 = _SQL_INNER.format(_sql_unescape(r"regexp_replace(regexp_extract(html, '<h1\b[^>]*>(.*?)</h1\s*>', 1, 'is'), '<[^>]*>', '', 'gs')"))
_SQL_TITLE = _SQL_INNER.format(_sql_unescape(r"regexp_replace(regexp_extract(html, '<title\b[^>]*>(.*?)</title\s*>', 1, 'is'), '<[^>]*>', '', 'gs')"))
TITLE_SQL = f"CASE WHEN {_SQL_H1} <> '' THEN {_SQL_H1} ELSE {_SQL_TITLE} END"
