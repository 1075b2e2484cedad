"""Quality rules from built-in functions only: base counts and Jensen-Shannon distances to language profiles.

A text's histogram over character classes and its histogram over a language's common words (with one bin for
all other words) are compared with the profile of every language; the closest counts. Texts under a minimum
length are not judged by a distance: short histograms say little. Profiles come from all rows of the table; every
language with enough text has one, and texts of a language without one are not judged by a distance either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verascope.llm.common import SPACE_CLASS

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Word buckets of a language that are ranked apart.
RANK_BUCKETS = 64
#: Bits for a window's place in a text of fewer words; longer texts keep hashes and places apart.
PLACE_BITS = 16
CLASSES = ("lower", "space", "upper", "digit", "symbol", "other")


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules, profile sizes, guards and distances (square roots of divergences in bits)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 40
    profile_min_chars: int = 20_000
    class_min_chars: int = 200
    word_min_words: int = 80
    max_class_distance: float = 0.24
    max_word_distance: float = 0.36


def _then(value: Column, use) -> Column:
    """use(value), with value computed once for the row although use names it often."""
    return F.transform(F.array(value), use)[0]


def _class_counts(df: DataFrame, text: str) -> DataFrame:
    """c_lower ... c_other: code points by class; each step counts what it takes from the rest."""
    rest = F.col(text)
    df = df.withColumn("_r0", F.regexp_replace(rest, r"\p{Ll}+", ""))
    df = df.withColumn("_r1", F.translate("_r0", SPACES, ""))
    df = df.withColumn("_r2", F.regexp_replace("_r1", r"\p{Lu}+", ""))
    df = df.withColumn("_r3", F.regexp_replace("_r2", r"\p{Nd}+", ""))
    df = df.withColumn("_r4", F.translate("_r3", SYMBOLS, ""))
    lengths = [F.length(rest), *[F.length(f"_r{i}") for i in range(5)]]
    df = df.withColumns({f"c_{c}": (lengths[i] - lengths[i + 1]).cast("long") for i, c in enumerate(CLASSES[:5])} | {"c_other": lengths[5].cast("long")})
    return df.drop(*[f"_r{i}" for i in range(5)])


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, first included."""
    low = F.lit((1 << PLACE_BITS) - 1).cast("long")
    digest = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    every = lambda w: F.sequence(F.lit(0), F.size(w) - 3)
    # places in order: a window adds the words up to the next one, three at most
    total = lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0), lambda n, x: n + x)

    def short(w: Column) -> Column:
        # a window is one number, most of its hash above its place: those sort much faster than structs; words decide
        word = lambda x, k: F.get(w, x.bitwiseAND(low).cast("int") + k)
        same = lambda x, y: (F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
        twice = lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        windows = F.transform(every(w), lambda i: F.shiftleft(digest(w, i), PLACE_BITS).bitwiseOR(i.cast("long")))
        return _then(_then(F.sort_array(windows), lambda s: F.sort_array(F.transform(twice(s), lambda x: x.bitwiseAND(low).cast("int")))), total)

    def long(w: Column) -> Column:
        windows = F.transform(every(w), lambda i: F.struct(digest(w, i).alias("h"), i.alias("i")))
        twice = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return _then(_then(F.sort_array(windows), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))), total)

    return _then(words, lambda w: F.when(F.size(w) < 4, 0).when(F.size(w) < 1 << PLACE_BITS, short(w)).otherwise(long(w)))


def base_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, words, counts of words, symbols, repeated lines and windows, and of character classes)."""
    d = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = _class_counts(d, "text")
    d = d.withColumn("words", F.filter(F.split("text", SPACE_CLASS), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return d.select(
        "doc_id",
        "lang",
        "words",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.col("c_space")).cast("long").alias("word_chars"),
        F.col("c_symbol").alias("n_symbols"),
        _then(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        *[f"c_{c}" for c in CLASSES],
    )


@dataclass(frozen=True)
class Profile:
    lang: str
    classes: tuple[float, ...]
    words: dict[str, float]


def profiles(df: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> list[Profile]:
    """The class shares and the common words of every language with profile_min_chars characters of words, from all rows.

    RANK_BUCKETS times common_words rows of a language reach the driver. Words are ranked within buckets first, so no task
    sorts all words of a language.
    """
    d = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sums = _class_counts(d, "text").groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(f"c_{c}").alias(c) for c in CLASSES])
    found = sums.where(sum((F.col(c) for c in CLASSES if c != "space"), F.lit(0)) >= rules.profile_min_chars).collect()
    if not found:
        return []
    counts = (
        d.where(F.col("lang").isin([r["lang"] for r in found]))
        .select("lang", F.explode(F.split(F.lower("text"), SPACE_CLASS)).alias("word"))
        .where("word <> ''")
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    bucket = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(RANK_BUCKETS)))
    best = counts.withColumn("rank", F.row_number().over(bucket.orderBy(F.desc("n"), "word"))).withColumn("total", F.sum("n").over(bucket))
    totals: dict[str, int] = {}
    words: dict[str, list[tuple[int, str]]] = {}
    for r in best.where(F.col("rank") <= rules.common_words).collect():
        totals[r["lang"]] = totals.get(r["lang"], 0) + (r["total"] if r["rank"] == 1 else 0)
        words.setdefault(r["lang"], []).append((-r["n"], r["word"]))
    out = []
    for r in sorted(found, key=lambda r: r["lang"]):
        size, lang = sum(r[c] for c in CLASSES), r["lang"]
        top = sorted(words.get(lang, []))[: rules.common_words]
        out.append(Profile(lang, tuple(r[c] / size for c in CLASSES), {w: -n / totals[lang] for n, w in top}))
    return out


def _half(p: Column, q: Column) -> Column:
    """One bin's share of the divergence, in bits."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    return (part(p, q) + part(q, p)) / 2


def _class_distance(profile: Column, total: Column) -> Column:
    """profile: the shares of CLASSES."""
    bins = [_half(profile[i], F.col(f"c_{c}") / total) for i, c in enumerate(CLASSES)]
    return F.sqrt(F.greatest(sum(bins[1:], bins[0]), F.lit(0.0)))


def _word_distance(profile: Column, runs: Column, n_words: Column) -> Column:
    """profile: (known, shares); runs: (w, n) of common words of any language in the text; bins absent from it are summed beforehand."""
    known, shares = profile["known"], profile["shares"]

    def of(own: Column) -> Column:
        sums = F.aggregate(
            own,
            F.struct((known / 2).alias("js"), F.lit(0.0).alias("q")),
            lambda a, x: F.struct((a["js"] + _half(x["p"], x["q"]) - x["p"] / 2).alias("js"), (a["q"] + x["q"]).alias("q")),
            lambda a: a["js"] + _half(F.greatest(1 - known, F.lit(0.0)), F.greatest(1 - a["q"], F.lit(0.0))),
        )
        return F.sqrt(F.greatest(sums, F.lit(0.0)))

    paired = F.transform(runs, lambda x: F.struct(F.try_element_at(shares, x["w"]).alias("p"), (x["n"] / n_words).alias("q")))
    return of(F.filter(paired, lambda x: x["p"].isNotNull()))


def _runs(words: Column) -> Column:
    """(w, n) of equal words, by sorting."""

    def cut(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i - 1) != F.get(s, i)))
        return _then(ends, lambda e: F.transform(e, lambda i, k: F.struct(F.get(s, i - 1).alias("w"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).alias("n"))))

    return _then(F.sort_array(words), lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(F.array().cast("array<struct<w:string,n:int>>")))


def judged(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, distances and verdict of every row of df.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance (null where a guard holds, no language has a profile or the text's own language has none), kept. Null and
    empty texts have no words, so base_failed. A null lang gives no profile but is judged by all. Words of one count are
    ordered by themselves where a profile's list ends. Texts may have any length. Repeated rows and ids stay, a null doc_id
    too; other columns are not read, so their names may clash. An empty table gives none.
    """
    known = profiles(df, rules, text_col, lang_col)
    base = base_counts(df, id_col, text_col, lang_col)
    total = sum((F.col(f"c_{c}") for c in CLASSES[1:]), F.col(f"c_{CLASSES[0]}"))
    none = F.lit(None).cast("double")
    by_class, by_word = none, none
    common = sorted({w for p in known for w in p.words})
    double = lambda x: F.lit(float(x))
    own_profile = F.col("lang").isNull() | F.col("lang").isin([p.lang for p in known])
    if known:
        shares = F.array(*[F.array(*map(double, p.classes)) for p in known])
        by_class = F.when(own_profile & (total >= rules.class_min_chars), F.array_min(F.transform(shares, lambda p: _class_distance(p, total))))
    if common:
        own = F.filter(F.transform("words", F.lower), lambda w: w.isin(common))
        lists = F.array(*[F.struct(double(sum(p.words.values())).alias("known"), F.create_map(*[x for w, v in p.words.items() for x in (F.lit(w), double(v))]).alias("shares")) for p in known if p.words])
        distances = lambda r: F.array_min(F.transform(lists, lambda p: _word_distance(p, r, F.col("n_words"))))
        by_word = F.when(own_profile & (F.col("n_words") >= rules.word_min_words), _then(_runs(own), distances))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > rules.max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > rules.max_word_distance)
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), by_class.alias("class_distance"), by_word.alias("word_distance")
    ).withColumn("kept", ~F.col("base_failed") & ~far)
