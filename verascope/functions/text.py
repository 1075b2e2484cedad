"""Text signals: each document is scored inside its row, without a shuffle.

features() takes all signals in one Arrow pass (`verascope.functions.signals`); here each of them, but for the running
ratio, is also an expression of built-in functions. A token is a maximal run of letters, digits and underscores that consists of two or more ASCII letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verascope.functions.arrays import clamp01, let, mean, stddev_pop, total, value_counts
from verascope.functions.signals import MTLD_THRESHOLD, TTR_WINDOW, ZIPF_RANKS, mtld_of, signals

TOKEN = r"(?<![\p{L}\p{N}_])[a-z]{2,}+(?![\p{L}\p{N}_])"
#: Starts only where a sentence can: elsewhere a text without terminators would be read to its end from every character.
SENTENCE = r"(?<![^.!?])[^.!?]++[.!?]++"
#: Weights of the sub-scores; the reduced ones leave room for the language model's.
WEIGHTS = {"ttr": 0.18, "mtld": 0.12, "entropy": 0.15, "sentence_variance": 0.15, "repetition": 0.15, "zipf_deviation": 0.15, "burstiness": 0.10}
PERPLEXITY_WEIGHT, PERPLEXITY_SHARE = 0.15, 0.85


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Stretches that end in a terminator, stripped; what follows the last terminator is none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0)), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))


def type_token_ratio(t: Column, window: int = TTR_WINDOW) -> Column:
    return F.when(F.size(t) > 0, F.size(F.array_distinct(F.slice(t, 1, window))) / F.least(F.size(t), F.lit(window))).otherwise(0.0)


def mtld(t: Column, threshold: float = MTLD_THRESHOLD) -> Column:
    """Mean tokens per factor of both directions; fewer than ten tokens: 0."""
    return mtld_of(t, threshold)


def entropy(t: Column) -> Column:
    """Bits per token of the unigram distribution; none: 0."""

    def bits(c: Column) -> Column:
        n = total(c)
        return F.greatest(F.lit(0.0), F.log2(n) - total(F.transform(c, lambda x: x * F.log2(x.cast("double")))) / n)

    return F.when(F.size(t) == 0, 0.0).otherwise(let(value_counts(t), bits))


def sentence_variation(text: Column) -> Column:
    """Coefficient of variation of tokens per sentence (population); fewer than three sentences: 0.5."""
    lengths = F.transform(sentences(text), lambda s: F.size(tokens(s)))
    of = lambda x: F.when(F.size(x) < 3, 0.5).when(total(x) == 0, 0.0).otherwise(stddev_pop(x) / mean(x))
    return let(lengths, of)


def repetition(t: Column) -> Column:
    """Share of token pairs that repeat an earlier pair; fewer than four tokens: 0."""
    pairs = F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(t) < 4, 0.0).otherwise(let(pairs, lambda p: 1 - F.size(F.array_distinct(p)) / F.size(p)))


def zipf_alignment(t: Column, ranks: int = ZIPF_RANKS) -> Column:
    """1 - |slope + 1| / 2 of ln frequency over ln rank, 0 at least; under 30 tokens or 5 types: 0.5."""

    def fitted(c: Column) -> Column:
        x = F.transform(c, lambda _, i: F.log(i.cast("double") + 1))
        y = F.transform(c, lambda v: F.log(v.cast("double")))

        def slope(m: Column) -> Column:
            covered = total(F.zip_with(m["x"], m["y"], lambda a, b: (a - m["mx"]) * (b - m["my"])))
            return covered / total(F.transform(m["x"], lambda a: (a - m["mx"]) * (a - m["mx"])))

        s = let(F.struct(x.alias("x"), y.alias("y"), mean(x).alias("mx"), mean(y).alias("my")), slope)
        return F.greatest(F.lit(0.0), 1 - F.abs(s + 1) / 2)

    top = let(value_counts(t), lambda c: F.struct(F.size(c).alias("types"), F.slice(F.reverse(F.sort_array(c)), 1, ranks).alias("c")))
    return let(top, lambda s: F.when((F.size(t) < 30) | (s["types"] < 5), 0.5).otherwise(fitted(s["c"])))


def average_word_length(t: Column) -> Column:
    return F.when(F.size(t) > 0, F.length(F.array_join(t, "")) / F.size(t)).otherwise(0.0)


SIGNALS = ("ttr", "mtld", "entropy", "sentence_variance", "repetition", "zipf_deviation", "avg_word_length")


def features(df: DataFrame, text_col: str = "text", burstiness: Column | None = None) -> DataFrame:
    """df with feat_ columns. Without event times burstiness is the neutral 0.5."""
    df = df.withColumn("_signals", signals(F.col(text_col).cast("string")))
    found = {f"feat_{k}": F.col("_signals")[k] for k in SIGNALS}
    found["feat_burstiness"] = burstiness if burstiness is not None else F.lit(0.5)
    found |= {f"feat_{k}": F.col("_signals")[k] for k in ("token_count", "sentence_count")}
    return df.withColumns(found).drop("_signals")


def sub_scores(prefix: str = "feat_") -> dict[str, Column]:
    """Features scaled to 0..1."""
    f = lambda k: F.col(prefix + k)
    return {
        "ttr": clamp01((f("ttr") - 0.2) / 0.5),
        "mtld": clamp01((f("mtld") - 20) / 100),
        "entropy": clamp01((f("entropy") - 5) / 8),
        "sentence_variance": clamp01(f("sentence_variance") / 1.2),
        "repetition": clamp01(1 - f("repetition") / 0.3),
        "zipf_deviation": clamp01(f("zipf_deviation")),
        "burstiness": clamp01(f("burstiness")),
    }


def weights(with_perplexity: bool = False) -> dict[str, float]:
    if not with_perplexity:
        return dict(WEIGHTS)
    return {k: round(v * PERPLEXITY_SHARE, 4) for k, v in WEIGHTS.items()} | {"perplexity": PERPLEXITY_WEIGHT}


def composite(scores: dict[str, Column], by: dict[str, float]) -> Column:
    parts = [scores[k] * w for k, w in by.items() if k in scores]
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum(parts[1:], parts[0]) * 100))


def score_documents(df: DataFrame, text_col: str = "text", by: dict[str, float] | None = None, perplexity: Column | None = None, round_to: int | None = 2, where: Column | None = None) -> DataFrame:
    """df with feat_ and score_ columns and aliveness_score, 0 to 100.

    perplexity: an optional column of its sub-score. where: the rows that have it; the others get null and the weights
    without it, as some sources are too large for the model.
    """
    df = features(df, text_col)
    scores = sub_scores()
    if perplexity is not None:
        scores["perplexity"] = clamp01(perplexity) if where is None else F.when(where, clamp01(perplexity))
    df = df.withColumns({f"score_{k}": v for k, v in scores.items()})
    found = {k: F.col(f"score_{k}") for k in scores}
    whole = composite(found, by or weights(perplexity is not None))
    if perplexity is not None and where is not None:
        whole = F.when(where, whole).otherwise(composite(found, by or weights()))
    return df.withColumn("aliveness_score", F.round(whole, round_to) if round_to is not None else whole)
