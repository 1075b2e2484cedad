"""The text signals of a document in one pass over its tokens, in Arrow batches.

The running type-token ratio has state that grows with a factor's types; as an array expression it copies that state for
every token. One pass with a set costs a small part of that, so all signals are taken there; each is also a column expression in
`verascope.functions.text` where built-in functions say it well.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MTLD_THRESHOLD, TTR_WINDOW, ZIPF_RANKS = 0.72, 200, 50
#: Tokens and runs of terminators, in order.
_PART = re.compile(r"\b[a-z]{2,}+\b|[.!?]++")
FIELDS = "ttr double, mtld double, entropy double, sentence_variance double, repetition double, zipf_deviation double, avg_word_length double, token_count bigint, sentence_count bigint"


def _factors(t: list[str], threshold: float) -> float:
    """Tokens per factor in one direction: a factor ends where the running ratio falls to the threshold."""
    found, n, seen = 0.0, 0, set()
    for x in t:
        n += 1
        seen.add(x)
        if len(seen) / n <= threshold:
            found += 1
            n = 0
            seen.clear()
    found += (1 - len(seen) / n) / (1 - threshold) if n else 0.0
    return len(t) / found if found > 0 else float(len(t))


def mtld(t: list[str], threshold: float = MTLD_THRESHOLD) -> float:
    """Mean of both directions; fewer than ten tokens: 0."""
    return (_factors(t, threshold) + _factors(t[::-1], threshold)) / 2 if len(t) >= 10 else 0.0


def _zipf(counts: list[int], n: int) -> float:
    if n < 30 or len(counts) < 5:
        return 0.5
    top = np.array(sorted(counts, reverse=True)[:ZIPF_RANKS], float)
    x, y = np.log(np.arange(1, len(top) + 1)), np.log(top)
    x = x - x.mean()
    return max(0.0, 1 - abs(float((x * (y - y.mean())).sum() / (x * x).sum()) + 1) / 2)


def measure(text: str | None) -> tuple:
    """FIELDS of a text. A token is a run of word characters that are all ASCII letters, two at least; null counts as empty."""
    lower = (text or "").lower()
    t: list[str] = []
    ends: list[int] = []
    for x in _PART.findall(lower):
        if x[0] in ".!?":
            ends.append(len(t))
        else:
            t.append(x)
    if ends and lower[0] in ".!?":
        # a run of terminators at the front ends no sentence
        del ends[0]
    n = len(t)
    variation = 0.5
    if len(ends) >= 3:
        lengths = np.diff(np.array([0, *ends], float))
        variation = float(lengths.std() / lengths.mean()) if lengths.any() else 0.0
    if not n:
        return 0.0, 0.0, 0.0, variation, 0.0, 0.5, 0.0, 0, len(ends)
    counts = list(Counter(t).values())
    c = np.array(counts, float)
    return (
        len(set(t[:TTR_WINDOW])) / min(n, TTR_WINDOW),
        mtld(t),
        max(0.0, math.log2(n) - float((c * np.log2(c)).sum()) / n),
        variation,
        1 - len(set(zip(t, t[1:], strict=False))) / (n - 1) if n >= 4 else 0.0,
        _zipf(counts, n),
        sum(map(len, t)) / n,
        n,
        len(ends),
    )


def signals(text: Column | str) -> Column:
    """A struct of FIELDS."""

    @F.pandas_udf(FIELDS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(x) for x in texts], columns=[f.split()[0] for f in FIELDS.split(", ")])

    return run(text)


def mtld_of(tokens: Column, threshold: float = MTLD_THRESHOLD) -> Column:
    """mtld() of an array of tokens."""

    @F.pandas_udf("double")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([mtld(list(x), threshold) if x is not None else 0.0 for x in t], dtype=float)

    return run(tokens)
