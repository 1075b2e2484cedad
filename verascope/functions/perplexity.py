"""The optional sub-score of a language model: off by default, and a neutral 0.5 where it cannot judge."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR, CAP, NEUTRAL = 1.0, 1000.0, 0.5


def enabled() -> bool:
    return os.environ.get("ENABLE_PERPLEXITY") == "1"


def normalised(mean_loss: float) -> float:
    """exp(loss) within FLOOR and CAP, on a logarithmic scale from 0 to 1."""
    p = max(FLOOR, min(CAP, math.exp(min(mean_loss, 50.0))))
    return (math.log(p) - math.log(FLOOR)) / (math.log(CAP) - math.log(FLOOR))


def scorer(load: Callable[[], Callable[[str], float]]) -> Callable[[Column], Column]:
    """A column function from a loader, which runs once per worker and returns text -> mean loss per token.

    Blank texts, and texts at which the model fails, score NEUTRAL.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        loss = None
        for batch in batches:
            out = []
            for text in batch:
                if not text or not text.strip():
                    out.append(NEUTRAL)
                    continue
                try:
                    loss = loss or load()
                    out.append(normalised(loss(text)))
                except Exception:  # the definition: any failure is neutral
                    out.append(NEUTRAL)
            yield pd.Series(out, dtype="float64")

    return run
