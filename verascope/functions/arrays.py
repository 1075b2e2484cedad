"""Array expressions that name their argument often and compute it once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for the row."""
    return F.transform(F.array(value), use)[0]


def value_counts(values: Column) -> Column:
    """How often each distinct value of an array occurs, in the values' order; no shuffle, one sort of the array."""

    def cut(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i - 1) != F.get(s, i)))
        return let(ends, lambda e: F.transform(e, lambda i, k: i - F.coalesce(F.get(e, k - 1), F.lit(0))))

    return let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(F.array().cast("array<int>")))


def total(values: Column) -> Column:
    """Sum of an array as a double; empty: 0."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def stddev_pop(values: Column) -> Column:
    return let(mean(values), lambda m: F.sqrt(total(F.transform(values, lambda x: (x - m) * (x - m))) / F.size(values)))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
