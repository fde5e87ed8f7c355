"""Column expressions over a trial's samples inside one row; searches over many samples are in `traces`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traces import argmax, argmin, runs  # noqa: F401


def settled(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are computed once per row. A plain projection may be merged into a later lambda, and then
    runs again for every sample; a generator of one row is not merged."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body has lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(a: Column, i: Column) -> Column:
    """Sample i, null outside the array."""
    return F.when(i >= 0, F.get(a, i))


def between(a: Column, start, end) -> Column:
    """Samples [start, end); empty where the span is."""
    start, end = _c(start), _c(end)
    return F.slice(a, start + 1, F.greatest(end - start, F.lit(0)))


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def deviation(a: Column, less: int = 1) -> Column:
    """Standard deviation by two passes, over the count less `less`; null if that is not positive."""
    square = lambda x, m: F.aggregate(x, F.lit(0.0), lambda s, y: s + (y - m) * (y - m))
    sd = lambda x: F.when(F.size(x) > less, F.sqrt(let(mean(x), lambda m: square(x, m)) / (F.size(x) - less)))
    return let(a, sd)


def median(a: Column) -> Column:
    """Mean of the two middle samples."""
    n = F.size(a)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return let(F.sort_array(a), lambda s: F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2))


def has_bad(a: Column) -> Column:
    """Whether a sample is null, NaN or infinite: a span that holds one gives no answer."""
    return F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
