"""Null-safe numeric expressions: NaN and infinities count as missing everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_num(x) -> Column:
    """NULL for NaN and for either infinity, so that aggregates skip them."""
    c = col_of(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def to_number(x) -> Column:
    """Coerce text to a number; what is no number becomes NULL."""
    return clean_num(col_of(x).try_cast("double"))


def meets(x, threshold: float) -> Column:
    """x >= threshold, false for NaN and NULL (Spark's own comparison ranks NaN highest)."""
    c = col_of(x)
    return F.coalesce((c >= F.lit(float(threshold))) & ~F.isnan(c), F.lit(False))


def safe_div(a, b) -> Column:
    """NULL where the divisor is zero or missing."""
    return F.try_divide(col_of(a).cast("double"), col_of(b).cast("double"))


def safe_corr(x, y) -> Column:
    """Pearson correlation as an aggregate over complete pairs; NULL where either side is constant."""
    a, b = clean_num(x), clean_num(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def row_mean(*columns) -> Column:
    """Mean over the columns that are present in a row; NULL if none is."""
    values = F.filter(F.array(*[clean_num(c) for c in columns]), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(total, F.size(values).cast("double"))
