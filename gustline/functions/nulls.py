"""Missing data: NULL means no observation; NaN never leaves the ingest boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def non_negative(c: Column) -> Column:
    """Negative readings are no readings."""
    return F.when(c >= 0, c)


def clip(c: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """c within bounds; NULL stays NULL (least and greatest would skip it)."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low) if not isinstance(low, Column) else low).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high) if not isinstance(high, Column) else high).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def pearson(a: Column, b: Column) -> Column:
    """Correlation as an aggregate, NULL without spread; the built-in raises under ANSI."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))
