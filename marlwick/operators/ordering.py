"""The total order of values for DataFrame code: null, NaN, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_first(c: str | Column, descending: bool = False) -> list[Column]:
    """Sort keys that put null lowest and NaN below all numbers."""
    c = F.col(c) if isinstance(c, str) else c
    number = F.when(c.isNotNull(), ~F.isnan(c))
    return [number.desc_nulls_last(), c.desc_nulls_last()] if descending else [number.asc_nulls_first(), c.asc_nulls_first()]


def max_number(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.max(F.when(~F.isnan(c), c)), F.max(c))


def min_number(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.max(F.isnan(c)), F.lit(float("nan"))).otherwise(F.min(c))


def same_number(whole: str | Column, real: str | Column) -> Column:
    """Exact equality of a bigint and a double, also above 2**53."""
    w, r = (F.col(x) if isinstance(x, str) else x for x in (whole, real))
    inside = (F.abs(r) < 2.0**63) & ~F.isnan(r)
    return F.when(w.isNotNull() & r.isNotNull(), F.coalesce(inside & (F.floor(r) == r) & (F.when(inside, r).cast("decimal(38,0)") == w.cast("decimal(38,0)")), F.lit(False)))
