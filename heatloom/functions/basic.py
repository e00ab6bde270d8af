"""Small numeric expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def clamp(c: Column, lo: Column | float | None, hi: Column | float | None) -> Column:
    """Limit a value to [lo, hi]; missing stays missing."""
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def lerp(low: Column, high: Column, fraction: Column) -> Column:
    return low + (high - low) * fraction


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def rescale(c: Column, lo: Column, hi: Column, flat: float = 1e-12) -> Column:
    """Scale [lo, hi] to [0, 1]; 0.5 where the range is flat; missing stays missing."""
    return F.when(c.isNotNull(), F.when(hi - lo < flat, F.lit(0.5)).otherwise((c - lo) / (hi - lo)))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; NULL where a column is constant.

    Both columns must be missing in the same rows.  The built-in ``corr`` fails on
    a constant column in ANSI mode.
    """
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
