"""Date windows of the composite months."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def month_window(year: Column, months: Column, margin: int = 1) -> tuple[Column, Column]:
    """[start, end) dates covering an array of months, widened by ``margin`` months on both sides."""
    start = F.add_months(month_start(year, F.array_min(months)), -margin)
    end = F.add_months(month_start(year, F.array_max(months)), 1 + margin)
    return start, end
