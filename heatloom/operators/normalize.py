"""Robust normalisation of indicator columns to [0, 1] per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from heatloom import constants as C
from heatloom.functions.basic import rescale
from heatloom.operators.groups import DEFAULT_BY, GroupProfile, ensure_profile, join_stats
from heatloom.operators.ordering import percentiles, unpivot


def present(df: DataFrame, columns: Sequence[str], allow_missing: bool) -> list[str]:
    """The columns of the table that are asked for; an error if some are absent."""
    found = [c for c in columns if c in df.columns]
    if len(found) < len(columns) and not allow_missing:
        raise ValueError(f"missing columns: {sorted(set(columns) - set(found))}")
    return found


def robust_normalize(
    df: DataFrame,
    columns: Sequence[str] = tuple(C.INDICATORS),
    by: Sequence[str] = DEFAULT_BY,
    probs: tuple[float, float] = C.CLIP_PERCENTILES,
    directions: Mapping[str, str] | None = None,
    profile: GroupProfile | None = None,
    allow_missing: bool = False,
    suffix: str = "",
    stats: DataFrame | None = None,
) -> DataFrame:
    """Clip every column to its group percentiles and scale it to [0, 1].

    A flat column becomes 0.5 and a ``negative`` direction is inverted.  All
    columns share one aggregate and one join.  ``stats`` are percentiles computed
    before, for callers that normalise the same groups more than once.
    """
    columns = present(df, columns, allow_missing)
    directions = directions or C.INDICATOR_DIRECTIONS
    profile = ensure_profile(df, by, profile)
    if stats is None:
        stats = percentiles(df, columns, probs, by, profile)
    joined = join_stats(df, stats, by, profile)
    return joined.withColumns(scaled_columns(columns, directions, suffix)).drop(*[f"{c}_p" for c in columns])


def scaled_columns(columns: Sequence[str], directions: Mapping[str, str], suffix: str = "") -> dict[str, Column]:
    """The columns clipped to their percentiles ``<c>_p`` of the same row and scaled to [0, 1]."""

    def scaled(c: str) -> Column:
        # One SQL text per column: far fewer driver calls than nested functions.
        lo, hi, v = f"`{c}_p`[0]", f"`{c}_p`[1]", f"cast(`{c}` as double)"
        out = (f"case when `{c}` is null then null when {hi} - {lo} < {C.FLAT_SPAN!r}D then 0.5D "
               f"else (least(greatest({v}, {lo}), {hi}) - {lo}) / ({hi} - {lo}) end")
        return F.expr(f"1.0D - ({out})" if directions.get(c, "positive") == "negative" else out)

    return {f"{c}{suffix}": scaled(c) for c in columns}


def minmax_norm(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = DEFAULT_BY,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Scale columns to [0, 1] by the minimum and maximum of the group."""
    profile = ensure_profile(df, by, profile)
    aggs = [f(F.col(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    joined = join_stats(df, df.groupBy(*by).agg(*aggs), by, profile)
    return joined.withColumns(
        {c: rescale(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), C.FLAT_SPAN) for c in columns}
    ).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def indicator_stats(
    df: DataFrame,
    columns: Sequence[str] = tuple(C.INDICATORS),
    by: Sequence[str] = DEFAULT_BY,
    probs: tuple[float, float] = C.CLIP_PERCENTILES,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Minimum, maximum, clipping percentiles and mean per group and indicator."""
    profile = ensure_profile(df, by, profile)
    long = unpivot(df, by, columns)
    basic = long.groupBy(*by, "indicator").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )
    p = percentiles(long, ["value"], probs, [*by, "indicator"], profile.scaled(groups=len(columns)))
    return basic.join(p, [*by, "indicator"]).select(
        *by, "indicator", "min", "max",
        F.col("value_p")[0].alias("p2"), F.col("value_p")[1].alias("p98"), "mean",
    )
