"""Neighbourhood operators on (row, col) grids.

Cells send their code to the windows they belong to and one aggregate per
window collects the votes.  That takes one shuffle on (by, row, col), which is
spread evenly however large a group is, and no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from heatloom.operators.groups import DEFAULT_BY, GroupProfile, ensure_profile, join_stats



def moore_neighbors(cells: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """Pairs (cell_id, neighbor_id) of the up to eight adjacent cells."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"))
                      for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)])
    moved = cells.select(*by, "cell_id", "row", "col", F.explode(steps).alias("_s")).select(
        *by, "cell_id", (F.col("row") + F.col("_s.dr")).alias("row"), (F.col("col") + F.col("_s.dc")).alias("col")
    )
    return moved.join(
        cells.select(*by, "row", "col", F.col("cell_id").alias("neighbor_id")), [*by, "row", "col"]
    ).select(*by, "cell_id", "neighbor_id")


def _targets(i: Column, lo: Column, hi: Column, half: int) -> Column:
    """Window centres that read index ``i`` and how often, with edges replicated."""
    centres = F.sequence(F.greatest(lo, i - half), F.least(hi, i + half))

    def votes(t: Column) -> Column:
        gap = i - t
        first = F.when(i == lo, F.lit(-half)).otherwise(gap)
        last = F.when(i == hi, F.lit(half)).otherwise(gap)
        return F.struct(t.alias("t"), (last - first + 1).alias("m"))

    return F.transform(centres, votes)


def _votes(
    cells: DataFrame, code: str, half: int, by: Sequence[str], profile: GroupProfile
) -> DataFrame:
    """Votes per (window, code) with the code of the window's own cell marked."""
    bounds = cells.groupBy(*by).agg(
        F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1")
    )
    placed = join_stats(cells.select(*by, "row", "col", code), bounds, by, profile)
    sent = (
        placed.select("*", F.explode(_targets(F.col("row"), F.col("_r0"), F.col("_r1"), half)).alias("_tr"))
        .select("*", F.explode(_targets(F.col("col"), F.col("_c0"), F.col("_c1"), half)).alias("_tc"))
        .select(
            *by, F.col("_tr.t").alias("_row"), F.col("_tc.t").alias("_col"), F.col(code).cast("long").alias("_code"),
            (F.col("_tr.m") * F.col("_tc.m")).cast("long").alias("_w"),
            ((F.col("_tr.t") == F.col("row")) & (F.col("_tc.t") == F.col("col"))).cast("int").alias("_own"),
        )
    )
    # One exchange on the window serves both this aggregate and the next.
    return sent.repartition(*by, "_row", "_col").groupBy(*by, "_row", "_col", "_code").agg(
        F.sum("_w").alias("_w"), F.max("_own").alias("_own")
    )


def _best(weight: Column) -> Column:
    """The code with the largest vote, the lowest one on ties; rows without a weight do not stand."""
    return F.max_by("_code", F.when(weight.isNotNull(), F.struct(weight, -F.col("_code"))))


def majority_filter(
    cells: DataFrame, code: str = "code", window: int = 3, by: Sequence[str] = DEFAULT_BY,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Most frequent code of the window including the centre, edges replicated.

    Returns (by, row, col, code); the lowest code wins ties.
    """
    if window % 2 == 0:
        raise ValueError(f"window must be odd, got {window}")
    profile = ensure_profile(cells, by, profile)
    out = _votes(cells, code, window // 2, by, profile).groupBy(*by, "_row", "_col").agg(
        _best(F.col("_w")).alias("_best"), F.max("_own").alias("_own")
    )
    return out.where(F.col("_own") == 1).select(
        *by, F.col("_row").alias("row"), F.col("_col").alias("col"), F.col("_best").cast("int").alias(code)
    )


def majority_filter_sticky(
    cells: DataFrame, code: str = "code", by: Sequence[str] = DEFAULT_BY, keep_from: int = 6,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Keep a code shared by at least six of the eight neighbours, else take their most frequent one.

    The centre does not vote; negative codes are ignored; the lowest code wins ties.
    """
    profile = ensure_profile(cells, by, profile)
    votes = _votes(cells, code, 1, by, profile).withColumn("_w", F.col("_w") - F.col("_own"))
    usable = (F.col("_code") >= 0) & (F.col("_w") > 0)
    out = votes.groupBy(*by, "_row", "_col").agg(
        F.max(F.when(F.col("_own") == 1, F.col("_code"))).alias("_centre"),
        F.max(F.when(F.col("_own") == 1, F.col("_w"))).alias("_same"),
        _best(F.when(usable, F.col("_w"))).alias("_best"),
    )
    mode = F.coalesce(F.col("_best").cast("int"), F.lit(0))
    return out.where(F.col("_centre").isNotNull()).select(
        *by, F.col("_row").alias("row"), F.col("_col").alias("col"),
        F.when(F.col("_same") >= keep_from, F.col("_centre").cast("int")).otherwise(mode).alias(code),
    )


def square_layout(
    cells: DataFrame, index: str, code: str = "code", by: Sequence[str] = DEFAULT_BY
) -> DataFrame:
    """Lay a flat sequence of codes on the smallest square, padded with code 0.

    ``index`` counts from 0 without gaps.  At most 2 * sqrt(n) padding rows arise.
    """
    n = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_side", F.ceil(F.sqrt(F.col("_n").cast("double"))).cast("long"))
    pad = n.where(F.col("_side") * F.col("_side") > F.col("_n")).select(
        *by, F.explode(F.sequence(F.col("_n"), F.col("_side") * F.col("_side") - 1)).alias(index),
        F.lit(0).alias(code), F.lit(True).alias("is_padding"),
    )
    rows = cells.select(*by, F.col(index).cast("long").alias(index), F.col(code).cast("int").alias(code),
                        F.lit(False).alias("is_padding"))
    return rows.unionByName(pad).join(n.select(*by, "_side"), list(by)).select(
        *by, index, code, "is_padding",
        F.floor(F.col(index) / F.col("_side")).cast("int").alias("row"),
        (F.col(index) % F.col("_side")).cast("int").alias("col"),
    )
