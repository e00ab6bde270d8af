"""Sub-indices and the heat vulnerability index (HVI)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from heatloom import constants as C
from heatloom.operators.groups import DEFAULT_BY, GroupProfile, ensure_profile, join_stats
from heatloom.operators.normalize import minmax_norm, present, robust_normalize
from heatloom.operators.ordering import percentiles
from heatloom.operators.rundir import cut_lineage, stage
from heatloom.operators.weights import Weights, check_manual, compute_weights, equal_weights_map


def subindex(weights: Mapping[str, str | float]) -> Column:
    """Weighted mean over the indicators that are present in a cell; NULL if none is.

    A weight is a number or the name of a column.
    """
    w = {c: f"`{v}`" if isinstance(v, str) else f"{float(v)!r}D" for c, v in weights.items()}
    summed = " + ".join(f"coalesce(`{c}` * {v}, 0.0D)" for c, v in w.items())
    used = " + ".join(f"if(`{c}` is null, 0.0D, {v})" for c, v in w.items())
    return F.expr(f"case when {used} > 1e-12D then ({summed}) / ({used}) end")


def hvi_formula(e: Column, s: Column, ac: Column, floor: float = C.AC_FLOOR) -> Column:
    """E * S / max(AC, floor); NULL where any part is missing."""
    if floor <= 0:
        raise ValueError("the floor of the adaptive capacity must be positive")
    return F.when(ac.isNotNull(), e * s / F.greatest(ac, F.lit(floor)))


def with_subindices(
    normed: DataFrame,
    method: str = "equal",
    by: Sequence[str] = DEFAULT_BY,
    user_weights: Weights | None = None,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Add h_s, e, s and ac to normalised indicators.

    Equal and manual weights are literals of the projection.  Data-driven
    weights are one row per group and are joined back.
    """
    columns = [c for c in C.INDICATORS if c in normed.columns]
    if method in ("equal", "manual"):
        maps = (equal_weights_map(columns) if method == "equal"
                else check_manual(user_weights or C.SUB_INDEX_WEIGHTS))
        return normed.withColumns({
            C.SUB_INDEX_COLUMN[s]: subindex({c: w for c, w in maps[s].items() if c in columns})
            for s in C.SUB_INDEX_WEIGHTS
        })
    profile = ensure_profile(normed, by, profile)
    long = compute_weights(normed, method, by, user_weights, profile)
    # One row per group, read by every later pass over the cells: computed once.
    wide = cut_lineage(long.groupBy(*by).agg(
        *[F.max(F.when(F.col("indicator") == c, F.col("w"))).alias(f"_w_{c}") for c in columns]
    ))
    joined = join_stats(normed, wide, by, profile)
    return joined.withColumns({
        C.SUB_INDEX_COLUMN[s]: subindex({c: f"_w_{c}" for c in group if c in columns})
        for s, group in C.SUB_INDEX_WEIGHTS.items()
    }).drop(*[f"_w_{c}" for c in columns])


def hvi(
    cells: DataFrame,
    method: str = "equal",
    by: Sequence[str] = DEFAULT_BY,
    user_weights: Weights | None = None,
    profile: GroupProfile | None = None,
    allow_missing: bool = False,
    directions: Mapping[str, str] | None = None,
    keep: Sequence[str] = ("cell_id",),
) -> DataFrame:
    """Heat vulnerability index of every cell.

    ``keep`` names columns to carry along; raw indicators may be among them.
    Returns by, keep, the normalised indicators as ``n_<indicator>``, h_s, e, s,
    ac, hvi_raw and hvi.  Two aggregates per group are computed: the clipping
    percentiles, and the range of the raw index.
    """
    columns = present(cells, C.INDICATORS, allow_missing)
    profile = ensure_profile(cells, by, profile)
    keys = list(dict.fromkeys([*by, *keep, *(["cell_id"] if method == "critic" else [])]))
    raw = [c for c in keys if c in columns]
    base = cells.select(
        *[c for c in keys if c not in raw], *columns, *[F.col(c).alias(f"_raw_{c}") for c in raw]
    )
    # The percentiles feed both the range of the index and the result.  Written
    # once, they are not computed again for either.
    stats = cut_lineage(percentiles(base, columns, C.CLIP_PERCENTILES, by, profile))
    normed = robust_normalize(base, columns, by, directions=directions, profile=profile, stats=stats)
    out = with_subindices(normed, method, by, user_weights, profile)
    out = out.withColumn("hvi_raw", hvi_formula(F.col("e"), F.col("s"), F.col("ac")))
    out = out.withColumn("hvi", F.col("hvi_raw"))
    out = minmax_norm(out, ["hvi"], by, profile)
    return out.select(
        *[F.col(f"_raw_{c}").alias(c) if c in raw else F.col(c) for c in keys],
        *[F.col(c).alias(f"n_{c}") for c in columns], "h_s", "e", "s", "ac", "hvi_raw", "hvi"
    )


def weighting_comparison(
    cells: DataFrame,
    methods: Sequence[str] = ("equal", "pca", "entropy", "critic"),
    by: Sequence[str] = DEFAULT_BY,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """HVI of every cell under several weighting schemes, in long form.

    The indicators are normalised once and written, as every scheme reads them
    several times.
    """
    profile = ensure_profile(cells, by, profile)
    normed = stage(robust_normalize(
        cells.select(*by, "cell_id", *C.INDICATORS), C.INDICATORS, by, profile=profile
    ), "normalized")
    out = None
    for m in methods:
        part = with_subindices(normed, m, by, profile=profile).select(
            *by, "cell_id", F.lit(m).alias("method"),
            hvi_formula(F.col("e"), F.col("s"), F.col("ac")).alias("hvi"),
        )
        out = part if out is None else out.unionByName(part)
    return minmax_norm(stage(out, "schemes"), ["hvi"], [*by, "method"], profile.scaled(groups=len(methods)))
