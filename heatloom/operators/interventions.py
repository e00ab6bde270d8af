"""Sampled intervention effects and the state of zones after interventions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from heatloom import constants as C
from heatloom.functions.basic import total
from heatloom.functions.random import triangular, uniform
from heatloom.operators.groups import GroupProfile, ensure_profile, join_stats

SPATIAL = "A_spatial_effects"
COST = "C_cost"
EFFECTS = {  # effect column: parameter name
    "d_lst": "delta_LST_per_unit", "d_ndvi": "delta_NDVI_per_unit",
    "d_tree": "delta_tree_cover_per_unit", "d_ndwi": "delta_NDWI_per_unit",
}
# State column changed by an effect, with its limits.
CHANGES = {
    "lst": ("d_lst", None, None), "ndvi": ("d_ndvi", 0.0, 1.0),
    "tree_cover": ("d_tree", 0.0, 100.0), "ndwi": ("d_ndwi", -1.0, 1.0),
}


def with_draws(df: DataFrame, n: int, first: int = 0) -> DataFrame:
    """Every row once per draw."""
    return df.select("*", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("draw_id"))


def _sampled(params: DataFrame, n: int, seed: int, method: str, compat: bool) -> DataFrame:
    """Triangular draw per parameter row.

    Triples may be listed in descending order (cooling is negative).  They are
    sorted first; ``compat`` keeps the order, so a descending triple yields its mode.
    """
    lo, mode, hi = F.col("value_min"), F.col("value_mode"), F.col("value_max")
    low, high = (lo, hi) if compat else (F.least(lo, hi), F.greatest(lo, hi))
    u = uniform(seed, "draw_id", "intervention_key", "parameter_name", method=method)
    return with_draws(params, n).withColumn("value", triangular(u, low, mode, high))


def sample_effectiveness(
    params: DataFrame, n: int = 1, seed: int = 42, method: str = "xxhash64", compat: bool = False
) -> DataFrame:
    """(draw_id, intervention_key, parameter_name, value) for the spatial effects."""
    rows = params.where(F.col("parameter_group") == SPATIAL)
    return _sampled(rows, n, seed, method, compat).select("draw_id", "intervention_key", "parameter_name", "value")


def sample_costs(
    params: DataFrame, n: int = 1, seed: int = 42, method: str = "xxhash64", compat: bool = False
) -> DataFrame:
    """(draw_id, intervention_key, cost) for the unit costs."""
    rows = params.where((F.col("parameter_group") == COST) & (F.col("parameter_name") == "cost_per_unit_usd"))
    return _sampled(rows, n, seed, method, compat).select("draw_id", "intervention_key", F.col("value").alias("cost"))


def effect_table(
    params: DataFrame, n: int, seed: int = 42, method: str = "xxhash64", compat: bool = False,
    keys: Sequence[str] = tuple(C.LONG_RUN_KEYS), modes: bool = False,
) -> DataFrame:
    """One row per draw with a column ``<effect>_<i>`` per effect and intervention.

    A few dozen numbers per draw.  With ``modes`` the modes are used instead of draws.
    """
    sampled = sample_effectiveness(params, n, seed, method, compat)
    if modes:
        sampled = with_draws(params.where(F.col("parameter_group") == SPATIAL), n).withColumn("value", F.col("value_mode"))
    aggs = [
        F.coalesce(F.max(F.when(
            (F.col("intervention_key") == key) & (F.col("parameter_name") == name), F.col("value")
        )), F.lit(0.0)).alias(f"{effect}_{i}")
        for i, key in enumerate(keys) for effect, name in EFFECTS.items()
    ]
    return sampled.groupBy("draw_id").agg(*aggs)


def decisions_wide(
    decisions: DataFrame, by: Sequence[str], keys: Sequence[str] = tuple(C.LONG_RUN_KEYS)
) -> DataFrame:
    """One row per (by) with a quantity column ``q_<i>`` per intervention."""
    return decisions.groupBy(*by).agg(*[
        F.coalesce(F.sum(F.when(F.col("intervention_key") == key, F.col("qty"))), F.lit(0.0)).alias(f"q_{i}")
        for i, key in enumerate(keys)
    ])


def _apply(column: str, effect: str, lo: float | None, hi: float | None, n: int) -> Column:
    """Effects of all interventions in order; limits hold after each one that has an effect.

    Every step refers to the step before only once, so the expression grows with
    the number of interventions and not with its power.
    """
    out = f"cast({column} as double)"
    for i in range(n):
        moved = f"({out} + q_{i} * {effect}_{i})"
        if lo is None:
            out = moved
        else:
            low = f"if({effect}_{i} = 0, double('-infinity'), {lo}D)"
            high = f"if({effect}_{i} = 0, double('infinity'), {hi}D)"
            out = f"least(greatest({moved}, {low}), {high})"
    return F.expr(f"if({column} is null, null, {out})")


def _draw_effects(rows: DataFrame, effects: DataFrame, n_draws: int) -> DataFrame:
    """Every row once per draw, with the effects of that draw (n_draws rows, broadcast)."""
    return with_draws(rows, n_draws).join(F.broadcast(effects), "draw_id")


def post_state(
    zones: DataFrame,
    decisions: DataFrame,
    effects: DataFrame,
    n_draws: int = 1,
    solution: Sequence[str] = ("solution_id",),
    zone: Sequence[str] = ("zone_id",),
    keys: Sequence[str] = tuple(C.LONG_RUN_KEYS),
    compat: bool = False,
) -> DataFrame:
    """Zone state after a plan, before the index is rescaled.

    ``zones`` has (zone, indicators, e, s, ...), ``decisions`` one or more rows
    per (solution, zone, intervention), ``effects`` one row per draw.  Adds
    lst_post, ndvi_post, tree_cover_post, ndwi_post, ac_post and hvi_raw_post.
    Moisture effects are applied unless ``compat``.

    Rows are solutions x zones x draws.  The interventions stay columns, so a row
    is finished in one projection.
    """
    rows = _draw_effects(decisions_wide(decisions, [*solution, *zone], keys).join(zones, list(zone)), effects, n_draws)
    out = rows.withColumns({
        f"{c}_post": F.col(c).cast("double") if compat and c == "ndwi" else _apply(c, effect, lo, hi, len(keys))
        for c, (effect, lo, hi) in CHANGES.items() if c in zones.columns
    })
    parts = {c: (f"{c}_post" if f"{c}_post" in out.columns else c) for c in C.ADAPTIVE_WEIGHTS if c in zones.columns}
    weight = sum(C.ADAPTIVE_WEIGHTS[c] for c in parts)
    ac = total([F.col(name) * C.ADAPTIVE_WEIGHTS[c] for c, name in parts.items()]) / weight
    out = out.withColumn("ac_post", ac)
    floor = F.greatest(F.coalesce(F.col("ac_post"), F.lit(C.AC_FLOOR)), F.lit(C.AC_FLOOR))
    out = out.withColumn("hvi_raw_post", F.col("e") * F.col("s") / floor)
    helpers = [f"q_{i}" for i in range(len(keys))] + [f"{e}_{i}" for e in EFFECTS for i in range(len(keys))]
    return out.drop(*helpers)


def with_hvi_post(state: DataFrame, by: Sequence[str], profile: GroupProfile) -> DataFrame:
    """Add hvi_post: the raw index scaled over the zones of one solution and draw.

    ``profile`` counts the zones of the plans.  Plans that fit into a task are scaled by
    a window; for larger ones the range is an aggregate that is joined back.
    """
    if profile.direct:
        plan = W.partitionBy(*by)
        out = state.withColumns({"_lo": F.min("hvi_raw_post").over(plan), "_hi": F.max("hvi_raw_post").over(plan)})
    else:
        out = join_stats(state, state.groupBy(*by).agg(F.min("hvi_raw_post").alias("_lo"), F.max("hvi_raw_post").alias("_hi")), by, profile)
    v, lo, hi = F.col("hvi_raw_post"), F.col("_lo"), F.col("_hi")
    scaled = F.when(v.isNotNull(), F.when(hi > lo, (v - lo) / (hi - lo + 1e-12)).otherwise(0.5))
    return out.withColumn("hvi_post", scaled).drop("_lo", "_hi")


def plan_profile(decisions: DataFrame, solution: Sequence[str], zone: Sequence[str], n_draws: int = 1) -> GroupProfile:
    """Plans and draws, and the zones of the largest plan."""
    return ensure_profile(decisions.select(*solution, *zone).distinct(), solution, None).scaled(groups=n_draws)


def post_intervention_state(
    zones: DataFrame,
    decisions: DataFrame,
    effects: DataFrame,
    n_draws: int = 1,
    solution: Sequence[str] = ("solution_id",),
    zone: Sequence[str] = ("zone_id",),
    keys: Sequence[str] = tuple(C.LONG_RUN_KEYS),
    compat: bool = False,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Zone state after a plan, including hvi_post; ``profile`` as of ``plan_profile``."""
    profile = profile or plan_profile(decisions, solution, zone, n_draws)
    state = post_state(zones, decisions, effects, n_draws, solution, zone, keys, compat)
    return with_hvi_post(state, [*solution, "draw_id"], profile)


def candidate_portfolios(
    bounds: DataFrame,
    n: int,
    budget: float,
    seed: int = 42,
    zone: Sequence[str] = ("zone_id",),
    method: str = "xxhash64",
) -> DataFrame:
    """Seeded plans within [0, max_qty] per zone and intervention, scaled into the budget.

    ``bounds`` has (zone, intervention_key, max_qty, unit_cost).  A plan above the
    budget is shrunk as a whole.  Costs are summed per plan with a map-side
    combine, and one number per plan is joined back.
    """
    plans = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("solution_id"))
    u = uniform(seed, "solution_id", *zone, "intervention_key", method=method)
    plans = plans.withColumn("qty", u * F.col("max_qty"))
    cost = plans.groupBy("solution_id").agg(F.sum(F.col("qty") * F.col("unit_cost")).alias("_cost"))
    scale = F.when(F.col("_cost") > budget, F.lit(float(budget)) / F.col("_cost")).otherwise(1.0)
    side = F.broadcast(cost) if n <= 200_000 else cost
    return plans.join(side, "solution_id").select(
        "solution_id", *zone, "intervention_key", (F.col("qty") * scale).alias("qty")
    )


def decisions_long(solutions: DataFrame, n_interventions: int, keys: Sequence[str] = tuple(C.LONG_RUN_KEYS)) -> DataFrame:
    """Rows (solution_id, zone_id, k, intervention_key, qty) of flat decision vectors ``x``."""
    names = F.array(*[F.lit(k) for k in keys])
    flat = solutions.select("solution_id", F.posexplode("x").alias("pos", "qty"))
    k = F.col("pos") % n_interventions
    return flat.select(
        "solution_id", F.floor(F.col("pos") / n_interventions).cast("int").alias("zone_id"),
        (k + 1).alias("k"), F.get(names, k).alias("intervention_key"), "qty",
    )


def decisions_flat(decisions: DataFrame, n_interventions: int) -> DataFrame:
    """The flat decision vector of every solution, in zone and intervention order."""
    pos = F.col("zone_id").cast("long") * n_interventions + F.col("k") - 1
    return decisions.groupBy("solution_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), "qty"))), lambda s: s["qty"]).alias("x")
    )
