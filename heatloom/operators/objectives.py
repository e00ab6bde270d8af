"""Objectives and constraints of intervention plans, for all candidates in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from heatloom import constants as C
from heatloom.functions.basic import clamp
from heatloom.functions.heat import attributable_deaths, attributable_fraction
from heatloom.operators.groups import GroupProfile, ensure_profile, join_stats
from heatloom.operators.interventions import plan_profile, post_intervention_state
from heatloom.operators.lookups import small_rows
from heatloom.operators.ordering import percentiles, row_numbers

SOLUTION = ("solution_id",)


def unit_values(params: DataFrame) -> dict[str, dict[str, float]]:
    """Mode cost, carbon and stormwater value per intervention (a few dozen numbers)."""
    names = {"cost_per_unit_usd": "cost", "carbon_tCO2_per_unit_per_year": "carbon",
             "stormwater_m3_per_unit_per_year": "storm"}
    out: dict[str, dict[str, float]] = {}
    for r in small_rows(params.where(F.col("parameter_name").isin(list(names)))):
        out.setdefault(r["intervention_key"], {})[names[r["parameter_name"]]] = float(r["value_mode"])
    return out


def _per_unit(values: dict[str, float]) -> Column:
    """Value of a row's intervention as a literal map lookup; unknown interventions count zero."""
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, F.col("intervention_key")), F.lit(0.0))


def plan_cost(values: dict[str, dict[str, float]]) -> Column:
    return F.coalesce(F.sum(F.col("qty") * _per_unit({k: v.get("cost", 0.0) for k, v in values.items()})), F.lit(0.0))


def plan_cobenefit(values: dict[str, dict[str, float]], carbon_usd: float, storm_usd: float) -> Column:
    worth = {k: v.get("carbon", 0.0) * carbon_usd + v.get("storm", 0.0) * storm_usd for k, v in values.items()}
    return F.coalesce(F.sum(F.col("qty") * _per_unit(worth)), F.lit(0.0))


def f1_mortality(post: DataFrame, by: Sequence[str] = SOLUTION) -> DataFrame:
    """Share of baseline deaths not prevented, from (ad_post, ad_baseline)."""
    return post.groupBy(*by).agg(f1_expr().alias("f1"))


def f1_expr(post: str = "ad_post", base: str = "ad_baseline") -> Column:
    prevented = F.sum(F.when(F.col(base).isNotNull() & F.col(post).isNotNull(),
                             F.greatest(F.lit(0.0), F.col(base) - F.col(post))))
    whole = F.sum(base)
    ratio = 1.0 - F.coalesce(prevented, F.lit(0.0)) / F.when(whole >= 1e-9, whole)
    return F.coalesce(clamp(ratio, 0.0, 1.0), F.lit(0.0))


def f2_cost(decisions: DataFrame, params: DataFrame, budget: float, by: Sequence[str] = SOLUTION) -> DataFrame:
    """Cost of a plan as a share of the budget."""
    share = plan_cost(unit_values(params)) / budget if budget >= 1e-9 else F.max(F.lit(1.0))
    return decisions.groupBy(*by).agg(share.alias("f2"))


def gini_expr(value: str, number: str) -> Column:
    """Gini coefficient from values and their positions in ascending order, within [0, 1].

    0 below two values and where the values sum to zero.
    """
    n, s = F.count(value).cast("double"), F.sum(value)
    g = 2.0 * F.sum(F.col(number) * F.col(value)) / (n * F.when(s != 0, s)) - (n + 1.0) / n
    return F.when(n >= 2, F.coalesce(clamp(g, 0.0, 1.0), F.lit(0.0))).otherwise(0.0)


def f3_gini(
    post: DataFrame, by: Sequence[str] = SOLUTION, tie: str = "zone_id", deaths: str = "ad_post",
    population: str = "population", profile: GroupProfile | None = None, name: str = "f3",
) -> DataFrame:
    """Inequality of residual deaths per person."""
    risk = F.col(deaths) / F.greatest(F.coalesce(F.col(population), F.lit(1.0)), F.lit(1.0))
    rows = post.select(*by, tie, risk.alias("_risk")).where(F.col("_risk").isNotNull())
    ranked = row_numbers(rows, "_risk", tie, by, profile, name="_i")
    return ranked.groupBy(*by).agg(gini_expr("_risk", "_i").alias(name))


def f4_cobenefit(
    decisions: DataFrame, params: DataFrame, budget: float, by: Sequence[str] = SOLUTION,
    carbon_usd: float = C.CARBON_PRICE_USD, storm_usd: float = C.STORMWATER_USD_PER_M3,
) -> DataFrame:
    """Negative yearly co-benefit per unit of budget."""
    worth = plan_cobenefit(unit_values(params), carbon_usd, storm_usd)
    return decisions.groupBy(*by).agg((-(worth / (budget + 1e-9))).alias("f4"))


def scenario_deaths(
    scenarios: Sequence[tuple], cdr: float, beta: float, mmt: Column, lam: float,
    lst: str = "lst_post", hvi: str = "hvi_post", population: str = "population",
) -> list[Column]:
    """Expected deaths of a row under each scenario, as one column per scenario.

    The few scenarios stay columns, so no row is multiplied.
    """
    out = []
    for _, warming, people, days, _ in scenarios:
        af = attributable_fraction(F.col(lst) + warming, mmt, F.col(hvi), F.lit(beta), lam)
        out.append(attributable_deaths(F.col(population) * people, F.lit(cdr), af, days))
    return out


def spread_expr(totals: list[Column]) -> Column:
    """(max - min) / max(|min|, 1) over scenario totals."""
    if len(totals) < 2:
        return F.lit(0.0)
    lo, hi = F.least(*totals), F.greatest(*totals)
    return (hi - lo) / F.greatest(F.abs(lo), F.lit(1.0))


def f5_robustness(
    post: DataFrame, scenarios: Sequence[tuple] = tuple(C.SCENARIOS), by: Sequence[str] = SOLUTION,
    cdr: float = C.CDR_DEFAULT, beta: float = C.BETA_BY_ZONE["A"], mmt: Column | float = C.MMT_FALLBACK_C,
    lam: float = C.LAMBDA_HVI,
) -> DataFrame:
    """Spread of total deaths over the scenarios."""
    m = mmt if isinstance(mmt, Column) else F.lit(float(mmt))
    ads = scenario_deaths(scenarios, cdr, beta, m, lam)
    sums = [F.coalesce(F.sum(a), F.lit(0.0)) for a in ads]
    return post.groupBy(*by).agg(spread_expr(sums).alias("f5"))


def c1_budget(decisions: DataFrame, params: DataFrame, budget: float, by: Sequence[str] = SOLUTION) -> DataFrame:
    """Cost above the budget."""
    return decisions.groupBy(*by).agg((plan_cost(unit_values(params)) - budget).alias("c1"))


def c2_area(decisions: DataFrame, bounds: DataFrame, by: Sequence[str] = SOLUTION, zone: Sequence[str] = ("zone_id",)) -> DataFrame:
    """Largest excess over the feasible quantity, summed over zones per intervention.

    ``bounds`` has (zone, intervention_key, max_qty).
    """
    joined = decisions.join(bounds, [*zone, "intervention_key"])
    excess = F.greatest(F.lit(0.0), F.col("qty") - F.col("max_qty"))
    per = joined.groupBy(*by, "intervention_key").agg(F.sum(excess).alias("_x"))
    return per.groupBy(*by).agg(F.max("_x").alias("c2"))


def _exclusive(trees: Column, bgi: Column) -> Column:
    return F.greatest(F.lit(0.0), trees + bgi - 1.2 * F.greatest(trees, bgi))


def c3_exclusive(decisions: DataFrame, by: Sequence[str] = SOLUTION, zone: Sequence[str] = ("zone_id",)) -> DataFrame:
    """Trees and blue-green areas beyond 120 % of the larger of both, over all zones."""
    qty = lambda key: F.coalesce(F.sum(F.when(F.col("intervention_key") == key, F.col("qty"))), F.lit(0.0))
    per = decisions.groupBy(*by, *zone).agg(qty("LR1_tree_planting").alias("_a"), qty("LR3_bgi").alias("_b"))
    return per.groupBy(*by).agg(F.sum(_exclusive(F.col("_a"), F.col("_b"))).alias("c3"))


def c4_min_viable(decisions: DataFrame, minimum: dict[str, float] | float = 1.0, by: Sequence[str] = SOLUTION) -> DataFrame:
    """Number of quantities above zero but below the smallest viable unit."""
    least = _per_unit(minimum) if isinstance(minimum, dict) else F.lit(float(minimum))
    small = (F.col("qty") > 0) & (F.col("qty") < least)
    return decisions.groupBy(*by).agg(F.sum(small.cast("double")).alias("c4"))


def infeasible_semi(candidates: DataFrame, constraints: Sequence[str] = ("c1", "c2", "c3"), tolerance: float = 0.0) -> DataFrame:
    """Candidates that keep all constraints."""
    worst = F.greatest(*[F.col(c) for c in constraints]) if len(constraints) > 1 else F.col(constraints[0])
    return candidates.where(worst <= tolerance)


def short_run_objectives(
    decisions: DataFrame,
    zones: DataFrame,
    params: DataFrame,
    budget: float,
    k_medical: float = 3.0,
    by: Sequence[str] = SOLUTION,
    hri_p75: Column | None = None,
    profile: GroupProfile | None = None,
    area: Sequence[str] = (),
) -> DataFrame:
    """Coverage gap, cost share and inequality of emergency plans, with two constraints.

    ``decisions`` has (by, area, zone_id, intervention_key, qty) of short-run keys;
    ``zones`` has (area, zone_id, hri, elderly_frac, population).  The risk threshold is
    the 75th percentile over the zones of each area, or over all zones without ``area``,
    unless given.  With ``area`` a plan of several areas is scored in each of them.
    """
    area = list(area)
    by, place = [*area, *by], [*area, "zone_id"]
    values = unit_values(params)
    qty = {k: F.coalesce(F.sum(F.when(F.col("intervention_key") == k, F.col("qty"))), F.lit(0.0)) for k in C.SHORT_RUN_KEYS}
    per_zone = decisions.groupBy(*by, "zone_id").agg(
        qty["SR1_cooling_center"].alias("_cool"), qty["SR5_shade_structure"].alias("_shade"),
        qty["SR4_medical_prepositioning"].alias("_med"), plan_cost(values).alias("_cost"),
    )
    side = zones.select(*place, "hri", "elderly_frac", "population")
    if hri_p75 is None:
        keyed = side if area else side.withColumn("_all", F.lit(0))
        own = area or ["_all"]
        sizes = ensure_profile(keyed, own, None)
        risk = percentiles(keyed, ["hri"], [0.75], own, sizes).select(*own, F.coalesce(F.col("hri_p")[0], F.lit(0.0)).alias("_p75"))
        if area:
            side, hri_p75 = join_stats(side, risk, area, sizes), F.col("_p75")
        else:
            hri_p75 = F.coalesce(risk.select("_p75").scalar(), F.lit(0.0))
    state = per_zone.join(side, place)
    cover = F.least(F.lit(1.0), 0.3 * (F.col("_cool") + F.col("_shade")))
    state = state.withColumns({
        "_cover": cover,
        "_prio": F.when(F.col("hri") >= hri_p75, F.col("elderly_frac")).otherwise(0.0),
    }).withColumn("_rest", F.col("hri") * (1.0 - F.col("_cover")))
    gini = f3_gini(state, by, "zone_id", "_rest", "population", profile, "f3")
    sums = state.groupBy(*by).agg(
        (1.0 - F.sum(F.col("_prio") * F.col("_cover")) / F.greatest(F.sum("_prio"), F.lit(1.0))).alias("f1"),
        (F.sum("_cost") / max(budget, 1.0)).alias("f2"),
        (F.sum("_cost") - budget).alias("c1"),
        F.sum(F.greatest(F.lit(0.0), F.col("_med") - k_medical)).alias("c2"),
    )
    return sums.join(gini, list(by)).select(*by, "f1", "f2", "f3", "c1", "c2")


def long_run_objectives(
    decisions: DataFrame,
    zones: DataFrame,
    bounds: DataFrame,
    params: DataFrame,
    effects: DataFrame,
    budget: float,
    n_draws: int = C.PLAN_DRAWS,
    scenarios: Sequence[tuple] = tuple(C.SCENARIOS),
    solution: Sequence[str] = SOLUTION,
    zone: Sequence[str] = ("zone_id",),
    cdr: float = C.CDR_DEFAULT,
    beta: float = C.BETA_BY_ZONE["A"],
    mmt: Column | float = C.MMT_FALLBACK_C,
    lam: float = C.LAMBDA_HVI,
    profile: GroupProfile | None = None,
    compat: bool = False,
) -> DataFrame:
    """Five objectives and three constraints of all candidates.

    Solutions x zones x draws are the rows of one table; scenarios are columns.
    Everything per (solution, draw) shares one partitioning: the index range, the
    ranks of the inequality measure and the sums.  Draws are averaged last.
    """
    plan = [*solution, "draw_id"]
    if profile is None:
        profile = plan_profile(decisions, solution, zone, n_draws)
    state = post_intervention_state(zones, decisions, effects, n_draws, solution, zone, compat=compat, profile=profile)
    m = mmt if isinstance(mmt, Column) else F.lit(float(mmt))
    days = scenarios[0][3] if scenarios else float(C.EVENT_DAYS)
    af = attributable_fraction(F.col("lst_post"), m, F.col("hvi_post"), F.lit(beta), lam)
    ads = scenario_deaths(scenarios, cdr, beta, m, lam)
    rows = state.select(
        *plan, *zone, "population", "ad_baseline",
        attributable_deaths(F.col("population"), F.lit(cdr), af, days).alias("ad_post"),
        *[a.alias(f"_ad_{i}") for i, a in enumerate(ads)],
    )
    risk = F.col("ad_post") / F.greatest(F.coalesce(F.col("population"), F.lit(1.0)), F.lit(1.0))
    ranked = row_numbers(rows.withColumn("_risk", risk), "_risk", zone[-1], plan, profile, name="_i")
    per_draw = ranked.groupBy(*plan).agg(
        f1_expr().alias("f1"), gini_expr("_risk", "_i").alias("f3"),
        spread_expr([F.coalesce(F.sum(f"_ad_{i}"), F.lit(0.0)) for i in range(len(ads))]).alias("f5"),
    )
    averaged = per_draw.groupBy(*solution).agg(F.avg("f1").alias("f1"), F.avg("f3").alias("f3"), F.avg("f5").alias("f5"))
    fixed = plan_terms(decisions, bounds, params, budget, solution, zone)
    return averaged.join(fixed, list(solution)).select(
        *solution, "f1", "f2", "f3", "f4", "f5", "c1", "c2", "c3"
    )


def plan_terms(
    decisions: DataFrame, bounds: DataFrame, params: DataFrame, budget: float,
    solution: Sequence[str] = SOLUTION, zone: Sequence[str] = ("zone_id",),
) -> DataFrame:
    """The terms without draws - f2, f4, c1, c2, c3 - from one pass over the decisions."""
    values = unit_values(params)
    keys = C.LONG_RUN_KEYS
    joined = decisions.join(bounds.select(*zone, "intervention_key", "max_qty"), [*zone, "intervention_key"], "left")
    qty = lambda key: F.coalesce(F.sum(F.when(F.col("intervention_key") == key, F.col("qty"))), F.lit(0.0))
    excess = lambda key: F.coalesce(F.sum(F.when(
        (F.col("intervention_key") == key) & F.col("max_qty").isNotNull(),
        F.greatest(F.lit(0.0), F.col("qty") - F.col("max_qty")))), F.lit(0.0))
    per_zone = joined.groupBy(*solution, *zone).agg(
        plan_cost(values).alias("_cost"),
        plan_cobenefit(values, C.CARBON_PRICE_USD, C.STORMWATER_USD_PER_M3).alias("_worth"),
        qty("LR1_tree_planting").alias("_a"), qty("LR3_bgi").alias("_b"),
        *[excess(k).alias(f"_x{i}") for i, k in enumerate(keys)],
    )
    return per_zone.groupBy(*solution).agg(
        (F.sum("_cost") / budget if budget >= 1e-9 else F.max(F.lit(1.0))).alias("f2"),
        (-(F.sum("_worth") / (budget + 1e-9))).alias("f4"),
        (F.sum("_cost") - budget).alias("c1"),
        F.greatest(*[F.sum(f"_x{i}") for i in range(len(keys))]).alias("c2"),
        F.sum(_exclusive(F.col("_a"), F.col("_b"))).alias("c3"),
    )
