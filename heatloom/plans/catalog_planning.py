"""Queries on intervention plans, uncertainty and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom import constants as C
from heatloom.functions.labels import long_run_key
from heatloom.operators import interventions as I
from heatloom.operators import objectives as O
from heatloom.operators import pareto as P
from heatloom.operators import scenarios as SC
from heatloom.operators import uncertainty as U
from heatloom.operators.lookups import nearest_delta
from heatloom.operators.normalize import robust_normalize
from heatloom.operators.ordering import row_numbers
from heatloom.operators.rundir import run_dir
from heatloom.plans import sqltext as S
from heatloom.plans.catalog_index import MANUAL, cells, indexed
from heatloom.plans.catalog_scenes import NEAREST, PARAM_VALUES
from heatloom.plans.registry import query
from heatloom.plans.views import oracle, view
from heatloom.sources import readers, writers

SEED, DRAWS, PLANS = 42, 50, 100
BUDGET = 4_999_999.0
BETA, CDR, MMT = C.BETA_BY_ZONE["A"], C.CDR_DEFAULT, 30.0
FIVE = list(P.FIVE)


def params(spark):
    return readers.read_intervention_params(spark)


# --- sampling -------------------------------------------------------------------
def triangular_sql(u: str, lo: str, mode: str, hi: str) -> str:
    return (f"case when {hi} - {lo} <= 0 then {mode} when {u} * ({hi} - {lo}) < {mode} - {lo} then {lo} + sqrt({u} * ({hi} - {lo}) * ({mode} - {lo})) "
            f"else {hi} - sqrt((1 - {u}) * ({hi} - {lo}) * ({hi} - {mode})) end")


DRAW_SQL = (
    f"params0 as (select * from (select unnest(range({DRAWS}))::int as draw_id) d, params), "
    f"draws as (select draw_id, intervention_key, parameter_group, parameter_name, "
    f"{triangular_sql(S.uniform(SEED, 'draw_id', 'intervention_key', 'parameter_name'), 'least(value_min, value_max)', 'value_mode', 'greatest(value_min, value_max)')} as value from params0)"
)


@query("sample_effectiveness", oracle("decisions", f""", {PARAM_VALUES}, {DRAW_SQL} select solution_id, draw_id, parameter_name, round(sum(qty * value), 6) as effect
    from decisions join draws using (intervention_key) where parameter_group = 'A_spatial_effects' and starts_with(parameter_name, 'delta_') group by 1, 2, 3"""))
def _(spark, sf):
    eff = I.sample_effectiveness(params(spark), DRAWS, SEED, "md5").where(F.col("parameter_name").startswith("delta_"))
    joined = view(spark, sf, "decisions").join(F.broadcast(eff), "intervention_key")
    return joined.groupBy("solution_id", "draw_id", "parameter_name").agg(F.sum(F.col("qty") * F.col("value")).alias("effect"))


@query("sample_costs", oracle("decisions", f""", {PARAM_VALUES}, {DRAW_SQL} select solution_id, draw_id, round(sum(qty * value) / 1000, 6) as cost_k
    from decisions join draws using (intervention_key) where parameter_name = 'cost_per_unit_usd' group by 1, 2"""))
def _(spark, sf):
    costs = I.sample_costs(params(spark), DRAWS, SEED, "md5")
    joined = view(spark, sf, "decisions").join(F.broadcast(costs), "intervention_key")
    return joined.groupBy("solution_id", "draw_id").agg((F.sum(F.col("qty") * F.col("cost")) / 1000).alias("cost_k"))


# --- state after interventions ------------------------------------------------------
def effect(name: str, key: str) -> str:
    return f"coalesce(max(case when intervention_key = '{key}' and parameter_name = '{name}' then value end), 0)"


def state_sql() -> str:
    keys = list(enumerate(C.LONG_RUN_KEYS))
    eff = ", ".join(f"{effect(name, k)} as {e}_{i}" for i, k in keys for e, name in I.EFFECTS.items())
    qty = ", ".join(f"coalesce(sum(case when intervention_key = '{k}' then qty end), 0) as q_{i}" for i, k in keys)
    cols = []
    for c, (e, lo, hi) in I.CHANGES.items():
        out = f"{c}"
        for i, _ in keys:
            moved = f"({out} + q_{i} * {e}_{i})"
            out = moved if lo is None else f"(case when {e}_{i} <> 0 then least(greatest({moved}, {lo}), {hi}) else {out} end)"
        cols.append(f"{out} as {c}_post")
    ac = " + ".join(f"{c + '_post' if c in I.CHANGES else c} * 0.2::double" for c in C.ADAPTIVE_WEIGHTS)
    return (
        f"eff as (select draw_id, {eff} from draws where parameter_group = 'A_spatial_effects' group by 1), "
        f"wide as (select solution_id, zone_id, {qty} from decisions group by 1, 2), "
        f"st0 as (select solution_id, zone_id, draw_id, population, ad_baseline, e, s, canopy_height, viirs_dnb, {', '.join(cols)} from wide join zone_state using (zone_id), eff), "
        f"st1 as (select *, ({ac}) / 1.0::double as ac_post from st0), "
        f"st2 as (select *, e * s / greatest(coalesce(ac_post, 0.01::double), 0.01::double) as raw from st1), "
        f"state as (select *, case when max(raw) over p > min(raw) over p then (raw - min(raw) over p) / (max(raw) over p - min(raw) over p + 1e-12::double) else 0.5 end as hvi_post "
        f"from st2 window p as (partition by solution_id, draw_id))"
    )


STATE = f", {PARAM_VALUES}, {DRAW_SQL}, {state_sql()}"
ADPOST = f"greatest(population * {CDR}::double * ({S.af('lst_post', '30::double', 'hvi_post', f'{BETA}::double')}) * 3, 0)"
POST = STATE + f", post as (select *, {ADPOST} as ad_post from state)"


def effects(spark, n=DRAWS):
    return I.effect_table(params(spark), n, SEED, "md5")


def state(spark, sf, profile=None):
    return I.post_intervention_state(view(spark, sf, "zone_state"), view(spark, sf, "decisions"), effects(spark), DRAWS, profile=profile)


def post(spark, sf, profile=None):
    from heatloom.functions.heat import attributable_deaths, attributable_fraction

    af = attributable_fraction(F.col("lst_post"), F.lit(MMT), F.col("hvi_post"), F.lit(BETA))
    return state(spark, sf, profile).withColumn("ad_post", attributable_deaths(F.col("population"), F.lit(CDR), af, 3.0))


@query("post_intervention_state", oracle("zone_state decisions", STATE + f" select solution_id, zone_id, draw_id, {S.r6('lst_post', 'ndvi_post', 'tree_cover_post', 'ndwi_post', 'ac_post', 'hvi_post')} from state"))
def _(spark, sf):
    return state(spark, sf).select("solution_id", "zone_id", "draw_id", "lst_post", "ndvi_post", "tree_cover_post", "ndwi_post", "ac_post", "hvi_post")


F1 = "case when sum(ad_baseline) >= 1e-9 then least(greatest(1 - sum(greatest(0, ad_baseline - ad_post)) / sum(ad_baseline), 0), 1) else 0 end"


@query("f1_mortality", oracle("zone_state decisions", POST + f" select solution_id, draw_id, round({F1}, 6)::double as f1 from post group by 1, 2"))
def _(spark, sf):
    return O.f1_mortality(post(spark, sf), ["solution_id", "draw_id"])


UNIT = (f", {PARAM_VALUES}, unit as (select intervention_key, max(case when parameter_name = 'cost_per_unit_usd' then value_mode end) as cost, "
        "coalesce(max(case when parameter_name = 'carbon_tCO2_per_unit_per_year' then value_mode end), 0) * 80 + "
        "coalesce(max(case when parameter_name = 'stormwater_m3_per_unit_per_year' then value_mode end), 0) * 2.5::double as worth from params group by 1)")


@query("f2_cost", oracle("order_plans", UNIT + f" select solution_id, round(sum(qty * cost) / {BUDGET}::double, 6) as f2 from order_plans join unit using (intervention_key) group by 1"))
def _(spark, sf):
    return O.f2_cost(view(spark, sf, "order_plans"), params(spark), BUDGET)


GINI_RANK = "row_number() over (partition by solution_id, draw_id order by ad_post / greatest(population, 1), zone_id)"
GINI = """case when count(*) >= 2 and sum(risk) <> 0 then least(greatest(2 * sum(i * risk) / (count(*) * sum(risk)) - (count(*) + 1) / count(*)::double, 0), 1) else 0 end"""


@query("f3_gini", oracle("zone_state decisions", POST + f", rk as (select solution_id, draw_id, ad_post / greatest(population, 1) as risk, {GINI_RANK} as i from post) select solution_id, draw_id, round({GINI}, 6)::double as f3 from rk group by 1, 2"))
def _(spark, sf):
    plans = I.plan_profile(view(spark, sf, "decisions"), ["solution_id"], ["zone_id"], DRAWS)
    return O.f3_gini(post(spark, sf, plans), ["solution_id", "draw_id"], profile=plans)


@query("gini_rank", oracle("cells", """select aoi_id, cell_id, row_number() over (partition by aoi_id order by round(uhi / population, 6), cell_id)::int as position from cells"""))
def _(spark, sf):
    c = cells(spark, sf).select("aoi_id", "cell_id", F.round(F.col("uhi") / F.col("population"), 6).alias("risk"))
    return row_numbers(c, "risk", "cell_id", name="position").drop("risk")


@query("f4_cobenefit", oracle("order_plans", UNIT + f" select solution_id, round(-(sum(qty * worth) / ({BUDGET}::double + 1e-9::double)), 6) as f4 from order_plans join unit using (intervention_key) group by 1"))
def _(spark, sf):
    return O.f4_cobenefit(view(spark, sf, "order_plans"), params(spark), BUDGET)


def totals_sql() -> str:
    out = []
    for i, (_, t, p, days, _) in enumerate(C.SCENARIOS):
        af = S.af(f"(lst_post + {t}::double)", "30::double", "hvi_post", f"{BETA}::double")
        out.append(f"sum(greatest(population * {p}::double * {CDR}::double * ({af}) * {days}::double, 0)) as t{i}")
    return ", ".join(out)


F5 = "(greatest(t0, t1, t2, t3) - least(t0, t1, t2, t3)) / greatest(abs(least(t0, t1, t2, t3)), 1)"


@query("f5_robustness", oracle("zone_state decisions", STATE + f", tot as (select solution_id, draw_id, {totals_sql()} from state group by 1, 2) select solution_id, draw_id, round({F5}, 6) as f5 from tot"))
def _(spark, sf):
    return O.f5_robustness(state(spark, sf), by=["solution_id", "draw_id"])


@query("c1_budget", oracle("order_plans", UNIT + f" select solution_id, round(sum(qty * cost) - {BUDGET}::double, 6) as c1 from order_plans join unit using (intervention_key) group by 1"))
def _(spark, sf):
    return O.c1_budget(view(spark, sf, "order_plans"), params(spark), BUDGET)


@query("c2_area", oracle("order_plans bounds", """, x as (select solution_id, intervention_key, sum(greatest(0, qty - max_qty / 0.3::double)) as x from order_plans join bounds using (zone_id, intervention_key) group by 1, 2)
    select solution_id, round(max(x), 6) as c2 from x group by 1"""))
def _(spark, sf):
    b = view(spark, sf, "bounds").withColumn("max_qty", F.col("max_qty") / 0.3)
    return O.c2_area(view(spark, sf, "order_plans"), b)


EXCL = """z as (select solution_id, zone_id, coalesce(sum(case when intervention_key = 'LR1_tree_planting' then qty end), 0) as a,
    coalesce(sum(case when intervention_key = 'LR3_bgi' then qty end), 0) as b from decisions group by 1, 2)"""


@query("c3_exclusive", oracle("decisions", f", {EXCL} select solution_id, round(sum(greatest(0, a + b - 1.2::double * greatest(a, b))), 6) as c3 from z group by 1"))
def _(spark, sf):
    return O.c3_exclusive(view(spark, sf, "decisions"))


@query("c4_min_viable", oracle("order_plans", "select solution_id, count(case when qty > 0 and qty < 1 then 1 end)::double as c4 from order_plans group by 1"))
def _(spark, sf):
    return O.c4_min_viable(view(spark, sf, "order_plans"))


@query("infeasible_semi", oracle("candidates", "select solution_id, c1, c2, c3 from candidates where greatest(c1, c2, c3) <= 0"))
def _(spark, sf):
    return O.infeasible_semi(view(spark, sf, "candidates")).select("solution_id", "c1", "c2", "c3")


@query("short_run_objectives", oracle("emergency_plans zone_state", UNIT + """, p as (select quantile_cont(hri, 0.75) as p75 from zone_state),
    z as (select solution_id, zone_id, coalesce(sum(case when intervention_key = 'SR1_cooling_center' then qty end), 0) as cool,
      coalesce(sum(case when intervention_key = 'SR5_shade_structure' then qty end), 0) as shade,
      coalesce(sum(case when intervention_key = 'SR4_medical_prepositioning' then qty end), 0) as med, sum(qty * cost) as cost
      from emergency_plans join unit using (intervention_key) group by 1, 2),
    st as (select z.*, hri, elderly_frac, population, least(1, 0.3::double * (cool + shade)) as cover, case when hri >= p75 then elderly_frac else 0 end as prio
      from z join zone_state using (zone_id), p),
    rk as (select *, hri * (1 - cover) / greatest(population, 1) as risk, row_number() over (partition by solution_id order by hri * (1 - cover) / greatest(population, 1), zone_id) as i from st)
    select solution_id, round(1 - sum(prio * cover) / greatest(sum(prio), 1), 6)::double as f1, round(sum(cost) / 199999, 6) as f2,
    round(""" + GINI + """, 6)::double as f3, round(sum(cost) - 199999, 6) as c1, round(sum(greatest(0, med - 3)), 6)::double as c2 from rk group by 1"""))
def _(spark, sf):
    return O.short_run_objectives(view(spark, sf, "emergency_plans"), view(spark, sf, "zone_state"), params(spark), 199_999.0)


def long_run(spark, sf, n=DRAWS):
    return O.long_run_objectives(
        view(spark, sf, "decisions"), view(spark, sf, "zone_state"), view(spark, sf, "bounds"), params(spark), effects(spark, n),
        BUDGET, n_draws=n)


LONG_RUN = POST + f""", rk as (select *, ad_post / greatest(population, 1) as risk, {GINI_RANK} as i from post),
    d1 as (select solution_id, draw_id, {F1} as f1, {GINI} as f3, {totals_sql()} from rk group by 1, 2),
    d2 as (select solution_id, avg(f1) as f1, avg(f3) as f3, avg({F5}) as f5 from d1 group by 1),
    unit as (select intervention_key, max(case when parameter_name = 'cost_per_unit_usd' then value_mode end) as cost,
      coalesce(max(case when parameter_name = 'carbon_tCO2_per_unit_per_year' then value_mode end), 0) * 80 +
      coalesce(max(case when parameter_name = 'stormwater_m3_per_unit_per_year' then value_mode end), 0) * 2.5::double as worth from params group by 1),
    t as (select solution_id, sum(qty * cost) / {BUDGET}::double as f2, -(sum(qty * worth) / ({BUDGET}::double + 1e-9::double)) as f4, sum(qty * cost) - {BUDGET}::double as c1
      from decisions join unit using (intervention_key) group by 1),
    x as (select solution_id, intervention_key, sum(greatest(0, qty - max_qty)) as x from decisions join bounds using (zone_id, intervention_key) group by 1, 2),
    x2 as (select solution_id, max(x) as c2 from x group by 1), {EXCL},
    z2 as (select solution_id, sum(greatest(0, a + b - 1.2::double * greatest(a, b))) as c3 from z group by 1),
    lr as (select solution_id, {S.r6('f1', 'f2', 'f3', 'f4', 'f5', 'c1', 'c2', 'c3')} from d2 join t using (solution_id) join x2 using (solution_id) join z2 using (solution_id))"""


@query("long_run_objectives", oracle("zone_state decisions bounds", LONG_RUN + " select * from lr"))
def _(spark, sf):
    return long_run(spark, sf)


@query("candidate_portfolios", oracle("bounds", f""", {PARAM_VALUES}, b as (select zone_id, intervention_key, max_qty, value_mode as unit_cost from bounds join params using (intervention_key)
      where parameter_name = 'cost_per_unit_usd'), raw as (select *, {S.uniform(SEED, 'solution_id', 'zone_id', 'intervention_key')} * max_qty as q from b, (select unnest(range({PLANS}))::int as solution_id)),
    c as (select solution_id, sum(q * unit_cost) as cost from raw group by 1)
    select solution_id, zone_id, intervention_key, round(q * case when cost > 1000000 then 1000000 / cost else 1 end, 6) as qty from raw join c using (solution_id)"""))
def _(spark, sf):
    costs = params(spark).where("parameter_name = 'cost_per_unit_usd'").select("intervention_key", F.col("value_mode").alias("unit_cost"))
    b = view(spark, sf, "bounds").join(F.broadcast(costs), "intervention_key")
    return I.candidate_portfolios(b, PLANS, 1e6, SEED, method="md5")


FLAT = """, f as (select solution_id, list(qty order by zone_id, k) as x from (select solution_id, zone_id, k, qty from decisions) group by 1)"""


@query("decisions_long", oracle("order_plans", """, v as (select solution_id, row_number() over (partition by solution_id order by zone_id, k) - 1 as pos, qty from order_plans)
    select solution_id, floor(pos / 3)::int as zone_id, (pos % 3 + 1)::int as k, case pos % 3 when 0 then 'LR1_tree_planting' when 1 then 'LR2_cool_roof' else 'LR3_bgi' end as intervention_key, qty from v"""))
def _(spark, sf):
    # Vectors of different length per order, three interventions per zone.
    d = view(spark, sf, "order_plans")
    vectors = d.groupBy("solution_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("zone_id", "k", "qty"))), lambda s: s["qty"]).alias("x"))
    return I.decisions_long(vectors, 3)


# --- fronts --------------------------------------------------------------------------
def dominated(a: str, b: str) -> str:
    return " and ".join(f"{b}.{f} <= {a}.{f}" for f in FIVE) + " and (" + " or ".join(f"{b}.{f} < {a}.{f}" for f in FIVE) + ")"


FRONT = f", front as (select a.* from candidates a where not exists (select 1 from candidates b where {dominated('a', 'b')}))"


def front(spark, sf):
    return P.pareto_front(view(spark, sf, "candidates"))


@query("pareto_front", oracle("candidates", FRONT + f" select solution_id, {', '.join(FIVE)} from front"))
def _(spark, sf):
    return front(spark, sf).select("solution_id", *FIVE)


SCALE = {f: f"(({f} - min({f}) over ()) / (max({f}) over () - min({f}) over () + 1e-9::double))" for f in FIVE}
UTOPIA = "sqrt(" + " + ".join(f"{v} * {v}" for v in SCALE.values()) + ")"
PICKS = FRONT + f""", sc as (select *, {UTOPIA} as dist from front),
    pk as (select row_number() over (order by f1, solution_id) as r1, row_number() over (order by f2, solution_id) as r2, row_number() over (order by dist, solution_id) as r3, * from sc)"""


@query("strategic_solutions", oracle("candidates", PICKS + " " + " union all ".join(
    f"select '{n}' as strategy, solution_id, {', '.join(FIVE)} from pk where r{i + 1} = 1" for i, n in enumerate(("health_focused", "budget_focused", "balanced")))))
def _(spark, sf):
    return P.strategic_solutions(front(spark, sf))


TABLE = PICKS + f""" select solution_id, {', '.join(f'{f} as {n}' for f, n in zip(FIVE, C.LONG_OBJECTIVES))}, round((1 - f1) * 100, 6) as mortality_reduction_pct,
    c1 as x_0000, c2 as x_0001, r1 = 1 as is_health_focused, r2 = 1 as is_budget_focused, r3 = 1 as is_balanced from pk"""


@query("pareto_table", oracle("candidates", TABLE))
def _(spark, sf):
    return P.pareto_table(front(spark, sf).withColumn("x", F.array("c1", "c2")), x="x", n_variables=2)


@query("write_pareto", oracle("candidates", TABLE))
def _(spark, sf):
    f = front(spark, sf).withColumn("x", F.array("c1", "c2"))
    path = writers.write_pareto(f, run_dir(spark, "front"), x="x", n_variables=2)
    schema = "solution_id bigint, " + ", ".join(f"{n} double" for n in C.LONG_OBJECTIVES) + (
        ", mortality_reduction_pct double, x_0000 double, x_0001 double, is_health_focused boolean, is_budget_focused boolean, is_balanced boolean")
    return spark.read.csv(path, header=True, schema=schema)


@query("union_seeds", oracle("candidates", f""", s as (select *, case when solution_id % 3 = 0 then 42 when solution_id % 3 = 1 then 123 else 456 end as seed from candidates),
    fr as (select a.* from s a where not exists (select 1 from s b where a.seed = b.seed and {dominated('a', 'b')}))
    select a.solution_id, a.seed, {', '.join('a.' + f for f in FIVE)} from fr a where not exists (select 1 from fr b where {dominated('a', 'b')})"""))
def _(spark, sf):
    c = view(spark, sf, "candidates")
    parts = [P.pareto_front(c.where(F.col("solution_id") % 3 == i)) for i in range(3)]
    return P.union_seeds(parts, C.SEEDS[:3]).select("solution_id", "seed", *FIVE)


def directions_sql() -> str:
    rows = []
    for i, d in enumerate(P.das_dennis(5, 6)):
        norm = sum(x * x for x in d) ** 0.5
        rows.append((i, *[x / norm for x in d]))
    return S.values("dirs", ["direction", *[f"u{i}" for i in range(5)]], rows)


@query("reference_direction_select", oracle("candidates", FRONT + f""", {directions_sql()}, sc as (select solution_id, {', '.join(FIVE)}, {', '.join(f'{v} as v{i}' for i, v in enumerate(SCALE.values()))} from front),
    pr as (select sc.*, direction, round({' + '.join(f'v{i} * v{i}' for i in range(5))} - pow({' + '.join(f'v{i} * u{i}' for i in range(5))}, 2), 9) as d2 from sc, dirs),
    nr as (select *, row_number() over (partition by solution_id order by d2, direction) as rn from pr),
    b as (select *, row_number() over (partition by direction order by d2, solution_id) as rb from nr where rn = 1) select direction, solution_id, {', '.join(FIVE)} from b where rb = 1"""))
def _(spark, sf):
    return P.reference_direction_select(front(spark, sf))


# --- uncertainty -----------------------------------------------------------------------
SAMPLES = 500


def sampled_sql(hashes: int) -> str:
    z = {c: S.normal(SEED, "sample_id", "aoi_id", "cell_id", repr(c), hashes=hashes) for c in C.BAND_NOISE}
    noise = ", ".join(
        f"{c} + {size}::double * {z[c]} as {c}" if kind == "gaussian" else f"{c} * exp(sqrt(ln(1 + {size}::double * {size}::double)) * {z[c]}) as {c}"
        for c, (kind, size) in C.BAND_NOISE.items())
    return f", smp as (select aoi_id, cell_id, sample_id, {noise} from cells, (select unnest(range({SAMPLES}))::int as sample_id))"


SAMPLED = sampled_sql(1)


@query("perturb_indicators", oracle("cells", sampled_sql(2) + f" select aoi_id, cell_id, sample_id, {S.r6(*C.INDICATORS)} from smp"))
def _(spark, sf):
    base = cells(spark, sf).select("aoi_id", "cell_id", *C.INDICATORS)
    return U.perturb_indicators(base, SAMPLES, SEED, ("aoi_id", "cell_id"), method="md5", hashes=2)


@query("mc_distribution", oracle("cells", SAMPLED + f""", {S.hvi('smp', 'aoi_id, sample_id', 'aoi_id, cell_id, sample_id')} select aoi_id, cell_id, round(quantile_cont(hvi, 0.1), 6) as p10,
    round(quantile_cont(hvi, 0.5), 6) as p50, round(quantile_cont(hvi, 0.9), 6) as p90, round(avg(hvi), 6) as mean, round(stddev_pop(hvi), 6) as std,
    round(quantile_cont(hvi, 0.9) - quantile_cont(hvi, 0.1), 6) as confidence_width, count(hvi) as n_valid from hvi group by 1, 2""".replace("partition by aoi_id, sample_id", "partition by aoi_id, sample_id")))
def _(spark, sf):
    return U.mc_distribution(cells(spark, sf), SAMPLES, SEED, method="md5")


def variants_sql() -> str:
    eq = S.subindices()
    rows = []
    for s, name, sign, w in U.weight_variants():
        parts = {"e": "e", "s": "s", "ac": "ac"}
        if C.SUB_INDEX_COLUMN[s] in parts:
            parts[C.SUB_INDEX_COLUMN[s]] = f"({S.subindex(w)})"
        rows.append(f"select aoi_id, cell_id, '{s}' as sub_index, '{name}' as indicator, '{sign}' as direction, {S.formula('e', 's', 'ac')} as nominal, {S.formula(**parts)} as hvi from sub0")
    return f"{S.normed()}, sub0 as (select *, {eq} from norm), variants as ({' union all '.join(rows)})"


SENS = f""", {variants_sql()}, rk as (select *, {S.avg_rank('hvi', 'partition by aoi_id, sub_index, indicator, direction')} as rv, {S.avg_rank('nominal', 'partition by aoi_id, sub_index, indicator, direction')} as rn
    from variants where hvi is not null and nominal is not null), sens as (select aoi_id, sub_index, indicator, direction, case when count(*) > 10 then corr(rv, rn) end as spearman_r from rk group by 1, 2, 3, 4)"""


@query("weight_variant_cross", oracle("cells", f", {variants_sql()} select aoi_id, cell_id, round(nominal, 6) as hvi_nominal, sub_index, indicator, direction, round(hvi, 6) as hvi from variants"))
def _(spark, sf):
    return U.weight_variant_cross(cells(spark, sf))


@query("weight_sensitivity", oracle("cells", SENS + " select aoi_id, sub_index, indicator, direction, round(spearman_r, 6) as spearman_r from sens"))
def _(spark, sf):
    return U.weight_sensitivity(cells(spark, sf))


@query("sensitivity_by_indicator", oracle("cells", SENS + " select aoi_id, indicator, round(avg(spearman_r), 6) as mean_r, avg(spearman_r) < 0.9 as unstable from sens group by 1, 2"))
def _(spark, sf):
    return U.sensitivity_by_indicator(U.weight_sensitivity(cells(spark, sf)))


MORRIS = SENS + ", mo as (select aoi_id, sub_index, indicator, round(avg(abs(1 - spearman_r)), 6) as mu_star, round(stddev_pop(1 - spearman_r), 6) as sigma from sens group by 1, 2, 3)"
MORRIS_RANK = "floor(rank() over (partition by aoi_id order by mu_star desc) + (count(*) over (partition by aoi_id, mu_star) - 1) / 2::double)::int as rank"


def morris(spark, sf):
    # Rounded before ranking, so that equal effects tie whatever the summation order.
    s = U.weight_sensitivity(cells(spark, sf)).withColumn("spearman_r", F.round("spearman_r", 9))
    m = U.morris_screen(s).withColumns({"mu_star": F.round("mu_star", 6), "sigma": F.round("sigma", 6)})
    return m.withColumn("rank", U.indicator_rank())


@query("morris_screen", oracle("cells", MORRIS + f" select *, {MORRIS_RANK} from mo"))
def _(spark, sf):
    return morris(spark, sf)


@query("indicator_rank", oracle("cells", MORRIS + f" select aoi_id, indicator, {MORRIS_RANK} from mo"))
def _(spark, sf):
    return morris(spark, sf).select("aoi_id", "indicator", "rank")


@query("morris_sorted", oracle("cells", MORRIS + " select aoi_id, sub_index, indicator, mu_star, sigma from mo order by aoi_id, mu_star desc, indicator"))
def _(spark, sf):
    return U.morris_sorted(morris(spark, sf)).drop("rank")


PAIRS = [(a, b) for i, a in enumerate(C.INDICATORS) for b in C.INDICATORS[i + 1:]]


def spearman_sql() -> str:
    parts = []
    for a, b in PAIRS:
        ranks = f"select aoi_id, {S.avg_rank(a, 'partition by aoi_id')} as ra, {S.avg_rank(b, 'partition by aoi_id')} as rb from norm where {a} is not null and {b} is not null"
        parts.append(f"select aoi_id, count(*) as n, '{a}' as indicator_a, '{b}' as indicator_b, round(case when count(*) > 5 then corr(ra, rb) end, 6) as rho from ({ranks}) group by aoi_id")
    return " union all ".join(parts)


@query("spearman_matrix", oracle("cells", f", {S.normed()} {spearman_sql()}"))
def _(spark, sf):
    return U.spearman_matrix(robust_normalize(cells(spark, sf).select("aoi_id", "cell_id", *C.INDICATORS)))


# --- scenarios ----------------------------------------------------------------------------
@query("fallback_delta", oracle("sites", """, s as (select aoi_id, case when k % 3 = 0 then 'ssp245' when k % 3 = 1 then 'ssp585' else 'ssp126' end as scenario, case when year % 2 = 0 then 2035 else 2050 end as y from sites),
    v as (select *, case when scenario = 'ssp245' and y = 2035 then 1.5 when scenario = 'ssp245' and y = 2050 then 2.0 when scenario = 'ssp585' and y = 2050 then 2.9 when scenario = 'ssp585' and y = 2035 then 2.1 else 1.5 end::double as d from s)
    select aoi_id, scenario, d as delta_mean, round(d - 0.5, 6) as delta_p10, d as delta_p50, round(d + 0.8, 6) as delta_p90 from v"""))
def _(spark, sf):
    s = view(spark, sf, "sites").select(
        "aoi_id", F.when(F.col("k") % 3 == 0, "ssp245").when(F.col("k") % 3 == 1, "ssp585").otherwise("ssp126").alias("scenario"),
        F.when(F.col("year") % 2 == 0, 2035).otherwise(2050).alias("y"))
    return s.select("aoi_id", "scenario", SC.fallback_delta(F.col("scenario"), F.col("y")).alias("d")).select("aoi_id", "scenario", "d.*")


@query("scenario_ensemble", oracle("sites", """, m as (select 'ssp' || (k % 2) as scenario, 2030 + 5 * (year % 4) as target_year, 'm' || (aoi_id % 17) as model, 1 + n_cells / 10000::double as delta from sites)
    select scenario, target_year::int as target_year, round(avg(delta), 6) as delta_mean, round(quantile_cont(delta, 0.1), 6) as delta_p10, round(quantile_cont(delta, 0.5), 6) as delta_p50,
    round(quantile_cont(delta, 0.9), 6) as delta_p90, count(distinct model) as n_models from m group by 1, 2"""))
def _(spark, sf):
    m = view(spark, sf, "sites").select(
        F.concat(F.lit("ssp"), F.col("k") % 2).alias("scenario"), (F.lit(2030) + 5 * (F.col("year") % 4)).cast("int").alias("target_year"),
        F.concat(F.lit("m"), F.col("aoi_id") % 17).alias("model"), (F.lit(1.0) + F.col("n_cells") / 10000.0).alias("delta"))
    return SC.scenario_ensemble(m)


SCEN = S.values("sc", ["scenario", "t_delta", "pop_factor", "event_days", "description"], list(C.SCENARIOS))


@query("scenario_table", oracle("sites", NEAREST + f""", {SCEN} select aoi_id, scenario, case scenario when 'C' then coalesce(case when aoi_id % 5 <> 0 then d245 end, t_delta)
    when 'D' then coalesce(case when aoi_id % 5 <> 0 then d585 end, t_delta) else t_delta end as t_delta, pop_factor, event_days, description from nearest, sc"""))
def _(spark, sf):
    near = nearest_delta(view(spark, sf, "sites"), readers.read_cmip6_delta_grid(spark))
    known = F.col("aoi_id") % 5 != 0
    near = near.select("aoi_id", F.when(known, F.col("d245")).alias("d245"), F.when(known, F.col("d585")).alias("d585"))
    return SC.scenario_table(near).drop("d245", "d585")


@query("scenario_population", oracle("cells", f", {SCEN} select cell_id, scenario, round(population * pop_factor, 6) as population_scenario from cells, sc"))
def _(spark, sf):
    return SC.scenario_population(cells(spark, sf).select("cell_id", "population")).select("cell_id", "scenario", "population_scenario")


@query("future_deaths", oracle("cells", f""", {S.hvi(extra=', cells.lst as lst_raw, cells.population as pop_raw')}, m as (select aoi_id, quantile_cont(lst, 0.75) as mmt from cells group by 1), {SCEN}
    select aoi_id, cell_id, scenario, round(greatest(pop_raw * pop_factor * 0.0074::double * ({S.af('(lst_raw + t_delta)', 'mmt', 'hvi', '0.0072::double')}) * event_days, 0), 6) as ad_scenario
    from hvi join m using (aoi_id), sc"""))
def _(spark, sf):
    from heatloom.operators.risk import mmt

    i = indexed(spark, sf)
    rows = i.join(F.broadcast(mmt(cells(spark, sf))), "aoi_id")
    return SC.future_deaths(rows).select("aoi_id", "cell_id", "scenario", "ad_scenario")


@query("long_run_key", oracle("decisions", "select k, intervention_key, count(*) as n from decisions group by 1, 2"))
def _(spark, sf):
    d = view(spark, sf, "decisions")
    return d.groupBy("k", long_run_key(F.col("k")).alias("intervention_key")).agg(F.count(F.lit(1)).alias("n"))
