"""Queries of the vulnerability and risk indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom import constants as C
from heatloom.operators import index, normalize, risk, summaries, weights
from heatloom.operators.ordering import average_ranks
from heatloom.operators.rundir import run_dir
from heatloom.plans import sqltext as S
from heatloom.plans.pipeline import risk_index
from heatloom.plans.registry import query
from heatloom.plans.views import oracle, view
from heatloom.sources import writers

ALL = list(C.INDICATORS)


def cells(spark, sf):
    return view(spark, sf, "cells")


def normed(spark, sf):
    return normalize.robust_normalize(cells(spark, sf).select("aoi_id", "cell_id", *ALL))


HVI_COLUMNS = ["h_s", "e", "s", "ac", "hvi_raw", "hvi"]


@query("hvi", oracle("cells", f", {S.hvi()} select aoi_id, cell_id, {S.r6(*HVI_COLUMNS)} from hvi"))
def hvi(spark, sf):
    return index.hvi(cells(spark, sf)).select("aoi_id", "cell_id", *HVI_COLUMNS)


@query("robust_normalize", oracle("cells", f", {S.normed(['albedo', 'viirs_dnb'])} select aoi_id, cell_id, round(1 - albedo, 6) as albedo, round(viirs_dnb, 6) as viirs_dnb from norm"))
def _(spark, sf):
    base = cells(spark, sf).select("aoi_id", "cell_id", "albedo", "viirs_dnb")
    return normalize.robust_normalize(base, ["albedo", "viirs_dnb"], directions={"albedo": "negative"})


@query("robust_normalize_batch", oracle("cells", f", {S.normed()} select aoi_id, cell_id, {S.r6(*ALL)} from norm"))
def _(spark, sf):
    return normed(spark, sf)


LONG = " union all ".join(f"select aoi_id, cell_id, '{c}' as indicator, {c} as value from cells where {c} is not null" for c in ALL)


@query("indicator_stats", oracle("cells", f"""select aoi_id, indicator, round(min(value), 6) as min, round(max(value), 6) as max,
    round(quantile_cont(value, 0.02), 6) as p2, round(quantile_cont(value, 0.98), 6) as p98, round(avg(value), 6) as mean
    from ({LONG}) group by 1, 2"""))
def _(spark, sf):
    return normalize.indicator_stats(cells(spark, sf))


@query("minmax_norm", oracle("cells", f"select aoi_id, cell_id, round({S.minmax('viirs_dnb', 'partition by aoi_id')}, 6) as viirs_dnb from cells"))
def _(spark, sf):
    return normalize.minmax_norm(cells(spark, sf).select("aoi_id", "cell_id", "viirs_dnb"), ["viirs_dnb"])


# --- weights --------------------------------------------------------------------
def weight_rows(maps) -> str:
    return S.values("w", ["sub_index", "indicator", "w"], [(s, i, float(v)) for s, g in maps.items() for i, v in g.items()])


MANUAL = {s: {c: float(v) for c, v in g.items()} for s, g in C.SUB_INDEX_WEIGHTS.items()}


@query("weights_equal", oracle("cells", f", {weight_rows(weights.equal_weights_map())} select aoi_id, sub_index, indicator, round(w, 6) as w from (select distinct aoi_id from cells), w"))
def _(spark, sf):
    return weights.compute_weights(cells(spark, sf).select("aoi_id", *ALL), "equal")


@query("weights_manual", oracle("cells", f", {weight_rows(MANUAL)} select aoi_id, sub_index, indicator, round(w, 6) as w from (select distinct aoi_id from cells), w"))
def _(spark, sf):
    return weights.compute_weights(cells(spark, sf).select("aoi_id", *ALL), "manual", user_weights=MANUAL)


def entropy_views() -> str:
    parts, scores = [], []
    for c in ALL:
        p = f"greatest(({c} - lo) / (hi - lo), 1e-10)"
        parts.append(
            f"h_{c} as (select aoi_id, case when count({c}) < 2 or max(hi) - max(lo) < 1e-12 then 0::double else 1 - least(greatest("
            f"-(sum(case when hi > lo then {p} * ln({p}) end) / sum(case when hi > lo then {p} end) - ln(sum(case when hi > lo then {p} end))) / ln(count({c})), 0), 1) end as {c} "
            f"from (select aoi_id, {c}, min({c}) over (partition by aoi_id) as lo, max({c}) over (partition by aoi_id) as hi from norm) group by 1)"
        )
    for s, g in C.SUB_INDEX_WEIGHTS.items():
        whole = "(" + " + ".join(g) + ")"
        scores += [f"select aoi_id, '{s}' as sub_index, '{c}' as indicator, case when {whole} >= 1e-12 then {c} / {whole} else {1 / len(g)!r} end as w from red" for c in g]
    join = "red as (select * from h_lst " + " ".join(f"join h_{c} using (aoi_id)" for c in ALL[1:]) + ")"
    return f"{S.normed()}, " + ", ".join(parts) + f", {join}, ew as ({' union all '.join(scores)})"


@query("weights_entropy", oracle("cells", f", {entropy_views()} select aoi_id, sub_index, indicator, round(w, 6) as w from ew"))
def _(spark, sf):
    return weights.weights_entropy(normed(spark, sf))


def critic_views() -> str:
    parts, rows = [], []
    for s, g in C.SUB_INDEX_WEIGHTS.items():
        cs = list(g)
        ok = " and ".join(f"{c} is not null" for c in cs)
        ranks = ", ".join(f"{S.avg_rank(c, 'partition by aoi_id')} as r_{c}" for c in cs)
        parts.append(f"k_{s} as (select *, {ranks} from norm where {ok})")
        score = {c: f"(stddev_pop({c}) * (" + " + ".join(f"(1 - corr(r_{c}, r_{k}))" for k in cs if k != c) + "))" for c in cs}
        whole = "(" + " + ".join(score.values()) + ")"
        rows += [f"select aoi_id, '{s}' as sub_index, '{c}' as indicator, case when {whole} >= 1e-12 then {score[c]} / {whole} else {1 / len(cs)!r} end as w from k_{s} group by aoi_id" for c in cs]
    return f"{S.normed()}, " + ", ".join(parts) + f", cw as ({' union all '.join(rows)})"


@query("weights_critic", oracle("cells", f", {critic_views()} select aoi_id, sub_index, indicator, round(w, 6) as w from cw"))
def _(spark, sf):
    return weights.weights_critic(normed(spark, sf))


def pca_sql() -> str:
    """Squared loadings as the diagonal of a high power of the covariance matrix, by squaring it forty times."""
    parts, starts = [], []
    for s, g in C.SUB_INDEX_WEIGHTS.items():
        cs = list(g)
        ok = " and ".join(f"{c} is not null" for c in cs)
        rows = ", ".join("[" + ", ".join(f"covar_samp({a}, {b})" for b in cs) + "]" for a in cs)
        parts.append(f"m_{s} as (select aoi_id, count(*) as n, [{rows}] as m from norm where {ok} group by 1)")
        starts.append(f"select aoi_id, '{s}' as sub_index, {len(cs)} as k, {cs!r} as names, n, m, 0 as step from m_{s} where n > {len(cs)}")
    square = "[[list_sum([m[i][x] * m[x][j] for x in range(1, k + 1)]) for j in range(1, k + 1)] for i in range(1, k + 1)]"
    trace = "list_sum([q[i][i] for i in range(1, k + 1)])"
    return f"""{S.normed()}, {", ".join(parts)}, starts as ({" union all ".join(starts)}),
    power as (select * from starts union all select aoi_id, sub_index, k, names, n,
      [[q[i][j] / {trace} for j in range(1, k + 1)] for i in range(1, k + 1)], step + 1 from (select *, {square} as q from power where step < 40)),
    pw as (select aoi_id, sub_index, unnest(names) as indicator, unnest([m[i][i] for i in range(1, k + 1)]) as w from power where step = 40)"""


@query("weights_pca", oracle("cells", f", {pca_sql()} select aoi_id, sub_index, indicator, round(w, 6) as w from pw").replace("with ", "with recursive ", 1))
def _(spark, sf):
    return weights.weights_pca(normed(spark, sf))


@query("compute_weights", oracle("cells", f""", {entropy_views()}, {critic_views()[len(S.normed()) + 2:]}
    select 'entropy' as method, aoi_id, sub_index, indicator, round(w, 6) as w from ew union all select 'critic', aoi_id, sub_index, indicator, round(w, 6) from cw"""))
def _(spark, sf):
    n = normed(spark, sf)
    parts = [weights.compute_weights(n, m).select(F.lit(m).alias("method"), "aoi_id", "sub_index", "indicator", "w") for m in ("entropy", "critic")]
    return parts[0].unionByName(parts[1])


@query("subindex", oracle("cells", f", {S.normed()} select aoi_id, cell_id, {', '.join(f'round({S.subindex(MANUAL[s])}, 6) as {C.SUB_INDEX_COLUMN[s]}' for s in MANUAL)} from norm"))
def _(spark, sf):
    out = index.with_subindices(normed(spark, sf), "manual", user_weights=MANUAL)
    return out.select("aoi_id", "cell_id", "h_s", "e", "s", "ac")


# --- risk -----------------------------------------------------------------------
RISK = (
    f"{S.hvi(extra=', cells.lst as lst_raw, cells.population as pop_raw')},\n"
    "m as (select aoi_id, coalesce(quantile_cont(lst, 0.75), 30::double) as mmt from cells group by 1),\n"
    f"risk0 as (select *, h_s * hvi as x from hvi join m using (aoi_id)),\n"
    f"risk1 as (select *, {S.minmax('x', 'partition by aoi_id')} as hri, {S.af('lst_raw', 'mmt', 'hvi', '0.0072::double')} as af from risk0),\n"
    "risk as (select *, greatest(pop_raw * 0.0074::double * af * 3, 0) as ad_baseline from risk1)"
)


def indexed(spark, sf):
    return index.hvi(cells(spark, sf), keep=("cell_id", "lst", "population"))


def risked(spark, sf):
    return risk_index(cells(spark, sf))


@query("hri", oracle("cells", f", {RISK} select aoi_id, cell_id, round(hri, 6) as hri from risk"))
def _(spark, sf):
    return risk.hri(index.hvi(cells(spark, sf))).select("aoi_id", "cell_id", "hri")


@query("mmt", oracle("cells", "select aoi_id, round(coalesce(quantile_cont(lst, 0.75), 30), 6) as mmt from cells group by 1"))
def _(spark, sf):
    return risk.mmt(cells(spark, sf))


@query("attributable_fraction", oracle("cells", f"select cell_id, round({S.af('lst', '37::double', 'ndvi', '0.0058::double')}, 6) as af from cells"))
def _(spark, sf):
    from heatloom.functions.heat import attributable_fraction

    return cells(spark, sf).select("cell_id", attributable_fraction(F.col("lst"), F.lit(37.0), F.col("ndvi"), F.lit(0.0058)).alias("af"))


@query("attributable_deaths", oracle("cells", f"select cell_id, round(greatest(population * 0.0072::double * ({S.af('lst', '37::double', 'ndvi', '0.0058::double')}) * 5, 0), 6) as ad from cells"))
def _(spark, sf):
    from heatloom.functions.heat import attributable_deaths, attributable_fraction

    af = attributable_fraction(F.col("lst"), F.lit(37.0), F.col("ndvi"), F.lit(0.0058))
    return cells(spark, sf).select("cell_id", attributable_deaths(F.col("population"), F.lit(0.0072), af, 5.0).alias("ad"))


@query("hri_pipeline", oracle("cells", f", {RISK} select aoi_id, cell_id, {S.r6('hri', 'mmt', 'af', 'ad_baseline')} from risk"))
def _(spark, sf):
    return risked(spark, sf).select("aoi_id", "cell_id", "hri", "mmt", "af", "ad_baseline")


@query("mmt_prior_interval", oracle("cells", """, m as (select aoi_id, quantile_cont(lst, 0.75) as mmt from cells group by 1)
    select aoi_id, round(mmt, 6) as mmt_mean, 3::double as mmt_sd, round(mmt - 5.88::double, 6) as mmt_low, round(mmt + 5.88::double, 6) as mmt_high,
    'PRIOR_ONLY' as calibration_status from m"""))
def _(spark, sf):
    return risk.mmt_prior_interval(risk.mmt(cells(spark, sf))).drop("mmt")


GRID51 = ", ".join(repr(0.3 + 0.5 * i / 50) + "::double" for i in range(51))


@query("lambda_estimate", oracle("cells", f""", obs as (select aoi_id, exp(0.0072::double * greatest(0, lst - 36)) as base,
    round(exp(0.0072::double * greatest(0, lst - 36)) * (1 + (0.4::double + 0.02::double * aoi_id) * impervious) + 0.01::double * ndwi, 9) as rr, impervious as hvi from cells),
    sums as (select aoi_id, sum((rr - base) * (rr - base)) as gg, sum((rr - base) * base * hvi) as gs, sum(base * hvi * base * hvi) as ss from obs group by 1),
    scored as (select aoi_id, x, row_number() over (partition by aoi_id order by gg - 2 * x * gs + x * x * ss, x) as rn from sums, (select unnest([{GRID51}]) as x))
    select aoi_id, round(x, 6) as lambda, 0.3::double as low, 0.8::double as high, 'CALIBRATED' as calibration_status from scored where rn = 1"""))
def _(spark, sf):
    c = cells(spark, sf).withColumns({"excess_c": F.col("lst") - 36.0, "hvi": F.col("impervious"), "beta": F.lit(0.0072)})
    base = F.exp(0.0072 * F.greatest(F.lit(0.0), F.col("excess_c")))
    obs = c.withColumn("mortality_rr", F.round(base * (1.0 + (0.4 + 0.02 * F.col("aoi_id")) * F.col("hvi")) + 0.01 * F.col("ndwi"), 9))
    return risk.lambda_estimate(obs, c, by=("aoi_id",))


# --- checks and summaries -------------------------------------------------------
def validate_sql() -> str:
    rows = []
    for c in ALL:
        lo, hi = C.BAND_RANGES[c]
        bad = "warning" if c in C.NON_CRITICAL_BANDS else "fail"
        issue = (f"case when count({c}) / count(*)::double < 0.3 then 'too few valid pixels' when min({c}) = 0 and max({c}) = 0 then 'all zero' "
                 f"when quantile_cont({c}, 0.98) < {S.d(lo)} or quantile_cont({c}, 0.02) > {S.d(hi)} then 'outside physical range' end")
        rows.append(f"select aoi_id, count(*) as n_total, '{c}' as indicator, case when ({issue}) is null then 'ok' else '{bad}' end as status, {issue} as issue, "
                    f"count({c}) as n_valid, round(min({c}), 6) as min, round(max({c}), 6) as max, round(avg({c}), 6) as mean from broken group by aoi_id")
    return " union all ".join(rows)


@query("validate_bands", oracle("cells", f""", broken as (select * replace (
    case when aoi_id = 1 then 0::double else canopy_height end as canopy_height, case when aoi_id = 0 and cell_id % 10 < 8 then null else uhi end as uhi,
    case when aoi_id = 1 then albedo + 5 else albedo end as albedo) from cells) {validate_sql()}"""))
def _(spark, sf):
    c = cells(spark, sf)
    broken = c.withColumns({
        "canopy_height": F.when(F.col("aoi_id") == 1, 0.0).otherwise(F.col("canopy_height")),
        "uhi": F.when(~((F.col("aoi_id") == 0) & (F.col("cell_id") % 10 < 8)), F.col("uhi")),
        "albedo": F.when(F.col("aoi_id") == 1, F.col("albedo") + 5).otherwise(F.col("albedo")),
    })
    return summaries.validate_bands(broken)


@query("index_plausibility", oracle("cells", f""", {S.hvi()}, c as (select aoi_id, hvi, avg(hvi) over (partition by aoi_id) as mu from hvi),
    t as (select aoi_id, min(hvi) as min, max(hvi) as max, sqrt(avg((hvi - mu) * (hvi - mu))) as std, avg((hvi - mu) * (hvi - mu) * (hvi - mu)) as m3,
      median(hvi) as median, count(hvi) / count(*)::double as coverage from c group by 1),
    u as (select *, m3 / (std * std * std + 1e-9) as skewness from t)
    select aoi_id, {S.r6('min', 'max', 'skewness', 'std', 'median', 'coverage')}, min >= -0.01 and max <= 1.01 as range_ok, skewness > 0 as skew_ok,
    std > 0.05 as variance_ok, median > 0.1 and median < 0.9 as median_ok, coverage > 0.2 as coverage_ok,
    min >= -0.01 and max <= 1.01 and std > 0.05 and coverage > 0.2 as passed from u"""))
def _(spark, sf):
    return summaries.index_plausibility(index.hvi(cells(spark, sf)))


@query("index_summary", oracle("cells", f", {RISK}, tot as (select aoi_id, sum(ad_baseline) as total_ad from risk group by 1) " + " union all ".join(
    f"select aoi_id, round(any_value(total_ad), 6) as total_ad, '{c}' as index_name, round(avg({c}), 6) as mean, round(quantile_cont({c}, 0.1), 6) as p10, "
    f"round(quantile_cont({c}, 0.9), 6) as p90 from risk join tot using (aoi_id) group by aoi_id" for c in ("h_s", "e", "s", "ac", "hvi"))))
def _(spark, sf):
    return summaries.index_summary(risked(spark, sf))


@query("subindex_histogram", oracle("cells", f", {S.hvi()}, long as (" + " union all ".join(
    f"select aoi_id, '{c}' as index_name, {c} as value from hvi where {c} is not null" for c in ("h_s", "e", "s", "ac")) + """),
    st2 as (select *, min(value) over p as lo, max(value) over p as hi, avg(value) over p as mean from long window p as (partition by aoi_id, index_name)),
    st3 as (select aoi_id, index_name, value, round(mean, 9) as mean, case when hi = lo then lo - 0.5 else lo end as lo, case when hi = lo then hi + 0.5 else hi end as hi from st2),
    binned as (select *, least(floor((value - lo) / ((hi - lo) / 40)), 39)::int as bin from st3)
    select aoi_id, index_name, bin, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 40), 6) as bin_start, count(*) as n, round(any_value(mean), 6) as mean
    from binned group by 1, 2, 3"""))
def _(spark, sf):
    return summaries.subindex_histogram(index.hvi(cells(spark, sf)))


def comparison_sql() -> str:
    """All schemes' weights side by side, then one index per scheme."""
    head = len(S.normed()) + 2
    wide = ", ".join(f"max(case when indicator = '{c}' then w end) as w_{c}" for c in ALL)
    named = {s: {c: f"w_{c}" for c in g} for s, g in C.SUB_INDEX_WEIGHTS.items()}
    return f"""{pca_sql()}, {entropy_views()[head:]}, {critic_views()[head:]}, {weight_rows(weights.equal_weights_map())},
    every as (select 'equal' as method, aoi_id, indicator, w from (select distinct aoi_id from cells), w
      union all select 'pca', aoi_id, indicator, w from pw union all select 'entropy', aoi_id, indicator, w from ew union all select 'critic', aoi_id, indicator, w from cw),
    wide as (select method, aoi_id, {wide} from every group by 1, 2),
    scheme as (select method, aoi_id, cell_id, {S.subindices(named)} from norm join wide using (aoi_id)),
    raw as (select method, aoi_id, cell_id, {S.formula()} as hvi_raw from scheme)"""


@query("weighting_comparison", oracle("cells", f", {comparison_sql()} select aoi_id, cell_id, method, round({S.minmax('hvi_raw', 'partition by aoi_id, method')}, 6) as hvi from raw").replace("with ", "with recursive ", 1))
def _(spark, sf):
    return index.weighting_comparison(cells(spark, sf))


@query("average_rank", oracle("cells", f"select aoi_id, cell_id, {S.avg_rank('tree_cover', 'partition by aoi_id')} as rank from cells"))
def _(spark, sf):
    return average_ranks(cells(spark, sf).select("aoi_id", "cell_id", "tree_cover"), "tree_cover").drop("tree_cover")


@query("save_outputs", oracle("cells", f", {RISK} select aoi_id, cell_id, round(coalesce(hvi, -9999), 6) as hvi, round(coalesce(hri, -9999), 6) as hri from risk"))
def _(spark, sf):
    paths = writers.save_outputs(risked(spark, sf), run_dir(spark, "outputs"))
    a, b = (spark.read.parquet(paths[k]) for k in ("hvi", "hri"))
    out = a.select("aoi_id", "cell_id", "hvi").join(b.select("aoi_id", "cell_id", "hri"), ["aoi_id", "cell_id"])
    return out.withColumn("aoi_id", F.col("aoi_id").cast("int"))
