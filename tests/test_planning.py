"""Objectives, fronts, prescriptions and feasibility."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatloom import constants as C
from heatloom.operators import feasibility, interventions as I, neighbors, objectives as O, pareto as P, prescribe
from heatloom.operators.groups import GroupProfile
from heatloom.sources import readers


def post(spark, base, after, pop=1000.0):
    rows = [(1, i, float(b), float(a), float(pop)) for i, (b, a) in enumerate(zip(base, after))]
    return spark.createDataFrame(rows, "solution_id int, zone_id int, ad_baseline double, ad_post double, population double")


def one(df, c):
    return df.first()[c]


def test_mortality_objective(spark):
    assert one(O.f1_mortality(post(spark, [10] * 5, [7] * 5)), "f1") == pytest.approx(0.7)
    assert one(O.f1_mortality(post(spark, [0] * 5, [0] * 5)), "f1") == 0.0
    assert one(O.f1_mortality(post(spark, [10] * 5, [12] * 5)), "f1") == 1.0


@pytest.mark.parametrize("profile", [None, GroupProfile(1, 50, direct_rows=10)])
def test_gini(spark, profile):
    gini = lambda after: one(O.f3_gini(post(spark, [1] * len(after), after), profile=profile), "f3")
    assert gini([0.5] * 50) == pytest.approx(0, abs=1e-9)
    assert gini([0.0] * 49 + [100.0]) > 0.85
    assert gini([3.0]) == 0.0
    assert gini([0.0] * 10) == 0.0


def test_equal_scenarios_are_robust(spark):
    rng = np.random.default_rng(7)
    rows = [(1, i, float(rng.uniform(25, 40)), float(rng.uniform(.1, .9)), 500.0) for i in range(10)]
    df = spark.createDataFrame(rows, "solution_id int, zone_id int, lst_post double, hvi_post double, population double")
    same = [("A", 1.0, 1.0, 3.0, ""), ("B", 1.0, 1.0, 3.0, "")]
    assert one(O.f5_robustness(df, same), "f5") == 0.0
    assert one(O.f5_robustness(df, [("A", 0.0, 1.0, 3.0, ""), ("B", 2.0, 1.1, 4.5, "")]), "f5") > 0


def test_post_state_limits_after_each_intervention(spark):
    params = readers.read_intervention_params(spark)
    effects = I.effect_table(params, 1, modes=True)
    zones = spark.createDataFrame([(0, 40.0, 0.5, 98.0, 3.0, 0.1, 10.0, 0.5, 0.5), (1, 38.0, 0.1, 5.0, 2.0, 0.0, 5.0, 0.4, 0.6)],
                                  "zone_id int, lst double, ndvi double, tree_cover double, canopy_height double, ndwi double, viirs_dnb double, e double, s double")
    dec = spark.createDataFrame([(1, 0, "LR1_tree_planting", 5.0), (1, 0, "LR2_cool_roof", 2.0), (1, 1, "LR3_bgi", 0.0)],
                                "solution_id int, zone_id int, intervention_key string, qty double")
    got = {r["zone_id"]: r for r in I.post_intervention_state(zones, dec, effects).collect()}
    z = got[0]
    assert z["lst_post"] == pytest.approx(40 - 5 * 4.5 - 2 * 1.5)
    assert z["ndvi_post"] == 1.0 and z["tree_cover_post"] == 100.0
    assert z["ndwi_post"] == pytest.approx(0.1 + 5 * 0.06)
    ac = 0.2 * (1.0 + 100.0 + 3.0 + 0.4 + 10.0)
    assert z["ac_post"] == pytest.approx(ac)
    assert got[1]["lst_post"] == 38.0 and got[1]["ndvi_post"] == pytest.approx(0.1)
    assert {got[0]["hvi_post"], round(got[1]["hvi_post"], 9)} <= {0.0, 1.0} or got[1]["hvi_post"] == pytest.approx(1.0)


def test_draws_stay_inside_the_triples(spark):
    params = readers.read_intervention_params(spark)
    lim = {(r["intervention_key"], r["parameter_name"]): sorted((r["value_min"], r["value_max"])) for r in params.collect()}
    for r in I.sample_effectiveness(params, 20).collect():
        lo, hi = lim[r["intervention_key"], r["parameter_name"]]
        assert lo - 1e-9 <= r["value"] <= hi + 1e-9
    assert I.sample_costs(params, 3).count() == 39


def brute_front(v):
    return {i for i in range(len(v)) if not any((v[j] <= v[i]).all() and (v[j] < v[i]).any() for j in range(len(v)))}


@pytest.mark.parametrize("block_rows", [20, 100_000])
def test_pareto_front_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(42)
    v = rng.integers(0, 12, (400, 5)) / 4.0
    v[50:60] = v[0:10]  # equal vectors stay or go together
    pdf = pd.DataFrame(v, columns=list(P.FIVE)).assign(solution_id=np.arange(400), g=np.arange(400) % 2)
    df = spark.createDataFrame(pdf).repartition(5)
    got = {r["solution_id"] for r in P.pareto_front(df, block_rows=block_rows).collect()}
    assert got == brute_front(v)
    grouped = {r["solution_id"] for r in P.pareto_front(df, by=["g"], block_rows=block_rows).collect()}
    assert grouped == {2 * i + g for g in (0, 1) for i in brute_front(v[g::2])}


def test_epsilon_front_is_no_larger(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.random((200, 5)), columns=list(P.FIVE)).assign(solution_id=np.arange(200))
    df = spark.createDataFrame(pdf)
    coarse = P.pareto_front(df, epsilon=[0.25] * 5).count()
    assert 0 < coarse <= P.pareto_front(df).count()


def test_directions():
    assert len(P.das_dennis(5, 6)) == 210 and len(P.das_dennis(3, 8)) == 45
    assert all(abs(sum(d) - 1) < 1e-12 for d in P.das_dennis(5, 6))


def test_strategies(spark):
    rng = np.random.default_rng(42)
    v = rng.random((30, 5))
    df = spark.createDataFrame(pd.DataFrame(v, columns=list(P.FIVE)).assign(solution_id=np.arange(30)))
    got = {r["strategy"]: r["solution_id"] for r in P.strategic_solutions(df).collect()}
    s = (v - v.min(0)) / (v.max(0) - v.min(0) + 1e-9)
    assert got == {"health_focused": v[:, 0].argmin(), "budget_focused": v[:, 1].argmin(), "balanced": np.linalg.norm(s, axis=1).argmin()}
    table = P.pareto_table(df).toPandas()
    assert list(table.columns[1:6]) == C.LONG_OBJECTIVES and table[["is_health_focused", "is_budget_focused", "is_balanced"]].sum().tolist() == [1, 1, 1]


def test_candidates_keep_the_budget(spark):
    bounds = spark.createDataFrame([(z, k, 10.0, 1000.0) for z in range(4) for k in ("LR1_tree_planting", "LR3_bgi")],
                                   "zone_id int, intervention_key string, max_qty double, unit_cost double")
    c = I.candidate_portfolios(bounds, 30, 20_000.0)
    worst = c.groupBy("solution_id").agg(F.sum(F.col("qty") * 1000).alias("c")).agg(F.max("c")).first()[0]
    assert worst <= 20_000.0 + 1e-6 and c.count() == 30 * 8


def test_decision_vectors_round_trip(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "solution_id int, x array<double>")
    long = I.decisions_long(df, 3)
    assert {(r["zone_id"], r["k"], r["qty"]) for r in long.collect()} == {(0, 1, 1.0), (0, 2, 2.0), (0, 3, 3.0), (1, 1, 4.0), (1, 2, 5.0), (1, 3, 6.0)}
    assert I.decisions_flat(long, 3).first()["x"] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]


# --- cells -------------------------------------------------------------------------
def test_sentinels_are_not_prescribable(spark):
    df = spark.createDataFrame([(500.0, 6), (1000.0, 6), (-9999.0, 6), (200.0, 6), (300.0, 3), (0.5, 6), (None, 6)], "population double, dw_label int")
    assert [r["prescribable"] for r in feasibility.prescribable_flag(df).collect()] == [True, True, False, True, False, False, False]


def test_optional_columns_of_masks(spark):
    df = spark.createDataFrame([(1, 100.0, 0.5)], "cell_id int, population double, built_frac double")
    r = feasibility.feasibility_masks(df).first()
    assert r["LR2_cool_roof"] and r["LR3_bgi"] and r["SR5_shade_structure"] and not r["SR3_welfare_check"]
    assert len(feasibility.feasibility_columns(df.columns)) == 13


def grid_frame(spark, codes):
    rows = [(1, r, c, int(v)) for r, line in enumerate(codes) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "aoi_id int, row int, col int, code int")


def to_array(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        out[r["row"], r["col"]] = r["code"]
    return out


def test_corner_is_smoothed(spark):
    codes = np.full((8, 8), 5)
    codes[0, 0] = 1
    assert (to_array(neighbors.majority_filter(grid_frame(spark, codes)), (8, 8)) == 5).all()
    with pytest.raises(ValueError):
        neighbors.majority_filter(grid_frame(spark, codes), window=4)


@pytest.mark.parametrize("shape", [(6, 7), (1, 5), (2, 2)])
def test_filters_equal_brute_force(spark, shape):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 3, shape)
    pad = np.pad(codes, 1, mode="edge")
    plain, sticky = codes.copy(), codes.copy()
    for r in range(shape[0]):
        for c in range(shape[1]):
            w = pad[r:r + 3, c:c + 3].ravel()
            plain[r, c] = np.bincount(w).argmax()
            near = np.delete(w, 4)
            sticky[r, c] = w[4] if (near == w[4]).sum() >= 6 else np.bincount(near).argmax()
    df = grid_frame(spark, codes)
    assert (to_array(neighbors.majority_filter(df), shape) == plain).all()
    assert (to_array(neighbors.majority_filter_sticky(df), shape) == sticky).all()


@pytest.mark.parametrize("profile", [None, GroupProfile(40, 500, direct_rows=20)])
def test_priority_takes_the_riskiest_cells(spark, profile):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"cell_id": np.arange(500), "zone_id": np.arange(500) // 25, "hri": rng.random(500).round(2),
                        "population": 100.0, "built_frac": 0.5, "dw_label": 6})
    pdf.loc[::7, "dw_label"] = 0
    cells = spark.createDataFrame(pdf)
    dec = spark.createDataFrame([(z, k, i, q) for z in range(20) for k, i, q in
                                 (("LR1_tree_planting", 1, 5.9), ("LR2_cool_roof", 2, 3.0), ("LR4_cool_pavement", 4, 0.9))],
                                "zone_id int, intervention_key string, k int, qty double")
    got = prescribe.priority_topk(cells, dec, profile=profile).toPandas().set_index("cell_id")["code"].sort_index()
    want = np.zeros(500, dtype=int)
    ok = pdf[pdf.dw_label == 6]
    for code, n in ((6, 5), (7, 3)):
        top = ok.sort_values(["hri", "cell_id"], ascending=[False, True]).groupby("zone_id").head(n)
        want[top.cell_id] = code
    assert (got.to_numpy() == want).all()


# --- registered sizes ----------------------------------------------------------------------
def test_registered_samples_are_the_default():
    import inspect

    from heatloom.operators import uncertainty
    from heatloom.plans import catalog_planning

    for f in (uncertainty.perturb_indicators, uncertainty.mc_distribution):
        assert catalog_planning.SAMPLES == inspect.signature(f).parameters["n"].default
