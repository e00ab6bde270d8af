"""Index, weights and risk against NumPy restatements."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatloom import constants as C
from heatloom.operators import index, normalize, risk, summaries, uncertainty, weights
from heatloom.operators.groups import GroupProfile

LIMITS = {
    "lst": (28, 48), "albedo": (.05, .35), "uhi": (0, 8), "population": (0, 5000), "built_frac": (0, 1),
    "elderly_frac": (0, .25), "child_frac": (0, .15), "impervious": (0, 1), "cropland": (0, .5), "ndvi": (0, .7),
    "ndwi": (-.3, .5), "tree_cover": (0, 60), "canopy_height": (0, 20), "viirs_dnb": (0, 50),
}
CUT = GroupProfile(1, 900, direct_rows=60)


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(42)
    out = {c: rng.uniform(*LIMITS[c], 900) for c in C.INDICATORS}
    out["viirs_dnb"][rng.random(900) < 0.2] = np.nan
    out["elderly_frac"][:3] = np.nan
    return out


def frame(spark, arrays):
    pdf = pd.DataFrame({**arrays, "cell_id": np.arange(len(arrays["lst"])), "aoi_id": 1})
    pdf = pdf.astype(object).where(pdf.notna(), None)
    schema = ", ".join(f"{c} double" for c in arrays) + ", cell_id bigint, aoi_id int"
    return spark.createDataFrame(pdf, schema).cache()


@pytest.fixture(scope="module")
def cells(spark, arrays):
    return frame(spark, arrays)


def norm(a):
    lo, hi = np.nanpercentile(a, [2, 98])
    return (np.clip(a, lo, hi) - lo) / (hi - lo)


def np_hvi(arrays, weight=lambda s, c, n: 1 / n):
    sub = {}
    for s, g in C.SUB_INDEX_WEIGHTS.items():
        x = np.stack([norm(arrays[c]) for c in g])
        w = np.array([weight(s, c, len(g)) for c in g])[:, None] * np.isfinite(x)
        sub[s] = np.nansum(np.where(np.isfinite(x), x, 0) * w, axis=0) / w.sum(axis=0)
    raw = sub["exposure"] * sub["sensitivity"] / np.maximum(sub["adaptive_capacity"], 0.01)
    return sub["hazard"], (raw - raw.min()) / (raw.max() - raw.min())


@pytest.mark.parametrize("profile", [None, CUT])
def test_hvi_matches_numpy(cells, arrays, profile):
    got = index.hvi(cells, profile=profile).toPandas().sort_values("cell_id")
    h_s, hvi = np_hvi(arrays)
    np.testing.assert_allclose(got["h_s"], h_s, rtol=1e-9)
    np.testing.assert_allclose(got["hvi"], hvi, rtol=1e-9, atol=1e-12)


def test_manual_weights_are_used(cells, arrays):
    got = index.hvi(cells, "manual").toPandas().sort_values("cell_id")
    np.testing.assert_allclose(got["hvi"], np_hvi(arrays, lambda s, c, n: C.SUB_INDEX_WEIGHTS[s][c])[1], rtol=1e-9, atol=1e-12)
    with pytest.raises(ValueError):
        weights.check_manual({"hazard": {"lst": 0.5, "uhi": 0.4}})
    with pytest.raises(ValueError):
        weights.check_manual({"hazard": {"nope": 1.0}})


def test_missing_band_is_an_error(cells):
    with pytest.raises(ValueError, match="viirs_dnb"):
        index.hvi(cells.drop("viirs_dnb"))
    assert index.hvi(cells.drop("viirs_dnb"), allow_missing=True).count() == 900


def test_constant_field_becomes_half(spark):
    df = spark.createDataFrame([(1, 1, 7.0), (1, 2, 7.0), (1, 3, None)], "aoi_id int, cell_id int, x double")
    got = {r["cell_id"]: r["x"] for r in normalize.robust_normalize(df, ["x"]).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: None}


def test_missing_part_gives_missing_index(spark):
    df = spark.createDataFrame([(1.0, .5, .5), (None, .5, .5), (.5, .5, None), (.5, .5, 0.0)], "e double, s double, ac double")
    got = [r[0] for r in df.select(index.hvi_formula(F.col("e"), F.col("s"), F.col("ac"))).collect()]
    assert got == [1.0, None, None, 25.0]


def by_indicator(df):
    return {r["indicator"]: r["w"] for r in df.collect()}


def test_data_driven_weights(cells, arrays):
    normed = normalize.robust_normalize(cells.select("aoi_id", "cell_id", *C.INDICATORS))
    n = {c: norm(arrays[c]) for c in C.INDICATORS}
    pca, ent, cri = (by_indicator(weights.compute_weights(normed, m)) for m in ("pca", "entropy", "critic"))
    for s, g in C.SUB_INDEX_WEIGHTS.items():
        x = np.stack([n[c] for c in g], axis=1)
        x = x[np.isfinite(x).all(axis=1)]
        vec = np.linalg.eigh(np.cov(x.T))[1][:, -1] ** 2
        np.testing.assert_allclose([pca[c] for c in g], vec, rtol=1e-6)
        red = []
        for c in g:
            v = n[c][np.isfinite(n[c])]
            p = np.clip((v - v.min()) / (v.max() - v.min()), 1e-10, 1)
            p = p / p.sum()
            red.append(1 - (-np.sum(p * np.log(p)) / np.log(len(p))))
        np.testing.assert_allclose([ent[c] for c in g], np.array(red) / sum(red), rtol=1e-8)
        ranks = pd.DataFrame(x).rank()
        score = x.std(axis=0) * (1 - ranks.corr().to_numpy()).sum(axis=0)
        np.testing.assert_allclose([cri[c] for c in g], score / score.sum(), rtol=1e-8)
        for w in (pca, ent, cri):
            assert abs(sum(w[c] for c in g) - 1) < 1e-9


def test_critic_with_constant_band_falls_back(spark):
    rng = np.random.default_rng(0)
    a = {c: rng.uniform(size=50) for c in C.INDICATORS}
    a["uhi"][:] = 0.5
    got = by_indicator(weights.weights_critic(frame(spark, a)))
    assert got["lst"] == got["albedo"] == got["uhi"] == pytest.approx(1 / 3)
    assert got["population"] != 0


def test_risk(cells, arrays):
    indexed = index.hvi(cells).join(cells.select("cell_id", "lst", "population"), "cell_id")
    got = risk.hri_pipeline(indexed, cdr=0.007, beta=0.0072).toPandas().sort_values("cell_id")
    h_s, hvi = np_hvi(arrays)
    x = h_s * hvi
    np.testing.assert_allclose(got["hri"], (x - x.min()) / (x.max() - x.min()), rtol=1e-8, atol=1e-12)
    mmt = np.percentile(arrays["lst"], 75)
    rr = np.exp(0.0072 * np.maximum(0, arrays["lst"] - mmt)) * (1 + 0.5 * hvi)
    af = np.clip((rr - 1) / rr, 0, 1)
    np.testing.assert_allclose(got["af"], af, rtol=1e-8, atol=1e-12)
    np.testing.assert_allclose(got["ad_baseline"], arrays["population"] * 0.007 * af * 3, rtol=1e-8, atol=1e-12)


def test_validator(spark, arrays):
    bad = {c: v.copy() for c, v in arrays.items()}
    bad["lst"][:] = 0
    bad["albedo"][:] = 5.0
    bad["uhi"][50:] = np.nan
    bad["canopy_height"][:] = 0
    report = {r["indicator"]: (r["status"], r["issue"]) for r in summaries.validate_bands(frame(spark, bad)).collect()}
    assert report["lst"] == ("fail", "all zero")
    assert report["albedo"] == ("fail", "outside physical range")
    assert report["uhi"] == ("fail", "too few valid pixels")
    assert report["canopy_height"] == ("warning", "all zero")
    assert report["ndvi"] == ("ok", None)
    with pytest.raises(ValueError, match="lst"):
        summaries.assert_valid(summaries.validate_bands(frame(spark, bad)))


def test_sensitivity_and_screening(cells):
    s = uncertainty.weight_sensitivity(cells)
    rows = s.collect()
    assert len(rows) == 28 and all(-1 <= r["spearman_r"] <= 1 for r in rows)
    # The base weights of exposure are 0.7 and 0.3, so its variants differ from the equal nominal.
    assert min(r["spearman_r"] for r in rows if r["sub_index"] == "exposure") < 0.999
    hazard = [r["spearman_r"] for r in rows if r["sub_index"] == "hazard"]
    assert np.allclose(hazard, 1.0)
    m = uncertainty.morris_screen(s).collect()
    assert len(m) == 14 and all(r["mu_star"] >= 0 for r in m)


def test_monte_carlo_is_reproducible(spark, cells):
    small = cells.where("cell_id < 60")
    a = uncertainty.mc_distribution(small, 8).toPandas().sort_values("cell_id")
    b = uncertainty.mc_distribution(small.repartition(7), 8).toPandas().sort_values("cell_id")
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True), check_exact=False, rtol=1e-9)
    assert (a.p10 <= a.p50).all() and (a.p50 <= a.p90).all() and (a.n_valid == 8).all()


def test_spearman_matrix(cells, arrays):
    got = {(r["indicator_a"], r["indicator_b"]): r["rho"] for r in uncertainty.spearman_matrix(cells).collect()}
    want = pd.DataFrame(arrays).corr(method=lambda a, b: np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1])
    assert len(got) == 91
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_weighting_comparison_equals_single_runs(cells):
    both = index.weighting_comparison(cells, ("equal", "entropy")).toPandas()
    assert len(both) == 1800
    for m in ("equal", "entropy"):
        one = index.hvi(cells, m).toPandas().sort_values("cell_id")["hvi"].to_numpy()
        got = both[both.method == m].sort_values("cell_id")["hvi"].to_numpy()
        np.testing.assert_allclose(got, one, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
def test_normals_are_independent_and_standard(spark, method):
    """Draws of one hash share no mean, spread or correlation, and the first ones do not depend on how many are made."""
    from heatloom.functions.random import normals

    ids = spark.range(20_000)
    x = ids.select(*[z.alias(f"z{i}") for i, z in enumerate(normals(6, 3, "id", method=method))]).toPandas().to_numpy()
    assert np.isfinite(x).all()
    assert np.abs(x.mean(axis=0)).max() < 0.03 and np.abs(x.std(axis=0) - 1).max() < 0.03
    assert np.abs(np.corrcoef(x.T) - np.eye(6)).max() < 0.03
    assert np.abs(np.corrcoef((x * x).T) - np.eye(6)).max() < 0.04
    assert np.abs(np.sort(x, axis=0)[[500, 10_000, 19_500]] - np.array([[-1.96], [0.0], [1.96]])).max() < 0.1
    few = ids.select(*[z.alias(f"z{i}") for i, z in enumerate(normals(3, 3, "id", method=method))]).toPandas().to_numpy()
    assert (few == x[:, :3]).all()
