"""Grids, regridding, downscaling, seasons, heatwaves and streams."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatloom import constants as C
from heatloom.functions.heat import dewpoint_to_rh, heat_index
from heatloom.functions.dates import month_window
from heatloom.operators import downscale as D, grid, heatwave, lookups, seasonal, zones
from heatloom.operators.groups import GroupProfile
from heatloom.sources import readers, writers
from heatloom.streaming import forecast as S


# --- functions ----------------------------------------------------------------------
def test_heat_index(spark):
    df = spark.createDataFrame([(20.0, 80.0), (27.0, 50.0), (35.0, 60.0)], "t double, rh double")
    got = [r[0] for r in df.select(heat_index(F.col("t"), F.col("rh"))).collect()]
    assert got[:2] == [20.0, 27.0] and 43 < got[2] < 47


def test_humidity_is_limited(spark):
    df = spark.createDataFrame([(30.0, 30.0), (30.0, 35.0), (30.0, 10.0)], "t double, td double")
    got = [r[0] for r in df.select(dewpoint_to_rh(F.col("t"), F.col("td"))).collect()]
    assert got[0] == pytest.approx(100) and got[1] == 100.0 and 25 < got[2] < 35


def test_month_window_wraps(spark):
    df = spark.createDataFrame([(2023, [4, 5]), (2023, [1]), (2023, [11, 12])], "y int, m array<int>")
    got = [tuple(map(str, r)) for r in df.select(*month_window(F.col("y"), F.col("m"))).collect()]
    assert got == [("2023-03-01", "2023-07-01"), ("2022-12-01", "2023-03-01"), ("2023-10-01", "2024-02-01")]


def test_unknown_zone_is_an_error(spark):
    df = spark.createDataFrame([(1, "A"), (2, "X")], "aoi_id int, climate_zone string")
    beta = readers.read_beta_table(spark)
    assert lookups.join_beta(df.where("aoi_id = 1"), beta).first()["beta"] == 0.0072
    with pytest.raises(Exception, match="unknown climate zone: X"):
        lookups.join_beta(df, beta).collect()


def test_lookup_tables(spark):
    cdr = {r["country_iso3"]: r["cdr_per_person_per_year"] for r in readers.read_cdr_table(spark).collect()}
    assert len(cdr) == 33 and cdr["IND"] == 0.0072 and cdr["JPN"] == 0.012
    assert readers.read_intervention_params(spark).count() == 129
    assert readers.read_indicator_registry(spark).count() == 14
    g = readers.read_cmip6_delta_grid(spark)
    assert g.count() == 253
    assert g.where("lat_center = 23.5 and lon_center = 72.5").first()["d585"] == 3.2


# --- grids and polygons ----------------------------------------------------------------
def test_cell_grid_size(spark):
    aoi = spark.createDataFrame([(1, 72.5, 23.0, 72.51, 23.01)], "aoi_id int, minx double, miny double, maxx double, maxy double")
    got = grid.cell_grid(aoi).toPandas()
    sy = 100 / 111_320
    sx = 100 / (111_320 * np.cos(np.radians(23.005)))
    assert len(got) == len(np.arange(23.0 + sy / 2, 23.01, sy)) * len(np.arange(72.5 + sx / 2, 72.51, sx))
    assert got.cell_id.is_unique


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("tile", [0.01, 0.3, 5.0])
def test_polygons_equal_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    pts = pd.DataFrame({"cell_id": np.arange(600), "lon": rng.uniform(0, 1, 600), "lat": rng.uniform(0, 1, 600)})
    rings = []
    for _ in range(4):
        a = np.sort(rng.uniform(0, 2 * np.pi, 9))
        r = rng.uniform(0.05, 0.45, 9)
        c = rng.uniform(0.3, 0.7, 2)
        ring = [(float(c[0] + q * np.cos(t)), float(c[1] + q * np.sin(t))) for q, t in zip(r, a)]
        rings.append([*ring, ring[0]])
    polys = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in ring]) for i, ring in enumerate(rings)], f"polygon_id int, ring {grid.RING_TYPE}")
    df = spark.createDataFrame(pts)
    got = {(r["cell_id"], r["polygon_id"]) for r in grid.cells_in_polygon(df, polys, tile_deg=tile).collect()}
    want = {(i, k) for i, x, y in pts.itertuples(index=False) for k, ring in enumerate(rings) if inside(x, y, ring)}
    assert got == want
    assert grid.cells_in_any_polygon(df, polys, tile_deg=tile).count() == len({i for i, _ in want})


def raster(spark, a, name="v"):
    rows = [(1, r, c, None if np.isnan(x) else float(x)) for (r, c), x in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"aoi_id int, row int, col int, {name} double")


def test_average_keeps_the_mean(spark):
    rng = np.random.default_rng(0)
    fine = rng.random((18, 27))
    got = grid.resample_average(raster(spark, fine), ["v"], 4.5).toPandas().pivot(index="row", columns="col", values="v").to_numpy()
    assert got.shape == (4, 6)
    assert got.mean() == pytest.approx(fine.mean())
    block = np.repeat(np.repeat(fine, 2, 0), 2, 1)[:9, :9]
    assert got[0, 0] == pytest.approx(block.mean())


def test_bilinear_of_a_plane_is_exact_inside(spark):
    a = np.add.outer(np.arange(5.0), 2 * np.arange(6.0))
    fine = raster(spark, np.zeros((10, 12))).select("aoi_id", "row", "col")
    got = grid.resample_bilinear(raster(spark, a), fine, "v", 2.0).toPandas()
    g = got[(got.row.between(1, 8)) & (got.col.between(1, 10))]
    np.testing.assert_allclose(g.v, (g.row + 0.5) / 2 - 0.5 + 2 * ((g.col + 0.5) / 2 - 0.5), atol=1e-12)
    assert got.v.notna().all()


# --- kriging ----------------------------------------------------------------------------
def np_kriging(a, zoom, k, var, length, n_sub=5):
    known = np.argwhere(~np.isnan(a))
    s = (np.arange(n_sub) + 0.5) / n_sub - 0.5
    sub = np.array([(p, q) for p in s for q in s])
    cov = lambda d: var * np.where(d < length, 1 - 1.5 * d / length + 0.5 * (d / length) ** 3, 0.0)
    h, w = int(a.shape[0] * zoom), int(a.shape[1] * zoom)
    out = np.zeros((h, w))
    for r in range(h):
        for c in range(w):
            f = np.array([(r + 0.5) / zoom - 0.5, (c + 0.5) / zoom - 0.5])
            d = np.round(np.hypot(*(known - f).T), 9)
            near = known[np.lexsort((known[:, 1], known[:, 0], d))[:k]]
            m = len(near)
            A, b = np.ones((m + 1, m + 1)), np.ones(m + 1)
            A[m, m] = 0
            for i in range(m):
                p = near[i] + sub
                for j in range(m):
                    q = near[j] + sub
                    A[i, j] = cov(np.hypot(*(p[:, None] - q[None]).transpose(2, 0, 1))).mean()
                b[i] = cov(np.hypot(*(p - f).T)).mean()
            out[r, c] = np.linalg.solve(A, b)[:m] @ a[tuple(near.T)]
    return out


@pytest.mark.parametrize("holes", [0.0, 0.5])
def test_kriging_equals_brute_force(spark, holes):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(7, 8))
    a[rng.random(a.shape) < holes] = np.nan
    models = spark.createDataFrame([(1, 1.3, 5.0)], "aoi_id int, var double, length double")
    fine = raster(spark, np.zeros((14, 16))).select("aoi_id", "row", "col")
    got = D.kriging_residuals(raster(spark, a, "resid"), fine, models, k=6, zoom=2.0, radius=1)
    got = got.toPandas().pivot(index="row", columns="col", values="resid_fine").to_numpy()
    np.testing.assert_allclose(got, np_kriging(a, 2.0, 6, 1.3, 5.0), atol=1e-8)


def test_sparse_areas_and_wide_gaps(spark):
    """A raster with a gap wider than the windows beside an area with a few known pixels, against brute force."""
    rng = np.random.default_rng(9)
    wide, sparse = rng.normal(size=(6, 60)), np.full((12, 40), np.nan)
    wide[:, 8:46] = np.nan
    for r, c in ((0, 0), (11, 39), (5, 20), (6, 20)):
        sparse[r, c] = rng.normal()
    both = [(aoi, r, c, None if np.isnan(v) else float(v)) for aoi, a in ((1, wide), (2, sparse)) for (r, c), v in np.ndenumerate(a)]
    coarse = spark.createDataFrame(both, "aoi_id int, row int, col int, resid double")
    fine = coarse.select("aoi_id", "row", "col")
    models = spark.createDataFrame([(1, 1.3, 5.0), (2, 0.7, 9.0)], "aoi_id int, var double, length double")
    got = D.kriging_residuals(coarse, fine, models, k=6, zoom=1.0, radius=1).toPandas()
    near = D.knn_coarse(coarse, fine, "resid", k=6, zoom=1.0, radius=1).toPandas()
    for aoi, a, var, length in ((1, wide, 1.3, 5.0), (2, sparse, 0.7, 9.0)):
        out = got[got.aoi_id == aoi].pivot(index="row", columns="col", values="resid_fine").to_numpy()
        np.testing.assert_allclose(out, np_kriging(a, 1.0, 6, var, length), atol=1e-8)
        known = np.argwhere(~np.isnan(a))
        mine = near[near.aoi_id == aoi]
        assert len(mine) == a.size
        for row in mine.itertuples():
            d = np.hypot(*(known - [row.row, row.col]).T)
            assert np.allclose([n["dist"] for n in row.neighbors], np.sort(d)[:6])


@pytest.mark.parametrize("max_lag", [4.0, 64.0])
def test_variogram_uses_all_pairs(spark, max_lag):
    rng = np.random.default_rng(11)
    a = rng.normal(size=(13, 17))
    a[rng.random(a.shape) < 0.2] = np.nan
    rows = [(1, int(r), int(c), float(c), float(r), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)]
    pts = spark.createDataFrame(rows, "aoi_id int, row int, col int, x double, y double, v double")
    got = {r["bin"]: r for r in D.empirical_variogram(pts, "v", max_lag=max_lag, n_bins=7).collect()}
    known = np.argwhere(~np.isnan(a))
    span = min(0.6 * np.hypot(*(known.max(0) - known.min(0))), max_lag)
    n, s = np.zeros(7, int), np.zeros(7)
    for i in range(len(known)):
        d = np.hypot(*(known[i + 1:] - known[i]).T)
        sq = (a[tuple(known[i + 1:].T)] - a[tuple(known[i])]) ** 2
        for dist, e in zip(d, sq):
            if dist < span:
                k = min(int(np.floor(dist / (span / 7) + 1e-12)), 6)
                n[k] += 1
                s[k] += e
    assert {k: r["n_pairs"] for k, r in got.items()} == {k: c for k, c in enumerate(n) if c}
    assert all(r["gamma"] == pytest.approx(s[k] / (2 * n[k])) and r["center"] == pytest.approx((k + 0.5) * span / 7) for k, r in got.items())


def test_spherical_fit_recovers_the_model():
    h = np.linspace(0.5, 18, 19)
    var, length, nugget = D.fit_spherical(h, 0.3 + 2.0 * (1 - D.spherical(h, 9.0)))
    assert (var, nugget) == (pytest.approx(2.0, rel=0.05), pytest.approx(0.3, abs=0.1)) and length == pytest.approx(9.0, rel=0.05)


def test_downscaling_is_coherent(spark):
    rng = np.random.default_rng(42)
    pop = rng.uniform(0, 200, (45, 45))
    fine = raster(spark, pop, "population")
    covs = grid.resample_average(fine, ["population"], 4.5)
    light = covs.withColumn("ntl", F.col("population") / 10 + F.sin("row"))
    out = D.downscale_nightlights(light, fine, "ntl", ["population"], trees=(5,))
    assert out.count() == 45 * 45
    d = D.downscale_diagnostics(out, light, "light", "ntl").first()
    # Pixels that straddle two coarse pixels follow the one under their centre.
    assert d["cc"] > 0.95 and d["n"] == 100


@pytest.mark.parametrize("name", ["rf_trend", "downscale_nightlights"])
def test_registered_forests_choose_among_all_sizes(spark, monkeypatch, name):
    from heatloom import constants as C

    class Seen(Exception):
        pass

    def forest(coarse, fine, target, covariates, trees=tuple(C.RF_TREES), seed=42, by=()):
        raise Seen(list(trees))

    monkeypatch.setattr(D, "rf_trend", forest)
    import __spark_entry__

    with pytest.raises(Seen) as e:
        __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert e.value.args[0] == C.RF_TREES


def test_downscaling_does_not_depend_on_the_unit(spark):
    """Pixels of 500 units give what pixels of one unit give."""
    rng = np.random.default_rng(43)
    fine = raster(spark, rng.uniform(0, 200, (45, 45)), "population")
    light = raster(spark, rng.uniform(0, 60, (10, 10)), "ntl").join(raster(spark, rng.uniform(0, 200, (10, 10)), "population"), ["aoi_id", "row", "col"])
    one, many = (
        D.downscale_nightlights(light, fine, "ntl", ["population"], trees=(5,), dx=u, dy=u).toPandas().sort_values(["row", "col"])
        for u in (1.0, 500.0))
    assert many["resid_fine"].notna().all()
    np.testing.assert_allclose(many[["resid_fine", "light"]], one[["resid_fine", "light"]], rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("profile", [None, GroupProfile(1, 400, direct_rows=30)])
def test_nldi(spark, profile):
    rng = np.random.default_rng(8)
    v = rng.exponential(size=400)
    df = spark.createDataFrame([(1, i, float(x), 1.0) for i, x in enumerate(v)], "aoi_id int, cell_id int, light double, population double")
    cum = np.cumsum(np.sort(v)) / (v.sum() + 1e-12)
    assert D.nldi(df, "light", "population", profile=profile).first()["nldi"] == pytest.approx(np.clip(1 - 2 * cum[:-1].sum() / 399, 0, 1))


# --- zones ---------------------------------------------------------------------------------
def test_kmeans_separates_clusters(spark):
    rng = np.random.default_rng(0)
    rows = []
    for aoi in (1, 2):
        for i, (x, y) in enumerate([(0, 0), (10, 0), (0, 10)]):
            rows += [(aoi, len(rows) + j, float(x + rng.normal(0, .1)), float(y + rng.normal(0, .1))) for j in range(40)]
    df = spark.createDataFrame(rows, "aoi_id int, cell_id int, lon double, lat double")
    pdf = zones.zones_kmeans(df, k=3, iterations=6, seed=3).toPandas()
    assert len(pdf) == 240 and pdf.groupby("aoi_id").zone_id.nunique().max() <= 3
    tiny = zones.zones_kmeans(df.where("cell_id < 2"), k=15).toPandas()
    assert tiny.zone_id.nunique() == 2


def test_two_level_zones_are_numbered_per_area(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(a, a * 1000 + i, float(x), float(y)) for a in (1, 2) for i, (x, y) in enumerate(rng.random((120, 2)))],
                               "aoi_id int, cell_id int, lon double, lat double")
    z = zones.zones_hierarchical(df, n_macro=3, n_meso=2).toPandas()
    assert len(z) == 240
    for _, g in z.groupby("aoi_id"):
        assert sorted(g.zone_id.unique()) == list(range(g.zone_id.nunique()))
        assert (g.groupby("zone_id").macro_zone_id.nunique() == 1).all()


# --- season and heatwaves ------------------------------------------------------------------
def forecast(spark, value):
    base = dt.datetime(2023, 5, 1)
    rows = [(1, base + dt.timedelta(hours=3 * i), float(value(3 * i))) for i in range(57)]
    return spark.createDataFrame(rows, "aoi_id int, valid_time timestamp, heat_index_c double")


def test_heatwave(spark):
    hot = heatwave.daily_max(forecast(spark, lambda h: 40.0 if 24 <= h <= 96 else 30.0))
    r = heatwave.heatwave_runs(hot, 35.0).first()
    assert r["heatwave_detected"] and r["event_days"] == 4 and str(r["start_date"]) == "2023-05-02" and r["mean_hi_excess"] == 2.0
    calm = heatwave.heatwave_runs(heatwave.daily_max(forecast(spark, lambda h: 31.0)), 35.0).first()
    assert not calm["heatwave_detected"] and calm["event_days"] == 0 and calm["start_date"] is None and calm["max_hi"] == 31.0


def test_missing_day_ends_a_run(spark):
    days = [dt.date(2023, 5, d) for d in (1, 2, 4, 5)]
    df = spark.createDataFrame([(1, d, 50.0) for d in days], "aoi_id int, day date, max_hi double")
    assert heatwave.heatwave_runs(df, 35.0).first()["event_days"] == 0
    assert heatwave.heatwave_runs(df, 35.0, calendar=False).first()["event_days"] == 4


def test_window_of_months_grows(spark):
    monthly = spark.createDataFrame([(1, m, 30.0 - abs(m - 5), 15.0) for m in range(1, 13)], "aoi_id int, month int, mean_tmax_c double, mean_td_c double")
    scenes = spark.createDataFrame([(1, i, dt.datetime(2023, m, 3), 10.0) for i, m in enumerate([5, 6, 6])], "aoi_id int, scene_id int, ts timestamp, cloud_cover double")
    # Months 5 and 4 hold one scene, months 4 to 6 hold three.
    assert seasonal.hottest_months(monthly, scenes, 2023).first()["months"] == [4, 5, 6]
    assert seasonal.hottest_months(monthly, scenes, 2023, min_scenes=99).first()["months"] == [3, 4, 5, 6, 7]
    none = seasonal.period_heat_index(monthly.where("aoi_id = 9"), spark.createDataFrame([(1, [5])], "aoi_id int, months array<int>")).first()
    assert (none["mean_hi_c"], none["max_hi_c"], none["p90_hi_c"]) == (38.0, 44.0, 43.0)


# --- streams --------------------------------------------------------------------------------
def test_streams_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = dt.datetime(2023, 5, 1)
    rows = [(int(i % 2), base + dt.timedelta(hours=int(h)), float(30 + 15 * rng.random())) for i, h in enumerate(rng.integers(0, 240, 300))]
    schema = "aoi_id int, valid_time timestamp, heat_index_c double"
    df = spark.createDataFrame(rows, schema)
    for i in range(3):  # three files, so three micro-batches
        df.where(F.pmod(F.xxhash64("valid_time"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = S.read_forecast_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    got = S.run_available(S.stream_daily_max(src, lateness="60 days"), "t", ["aoi_id", "day"])
    want = heatwave.daily_max(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    alert = S.run_available(S.stream_heatwave_alert(src, 38.0, lateness="60 days"), "a", ["aoi_id"], state_store=S.ROCKSDB)
    daily = want.where("max_hi > 38").toPandas()
    for r in alert.collect():
        days = set(pd.to_datetime(daily[daily.aoi_id == r["aoi_id"]].day).map(lambda d: (d - pd.Timestamp(0)).days))
        run = 1
        while max(days) - run in days:
            run += 1
        assert (r["last_day"], r["run_days"], r["alert"]) == (max(days), run, run >= 3)


# --- files -----------------------------------------------------------------------------------
def test_cells_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 30.0, None), (1, 2, float("nan"), -9999.0)], "aoi_id int, cell_id bigint, lst double, uhi double")
    df.write.parquet(str(tmp_path / "old"))
    got = {r["cell_id"]: r for r in readers.read_indicator_cells(spark, str(tmp_path / "old"), ["lst", "uhi"]).collect()}
    assert got[1]["lst"] == 30.0 and got[2]["lst"] is None and got[2]["uhi"] is None
    with pytest.raises(ValueError, match="ndvi"):
        readers.read_indicator_cells(spark, str(tmp_path / "old"), ["lst", "ndvi"])
    writers.write_result_cells(df, str(tmp_path / "out"), ["lst", "uhi"])
    back = {r["cell_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back[1]["uhi"] == -9999.0 and back[2]["lst"] == -9999.0


def test_newest_file(spark, tmp_path):
    import os
    import time

    for i, v in enumerate((1.0, 2.0)):
        spark.createDataFrame([(1, 1, v)], "aoi_id int, cell_id bigint, lst double").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
        now = time.time() + i * 100
        for f in os.listdir(tmp_path / "d"):
            if f.endswith(".parquet") and i == 0:
                os.utime(tmp_path / "d" / f, (now - 500, now - 500))
    got = readers.read_indicator_cells(spark, str(tmp_path / "d"), ["lst"], newest=True).collect()
    assert [r["lst"] for r in got] == [2.0]


def test_constants_agree():
    assert set(C.INDICATORS) == set(C.BAND_RANGES) == set(C.BAND_NOISE) == set(C.INDICATOR_DIRECTIONS)
    assert all(abs(sum(g.values()) - 1) < 1e-9 for g in C.SUB_INDEX_WEIGHTS.values())
    assert [k.split("_")[0] for k in (*C.SHORT_RUN_KEYS, *C.LONG_RUN_KEYS)] == list(C.INTERVENTION_CODES)[1:]


def test_decompose_chooses_by_size(spark):
    rng = np.random.default_rng(6)
    rows = [(a, i, float(x), float(y)) for a, n in ((1, 6), (2, 40), (3, 700)) for i, (x, y) in enumerate(rng.random((n, 2)))]
    df = spark.createDataFrame(rows, "aoi_id int, cell_id int, lon double, lat double")
    z = zones.decompose(df, n_meso=5).toPandas()
    assert len(z) == 749  # the six cells give nine
    assert z[z.aoi_id == 1].weight.tolist() and z[z.aoi_id != 1].weight.isna().all()
    assert z.groupby("aoi_id")["mode"].first().to_dict() == {1: "moore", 2: "direct", 3: "meso"}
    counts = z.groupby("aoi_id").zone_id.nunique().to_dict()
    assert counts[1] == 9 and counts[2] == 40 and counts[3] <= 5
