"""k-means with several starts, and nearest centres on tiles, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.operators import lookups, zones


def cells(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for aoi, n in ((1, 400), (2, 150), (3, 7)):
        centre = rng.uniform(0, 1, (9, 2))[rng.integers(0, 9, n)]
        xy = (centre + rng.normal(0, 0.03, (n, 2))).round(3)
        rows += [(aoi, aoi * 1000 + i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "aoi_id int, cell_id long, lon double, lat double")


def report(df, z):
    return {r["aoi_id"]: r for r in zones.zones_report(df, z).collect()}


@pytest.mark.parametrize("task_points", [50_000, 10])
def test_the_best_start_is_a_fixed_point(spark, task_points):
    df = cells(spark)
    many = report(df, zones.zones_kmeans(df, 9, task_points=task_points, starts=6))
    assert {k: (r["n_cells"], r["n_zones"], r["misplaced"]) for k, r in many.items()} == {1: (400, 9, 0), 2: (150, 9, 0), 3: (7, 7, 0)}
    one = report(df, zones.zones_kmeans(df, 9, task_points=task_points, starts=1))
    assert all(many[a]["inertia"] <= one[a]["inertia"] + 1e-6 for a in many)
    assert sum(many[a]["inertia"] for a in many) < sum(one[a]["inertia"] for a in many)


def test_both_ways_find_the_same_zones(spark):
    df = cells(spark, 3)
    a, b = (report(df, zones.zones_kmeans(df, 6, task_points=t, starts=4)) for t in (50_000, 10))
    assert all(a[k]["inertia"] == pytest.approx(b[k]["inertia"], rel=1e-6) for k in a)


def test_too_few_rounds_are_an_error(spark):
    with pytest.raises(Exception, match="still moves"):
        zones.zones_kmeans(cells(spark), 9, iterations=1).collect()


@pytest.mark.parametrize("n, per_tile", [(3000, 64), (3000, 3), (1, 64), (2, 64)])
def test_nearest_centre_equals_brute_force(spark, n, per_tile):
    """Dense, sparse and far places, equal centres and ties."""
    rng = np.random.default_rng(n)
    y = np.concatenate([rng.normal(10, 0.01, n // 2), rng.uniform(-60, 60, n - n // 2)]).round(3)
    x = np.concatenate([rng.normal(20, 0.01, n // 2), rng.uniform(-170, 170, n - n // 2)]).round(3)
    ids = rng.permutation(n)
    grid = spark.createDataFrame([(int(i), float(a), float(b), float(i) / 10, float(i) / 5) for i, a, b in zip(ids, y, x)],
                                 "grid_id int, lat_center double, lon_center double, d245 double, d585 double")
    q = np.concatenate([rng.normal([10, 20], 0.02, (150, 2)), rng.uniform([-80, -180], [80, 180], (150, 2)), [[500.0, -900.0], [10.0, 20.0]]]).round(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(q)] + [(900, None, 1.0), (901, float("nan"), 1.0), (0, float(q[0, 0]), float(q[0, 1]))]
    aois = spark.createDataFrame(rows, "aoi_id int, lat double, lon double")
    got = lookups.nearest_delta(aois, grid, literal_rows=0, per_tile=per_tile).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["aoi_id"] >= 900:
            assert r["grid_id"] is None and r["distance"] is None
            continue
        d = np.sqrt((y - r["lat"]) ** 2 + (x - r["lon"]) ** 2)
        best = min(zip(d.tolist(), ids.tolist()))
        assert (r["distance"], r["grid_id"]) == best and r["d245"] == best[1] / 10
    if n > 2:
        few = aois.where("aoi_id < 20")
        literal = lookups.nearest_delta(few, grid, literal_rows=10**6).select("aoi_id", "grid_id", "distance")
        tiles = lookups.nearest_delta(few, grid, literal_rows=0).select("aoi_id", "grid_id", "distance")
        assert sorted(map(tuple, literal.collect())) == sorted(map(tuple, tiles.collect()))


def test_nearest_of_an_empty_grid(spark):
    grid = spark.createDataFrame([], "grid_id int, lat_center double, lon_center double, d245 double, d585 double")
    aois = spark.createDataFrame([(1, 2.0, 3.0)], "aoi_id int, lat double, lon double")
    for limit in (0, 10):
        r = lookups.nearest_delta(aois, grid, literal_rows=limit - 1 if limit == 0 else limit).first()
        assert r["grid_id"] is None and r["d245"] is None


def test_lookups_join_any_number_of_rows(spark):
    aois = spark.range(20).select(F.col("id").alias("aoi_id"), F.concat(F.lit("Z"), F.col("id")).alias("climate_zone"))
    beta = spark.range(6000).select(F.concat(F.lit("Z"), F.col("id")).alias("climate_zone"), (F.col("id") / 1000).alias("beta_per_degC"))
    assert {r["aoi_id"]: r["beta"] for r in lookups.join_beta(aois, beta).collect()} == {i: i / 1000 for i in range(20)}
