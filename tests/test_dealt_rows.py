"""Work per row does not depend on how many files or vertices hold it."""

import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from heatloom.operators import grid, lookups


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_nearest_centres_of_one_partition_are_searched_by_all_tasks(spark):
    rng = np.random.default_rng(4)
    centres = [(i, float(a), float(b), i / 10.0, i / 20.0) for i, (a, b) in enumerate(rng.integers(0, 40, (250, 2)))]
    centres.append((250, *centres[0][1:3], 0.0, 0.0))  # an equal place: the smaller id wins
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 80, (500, 2)) / 2)] + [(900, None, 1.0), (901, 1.0, float("nan"))]
    points = spark.createDataFrame(rows, "aoi_id int, lat double, lon double").coalesce(1)
    table = spark.createDataFrame(centres, "grid_id int, lat_center double, lon_center double, d245 double, d585 double")
    out = lookups.nearest_delta(points, table)
    assert out.schema["grid_id"].dataType == table.schema["grid_id"].dataType
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    for r in out.collect():
        if r["aoi_id"] >= 900:
            assert [r[c] for c in ("grid_id", "distance", "d245", "d585")] == [None] * 4
            continue
        best = min((float(np.sqrt((c[1] - r["lat"]) ** 2 + (c[2] - r["lon"]) ** 2)), *c[:1], *c[3:]) for c in centres)
        assert (r["distance"], r["grid_id"], r["d245"], r["d585"]) == best


def test_ring_is_projected_once(spark):
    ring = [(72.0, 23.0), (72.1, 23.0), (72.2, 23.1), (72.0, 23.1), (72.0, 23.0)]
    aois = spark.createDataFrame([(1, ring)], f"aoi_id int, ring {grid.RING_TYPE}")
    out = grid.cell_count_estimate(aois)
    assert plan(out).lower().count("tan(") == 1 and out.columns == ["aoi_id", "ring", "area_km2", "n_cells", "mode"]
    r = 6378.137
    m = lambda y: np.log(np.tan(np.pi / 4 + np.radians(y) / 2)) * r
    assert np.isclose(out.first()["area_km2"], np.radians(0.15) * r * (m(23.1) - m(23.0)))
