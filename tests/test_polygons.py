"""Points in polygons with parts and holes, and measures of such polygons."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom import constants as C
from heatloom.operators import grid, polygons as P

PARTS = "array<array<array<struct<x:double,y:double>>>>"


def odd(px, py, rings):
    """Ray casting over all rings at once, with the crossing kept between the ends of its edge."""
    n = np.zeros(len(px), int)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            over = (y1 > py) != (y2 > py)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = np.clip((x2 - x1) * (py - y1) / (y2 - y1) + x1, min(x1, x2), max(x1, x2))
            n += over & (px < at)
    return n % 2 == 1


def star(rng, cx, cy, r, n):
    a = np.sort(rng.uniform(0, 2 * np.pi, n))
    q = r * rng.uniform(0.3, 1, n)
    return [(float(cx + d * np.cos(t)), float(cy + d * np.sin(t))) for d, t in zip(q, a)]


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def frame(spark, shapes):
    rows = [(i, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts]) for i, parts in enumerate(shapes)]
    return spark.createDataFrame(rows, f"polygon_id int, parts {PARTS}")


def shapes():
    rng = np.random.default_rng(4)
    out = [[[star(rng, *rng.uniform(0.3, 0.7, 2), 0.4, 12), star(rng, 0.5, 0.5, 0.1, 7)], [square(0.02, 0.9, 0.05)]] for _ in range(3)]
    out.append([[square(0.25, 0.25, 0.5), square(0.375, 0.375, 0.25)], [square(0.4375, 0.4375, 0.125)]])  # corners on tile borders; an island in a lake
    out.append([[[(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.5, 0.3), (0.1, 0.9), (0.1, 0.1)]]])  # closed twice
    out.append([[[(0.2, 0.2), (0.8, 0.2)]]])  # no area
    return out


@pytest.mark.parametrize("tile, most", [(0.0625, 4000), (0.3, 4000), (5.0, 4000), (0.5, 3)])
def test_parts_and_holes_equal_brute_force(spark, tile, most):
    rng = np.random.default_rng(1)
    grid_points = [(x / 16, y / 16) for x in range(17) for y in range(17)]  # on corners, edges and tile borders
    pts = [*map(tuple, rng.uniform(-0.1, 1.1, (600, 2))), *grid_points]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(9999, None, 0.5), (9998, 0.5, None)]
    df = spark.createDataFrame(rows, "cell_id int, lon double, lat double")
    got = {(r["cell_id"], r["polygon_id"]) for r in P.points_in_polygons(df, frame(spark, shapes()), tile=tile, most=most).collect()}
    px, py = np.array(pts).T
    want = {(int(i), k) for k, parts in enumerate(shapes()) for i in np.flatnonzero(odd(px, py, [r for p in parts for r in p]))}
    assert got == want


def test_slanted_edges_through_tile_corners(spark):
    """Points level with places where slanted edges meet tile borders, in thirds and tenths."""
    ring = [(0.1, 0.1), (0.7, 0.3), (1.0, 0.9), (0.4, 0.7)]
    ys = sorted({float(y) for y in np.arange(0, 1.01, 1 / 30)} | {0.1 * k for k in range(11)})
    pts = [(x, y) for x in (0.05 * k for k in range(22)) for y in ys]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "cell_id int, lon double, lat double")
    px, py = np.array(pts).T
    want = set(np.flatnonzero(odd(px, py, [ring])).tolist())
    for tile in (0.1, 1 / 3, 0.05):
        got = {r["cell_id"] for r in P.points_in_polygons(df, frame(spark, [[[ring]]]), tile=tile).collect()}
        assert got == want


def test_a_lake_is_outside_the_city(spark):
    city = frame(spark, [[[square(0, 0, 1), square(0.4, 0.4, 0.2)]]])
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.1, 0.5), (3, 1.5, 0.5)], "cell_id int, lon double, lat double")
    assert [r["cell_id"] for r in grid.cells_in_polygon(df, city).collect()] == [2]
    assert [r["cell_id"] for r in grid.cells_in_any_polygon(df, city).collect()] == [2]


def test_a_long_ring_comes_as_vertices(spark):
    """A ring of 300,000 vertices, dense enough that tiles are cut smaller; no row holds more than some of its edges."""
    n = 300_000
    t = 2 * np.pi * np.arange(n) / n
    r = 0.4 + 0.05 * np.sin(40 * t)
    x, y = 0.5 + r * np.cos(t), 0.5 + r * np.sin(t)
    import pandas as pd

    v = spark.createDataFrame(pd.DataFrame({"polygon_id": 7, "part": 0, "ring_no": 0, "seq": np.arange(n), "x": x, "y": y}))
    edges = P.edges_from_vertices(v).cache()
    assert edges.count() == n
    size = P.fitting_tile(edges, ["polygon_id"], 0.25, 1000)
    tiles = P.polygon_tiles(edges, ["polygon_id"], size)
    assert size < 0.25 and tiles.agg(F.max(F.size("_edges"))).first()[0] <= 1000
    pts = np.random.default_rng(2).uniform(0, 1, (3000, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "cell_id int, lon double, lat double")
    got = {r["cell_id"] for r in P.points_in_polygons(df, edges, tile=0.25, most=1000).collect()}
    d, a = np.hypot(*(pts - 0.5).T), np.arctan2(*(pts - 0.5).T[::-1])
    want = set(np.flatnonzero(d < 0.4 + 0.05 * np.sin(40 * a)).tolist())
    assert len(got ^ want) <= 2  # a point within 1e-9 of the outline may differ
    edges.unpersist()


def test_measures_and_geojson(spark):
    parts = [[square(0, 0, 4), square(1, 1, 2)], [square(10, 0, 1)[::-1]]]
    df = frame(spark, [parts]).withColumnRenamed("polygon_id", "aoi_id")
    r = grid.aoi_bounds_centroid(df).first()
    assert (r["minx"], r["miny"], r["maxx"], r["maxy"]) == (0, 0, 11, 4)
    assert r["lon"] == pytest.approx((16 * 2 - 4 * 2 + 10.5) / 13) and r["lat"] == pytest.approx((16 * 2 - 4 * 2 + 0.5) / 13)
    text = grid.aoi_geojson(df).first()["geojson"]
    geo = json.loads(text)
    assert geo["type"] == "MultiPolygon" and [len(p) for p in geo["coordinates"]] == [2, 1]
    back = P.parts_from_geojson(spark.createDataFrame([(text,), ('{"type":"Point","coordinates":[1,2]}',)], "geojson string")).collect()
    assert [[[tuple(v) for v in ring] for ring in p] for p in back[0]["parts"]] == [[[(float(x), float(y)) for x, y in ring] for ring in p] for p in parts]
    assert back[1]["parts"] is None
    single = frame(spark, [[parts[0]]]).withColumnRenamed("polygon_id", "aoi_id")
    assert json.loads(grid.aoi_geojson(single).first()["geojson"])["type"] == "Polygon"
    flat = frame(spark, [[[[(0, 0), (1, 1)]]]]).withColumnRenamed("polygon_id", "aoi_id")
    assert grid.aoi_bounds_centroid(flat).first()["lon"] is None
    small = frame(spark, [[[square(72.5, 23.0, 0.01)], [square(72.6, 23.0, 0.01)]]]).withColumnRenamed("polygon_id", "aoi_id")
    ring = spark.createDataFrame([(0, [{"x": x, "y": y} for x, y in [*square(72.5, 23.0, 0.01), (72.5, 23.0)]])], f"aoi_id int, ring {grid.RING_TYPE}")
    assert grid.cell_count_estimate(small).first()["area_km2"] == pytest.approx(2 * grid.cell_count_estimate(ring).first()["area_km2"], rel=1e-9)
    assert C.WEB_MERCATOR_RADIUS_M > 6e6
