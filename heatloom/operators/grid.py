"""Regular grids, polygons and regridding."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from heatloom import constants as C
from heatloom.functions.labels import koppen_zone, size_mode
from heatloom.operators.groups import DEFAULT_BY
from heatloom.operators.polygons import geojson_of_parts, geometry_measures, points_in_polygons

RING_TYPE = "array<struct<x:double,y:double>>"


# --- area of interest ----------------------------------------------------------
def ring_area(ring: Column, x: str = "x", y: str = "y") -> Column:
    """Signed area of a closed ring (shoelace), taken from its first vertex to keep the products small."""
    n = F.size(ring)
    x0, y0 = ring[0][x], ring[0][y]
    cross = F.zip_with(
        F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1),
        lambda p, q: (p[x] - x0) * (q[y] - y0) - (q[x] - x0) * (p[y] - y0),
    )
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2.0


def ring_bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def aoi_bounds_centroid(aois: DataFrame, key: str = "aoi_id") -> DataFrame:
    """Add bounds and the area-weighted centroid of the ring, or of ``parts`` with their holes taken off."""
    if "parts" in aois.columns:
        return aois.join(geometry_measures(aois, key).drop("area"), key, "left")
    ring = F.col("ring")
    # Coordinates relative to the first vertex keep the cross products small.
    local = F.transform(ring, lambda p: F.struct((p["x"] - ring[0]["x"]).alias("x"), (p["y"] - ring[0]["y"]).alias("y")))
    out = aois.withColumns({**ring_bounds(ring), "_local": local})
    n = F.size("_local")

    def moment(axis: str) -> Column:
        terms = F.zip_with(
            F.slice("_local", F.lit(1), n - 1), F.slice("_local", F.lit(2), n - 1),
            lambda p, q: (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"]),
        )
        return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    area6 = 6.0 * ring_area(F.col("_local"))
    return out.withColumns({
        "lon": ring[0]["x"] + F.try_divide(moment("x"), area6),
        "lat": ring[0]["y"] + F.try_divide(moment("y"), area6),
    }).drop("_local")


def mercator_ring(ring: Column) -> Column:
    r = C.WEB_MERCATOR_RADIUS_M
    return F.transform(ring, lambda p: F.struct(
        (F.radians(p["x"]) * r).alias("x"),
        (F.log(F.tan(math.pi / 4 + F.radians(p["y"]) / 2.0)) * r).alias("y"),
    ))


def cell_count_estimate(aois: DataFrame, key: str = "aoi_id") -> DataFrame:
    """Add area_km2, n_cells and mode; the area of ``ring`` or ``parts`` is measured on the Web-Mercator plane."""
    if "parts" in aois.columns:
        plane = geometry_measures(aois, key, C.WEB_MERCATOR_RADIUS_M)
        out = aois.join(plane.select(key, (F.col("area") / 1e6).alias("area_km2")), key, "left")
    else:
        # The plane ring is a column of its own: as an expression it would be worked out again at every vertex.
        out = aois.withColumn("_plane", mercator_ring(F.col("ring")))
        out = out.withColumn("area_km2", F.abs(ring_area(F.col("_plane"))) / 1e6).drop("_plane")
    n = F.greatest(F.lit(1), F.ceil(F.col("area_km2") * 1e6 / (C.CELL_SIZE_M**2)))
    out = out.withColumn("n_cells", n.cast("long"))
    return out.withColumn("mode", size_mode(F.col("n_cells")))


def aoi_validate(aois: DataFrame, current_year: int) -> DataFrame:
    """Status (ok, warning, error) and reason per area of interest."""
    checked = cell_count_estimate(aois)
    year_bad = ~F.col("year").between(C.FIRST_YEAR, current_year)
    empty = F.col("ring").isNull() | (F.size("ring") < 4)
    flat = F.coalesce(F.col("area_km2"), F.lit(0.0)) <= 0
    reason = (
        F.when(empty, "empty geometry").when(flat, "zero area").when(year_bad, "year out of range")
        .when(F.col("area_km2") > C.HUGE_AOI_KM2, "very large area")
        .when(F.col("mode") == "hierarchical", "many cells")
    )
    status = F.when(empty | flat | year_bad, "error").when(reason.isNotNull(), "warning").otherwise("ok")
    return checked.select(*aois.columns, "area_km2", "n_cells", "mode", status.alias("status"), reason.alias("reason"))


def aoi_describe(aois: DataFrame) -> DataFrame:
    """Bounds, centroid, cell estimate, mode and climate zone in one projection."""
    out = cell_count_estimate(aoi_bounds_centroid(aois))
    return out.withColumn("climate_zone", koppen_zone(F.col("lat")))


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Closed counter-clockwise ring of a box."""
    corners = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def aoi_geojson(aois: DataFrame) -> DataFrame:
    """Add the ring, or ``parts`` with holes, as GeoJSON text."""
    if "parts" in aois.columns:
        return aois.withColumn("geojson", geojson_of_parts(F.col("parts")))
    coords = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    return aois.withColumn(
        "geojson", F.to_json(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))
    )


def ring_from_geojson(df: DataFrame, column: str = "geojson") -> DataFrame:
    """Outer ring of a GeoJSON polygon text."""
    parsed = F.from_json(column, "type string, coordinates array<array<array<double>>>")
    return df.withColumn("ring", F.transform(
        parsed["coordinates"][0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ))


# --- cells ---------------------------------------------------------------------
def pixel_center(row: Column, col: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Centre coordinates of a pixel: origin + (index + 0.5) * step."""
    return x0 + (col + 0.5) * dx, y0 + (row + 0.5) * dy


def _grid_rows(meta: DataFrame, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows and columns of a grid.  Grid rows are spread over tasks before columns are added."""
    rows = meta.where((F.col("n_rows") > 0) & (F.col("n_cols") > 0)).select(
        *by, *keep, "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row")
    ).repartition(*by, "row")
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))


def cell_grid(aois: DataFrame, by: Sequence[str] = DEFAULT_BY, cell_m: float = C.CELL_SIZE_M) -> DataFrame:
    """Cell centres stepping 100 m over the bounds (minx, miny, maxx, maxy) of every area.

    The longitude step is corrected by the cosine of the middle latitude.
    """
    step_lat = F.lit(cell_m / C.M_PER_DEGREE)
    mid = (F.col("miny") + F.col("maxy")) / 2.0
    meta = aois.select(*by, "minx", "miny", "maxx", "maxy", step_lat.alias("_dy"),
                       (F.lit(cell_m) / (C.M_PER_DEGREE * F.cos(F.radians(mid)))).alias("_dx"))
    count = lambda lo, hi, step: F.ceil((F.col(hi) - (F.col(lo) + F.col(step) / 2.0)) / F.col(step)).cast("int")
    meta = meta.withColumns({"n_rows": count("miny", "maxy", "_dy"), "n_cols": count("minx", "maxx", "_dx")})
    cells = _grid_rows(meta, by, ["minx", "miny", "_dx", "_dy"])
    lon, lat = pixel_center(F.col("row"), F.col("col"), F.col("minx"), F.col("miny"), F.col("_dx"), F.col("_dy"))
    cell_id = F.col("row").cast("long") * F.col("n_cols") + F.col("col")
    return cells.select(*by, cell_id.alias("cell_id"), "row", "col", lon.alias("lon"), lat.alias("lat"))


def moore_cells(aois: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """The nine weighted cells around a centroid (lat, lon)."""
    dlat = F.lit(C.CELL_SIZE_M / C.M_PER_DEGREE)
    dlon = F.lit(C.CELL_SIZE_M) / (C.M_PER_DEGREE * F.cos(F.radians(F.col("lat"))))
    cells = F.array(*[
        F.struct(F.lit(i).cast("long").alias("cell_id"), (F.col("lon") + c * dlon).alias("lon"),
                 (F.col("lat") + r * dlat).alias("lat"), F.lit(role).alias("type"), F.lit(w).alias("weight"),
                 F.lit(i).alias("zone_id"))
        for i, (r, c, role, w) in enumerate(C.MOORE_OFFSETS)
    ])
    return aois.select(*by, F.inline(cells))


def direct_cells(cells: DataFrame) -> DataFrame:
    return cells.withColumn("zone_id", F.col("cell_id").cast("int"))


def bbox_filter(cells: DataFrame, minx: float, miny: float, maxx: float, maxy: float, grow_cells: int = 0) -> DataFrame:
    """Cells inside a box, optionally grown by whole cells.  Constants only, so the scan prunes."""
    g = grow_cells * C.CELL_SIZE_M / C.M_PER_DEGREE
    return cells.where(F.col("lon").between(minx - g, maxx + g) & F.col("lat").between(miny - g, maxy + g))


def point_bbox(lat: float, lon: float, margin: float = 0.25) -> tuple[float, float, float, float]:
    return lon - margin, lat - margin, lon + margin, lat + margin


def aoi_circle_cells(cells: DataFrame, circles: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """Cells of the group within radius_km of its centre (lat0, lon0), by great-circle distance."""
    joined = cells.join(circles.select(*by, "lat0", "lon0", "radius_km"), list(by))
    dlat, dlon = F.radians(F.col("lat") - F.col("lat0")), F.radians(F.col("lon") - F.col("lon0"))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians("lat0")) * F.cos(F.radians("lat")) * F.pow(F.sin(dlon / 2), 2)
    dist = 2.0 * C.EARTH_RADIUS_M * F.asin(F.sqrt(a))
    return joined.where(dist <= F.col("radius_km") * 1000.0).drop("lat0", "lon0", "radius_km")


# --- polygons ------------------------------------------------------------------
def cells_in_polygon(
    cells: DataFrame, polygons: DataFrame, polygon_id: str = "polygon_id", tile_deg: float = 0.05
) -> DataFrame:
    """Inner join of cells and the polygons that contain them.

    ``polygons`` has one ``ring`` per polygon, ``parts`` with holes, or rows of edges
    (see ``polygons.polygon_edges``).
    """
    return points_in_polygons(cells, polygons, polygon_id, tile_deg)


def cells_in_any_polygon(
    cells: DataFrame, polygons: DataFrame, key: Sequence[str] = ("cell_id",), polygon_id: str = "polygon_id",
    tile_deg: float = 0.05,
) -> DataFrame:
    """Cells that lie in at least one polygon, each once."""
    hits = cells_in_polygon(cells.select(*key, "lon", "lat"), polygons, polygon_id, tile_deg)
    return cells.join(hits.select(*key), list(key), "left_semi")


# --- regridding ----------------------------------------------------------------
def fine_grid(meta: DataFrame, zoom: float = C.DOWNSCALE_ZOOM, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """Pixels of the grid that is ``zoom`` times finer.

    ``meta`` has (by, height, width, x0, y0, dx, dy) of the coarse grid.
    """
    m = meta.select(
        *by, "x0", "y0", (F.col("dx") / zoom).alias("dx"), (F.col("dy") / zoom).alias("dy"),
        F.bround(F.col("height") * F.lit(float(zoom))).cast("int").alias("n_rows"),
        F.bround(F.col("width") * F.lit(float(zoom))).cast("int").alias("n_cols"),
    )
    cells = _grid_rows(m, by, ["x0", "y0", "dx", "dy"])
    x, y = pixel_center(F.col("row"), F.col("col"), F.col("x0"), F.col("y0"), F.col("dx"), F.col("dy"))
    return cells.select(*by, "row", "col", x.alias("x"), y.alias("y"))


def _overlaps(index: Column, zoom: float) -> Column:
    """Coarse indices a fine pixel overlaps, with the overlap length."""
    lo, hi = index / F.lit(float(zoom)), (index + 1) / F.lit(float(zoom))
    cells = F.sequence(F.floor(lo).cast("int"), (F.ceil(hi) - 1).cast("int"))
    return F.transform(cells, lambda c: F.struct(
        c.alias("i"), (F.least(hi, (c + 1).cast("double")) - F.greatest(lo, c.cast("double"))).alias("w")
    ))


def resample_average(
    fine: DataFrame, columns: Sequence[str], zoom: float = C.DOWNSCALE_ZOOM, by: Sequence[str] = DEFAULT_BY
) -> DataFrame:
    """Overlap-weighted mean of fine pixels per coarse pixel; missing pixels are left out."""
    placed = fine.select(
        *by, *columns, F.explode(_overlaps(F.col("row"), zoom)).alias("_r"), F.col("col").alias("_col")
    ).select("*", F.explode(_overlaps(F.col("_col"), zoom)).alias("_c"))
    w = F.col("_r.w") * F.col("_c.w")
    weight = lambda c: F.when(F.col(c).isNotNull(), w)
    return placed.where(w > 1e-12).groupBy(*by, F.col("_r.i").alias("row"), F.col("_c.i").alias("col")).agg(
        *[(F.sum(F.col(c) * w) / F.sum(weight(c))).alias(c) for c in columns]
    )


def nearest_source(index: Column, zoom: float) -> Column:
    """Coarse index under the centre of a fine pixel."""
    return F.floor((index + 0.5) / F.lit(float(zoom))).cast("int")


def resample_nearest(
    coarse: DataFrame, fine: DataFrame, columns: Sequence[str], zoom: float = C.DOWNSCALE_ZOOM,
    by: Sequence[str] = DEFAULT_BY,
) -> DataFrame:
    """Add coarse columns to the fine pixels whose centres they cover."""
    side = coarse.select(*by, F.col("row").alias("_cr"), F.col("col").alias("_cc"), *columns)
    keyed = fine.withColumns({"_cr": nearest_source(F.col("row"), zoom), "_cc": nearest_source(F.col("col"), zoom)})
    return keyed.join(side, [*by, "_cr", "_cc"], "left").drop("_cr", "_cc")


def resample_bilinear(
    source: DataFrame, target: DataFrame, column: str | Sequence[str], zoom: float, by: Sequence[str] = DEFAULT_BY
) -> DataFrame:
    """Bilinear values of ``source`` at the pixel centres of a grid ``zoom`` times finer.

    Missing and outside neighbours are left out and the weights rescaled.  Several
    columns of a raster share one pass.
    """
    columns = [column] if isinstance(column, str) else list(column)

    def near(index: Column) -> Column:
        pos = (index + 0.5) / F.lit(float(zoom)) - 0.5
        base = F.floor(pos)
        frac = pos - base
        return F.array(
            F.struct(base.cast("int").alias("i"), (1.0 - frac).alias("w")),
            F.struct((base + 1).cast("int").alias("i"), frac.alias("w")),
        )

    spread = (
        target.select(*by, "row", "col", F.explode(near(F.col("row"))).alias("_r"))
        .select("*", F.explode(near(F.col("col"))).alias("_c"))
        .select(*by, "row", "col", F.col("_r.i").alias("_sr"), F.col("_c.i").alias("_sc"),
                (F.col("_r.w") * F.col("_c.w")).alias("_w"))
        .where(F.col("_w") > 0)
    )
    side = source.where(F.coalesce(*columns).isNotNull() if len(columns) > 1 else F.col(columns[0]).isNotNull()).select(
        *by, F.col("row").alias("_sr"), F.col("col").alias("_sc"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)]
    )
    return spread.join(side, [*by, "_sr", "_sc"], "left").groupBy(*by, "row", "col").agg(*[
        (F.sum(F.col(f"_v{i}") * F.col("_w")) / F.sum(F.when(F.col(f"_v{i}").isNotNull(), F.col("_w")))).alias(c) for i, c in enumerate(columns)
    ])
