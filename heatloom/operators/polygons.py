"""Polygons with parts and holes as tables of edges, and the points inside them.

A geometry is a set of closed rings; a point is inside when a ray to the east crosses
an odd number of edges, so holes and separate parts need no special case.  Edges are
rows, never one array per polygon.

Points and polygons meet on square tiles.  A tile knows the edges that pass through it
and whether the other edges make it odd.  The ray of a point ends at the tile's eastern
border; whether the border point itself lies inside follows from the edges that cross
the border's meridian further up.  Both counts use one test per edge, so their sum is
the plain ray-casting result, whatever the rounding: each edge that crosses the
meridian is above or below the border point, and its two ends decide the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

EDGE = ("x1", "y1", "x2", "y2")
#: Edges of a tile that are held in one row; beyond it smaller tiles are used.
TILE_EDGES = 4_000
#: Tiles are not cut smaller than this share of the first size.
SMALLEST = 4.0**-6


# --- edges -------------------------------------------------------------------------
def _ring_edges(ring: Column) -> Column:
    """Edges of a ring, with the one that closes it (of no length where the ring is closed already)."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    return F.zip_with(ring, following, lambda p, q: F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def polygon_edges(polygons: DataFrame, polygon_id: str | Sequence[str] = "polygon_id") -> DataFrame:
    """(polygon_id, part, ring_no, x1, y1, x2, y2), one row per edge.

    ``polygons`` has ``ring`` (one outer ring), or ``parts`` (arrays of rings of
    vertices: the first ring of a part is its outline, the others are holes), or it is
    such an edge table already.
    """
    ids = [polygon_id] if isinstance(polygon_id, str) else list(polygon_id)
    if set(EDGE) <= set(polygons.columns):
        missing = [F.lit(0).alias(c) for c in ("part", "ring_no") if c not in polygons.columns]
        return polygons.select("*", *missing).select(*ids, "part", "ring_no", *EDGE)
    if "parts" in polygons.columns:
        rings = polygons.select(*ids, F.posexplode("parts").alias("part", "_rings")).select(*ids, "part", F.posexplode("_rings").alias("ring_no", "_ring"))
    else:
        rings = polygons.select(*ids, F.lit(0).alias("part"), F.lit(0).alias("ring_no"), F.col("ring").alias("_ring"))
    return rings.select(*ids, "part", "ring_no", F.inline(_ring_edges(F.col("_ring"))))


def edges_from_vertices(
    vertices: DataFrame, polygon_id: str | Sequence[str] = "polygon_id", part: str = "part", ring: str = "ring_no", seq: str = "seq",
) -> DataFrame:
    """Edge table of a vertex table (polygon_id, part, ring_no, seq, x, y), with seq 0, 1, ... along a ring.

    Each vertex looks for the next one by an equi-join, so a ring of any length is
    spread over tasks.
    """
    keys = [*([polygon_id] if isinstance(polygon_id, str) else polygon_id), part, ring]
    size = vertices.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    here = vertices.join(size, keys).select(*keys, ((F.col(seq) + 1) % F.col("_n")).alias("_next"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    there = vertices.select(*keys, F.col(seq).alias("_next"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    out = here.join(there, [*keys, "_next"]).drop("_next")
    return out.withColumnsRenamed({part: "part", ring: "ring_no"})


def geometry_measures(polygons: DataFrame, polygon_id: str = "polygon_id", mercator_radius: float | None = None) -> DataFrame:
    """(polygon_id, minx, miny, maxx, maxy, area, lon, lat) over all parts, holes taken off.

    Outlines count with a positive and holes with a negative area, whichever way they
    turn.  Sums are taken relative to the corner of the geometry, which keeps products
    small; they are partial sums of edges, so a long ring is no long row.  With
    ``mercator_radius`` all measures are on the Web-Mercator plane.  A geometry without
    area has no centroid.
    """
    edges = polygon_edges(polygons, polygon_id)
    if mercator_radius is not None:
        r = mercator_radius
        edges = edges.withColumns({
            **{c: F.radians(c) * r for c in ("x1", "x2")},
            **{c: F.log(F.tan(F.lit(0.7853981633974483) + F.radians(c) / 2.0)) * r for c in ("y1", "y2")}})
    bounds = edges.groupBy(polygon_id).agg(
        F.min("x1").alias("minx"), F.min("y1").alias("miny"), F.max("x1").alias("maxx"), F.max("y1").alias("maxy"))
    local = edges.join(bounds, polygon_id).withColumns({
        **{c: F.col(c) - F.col("minx") for c in ("x1", "x2")}, **{c: F.col(c) - F.col("miny") for c in ("y1", "y2")}})
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = local.groupBy(polygon_id, "part", "ring_no").agg(
        F.sum(cross).alias("_a"), F.sum(cross * (F.col("x1") + F.col("x2"))).alias("_mx"), F.sum(cross * (F.col("y1") + F.col("y2"))).alias("_my"))
    sign = F.signum("_a") * F.when(F.col("ring_no") == 0, 1.0).otherwise(-1.0)
    sums = rings.groupBy(polygon_id).agg(*[F.sum(sign * F.col(c)).alias(c) for c in ("_a", "_mx", "_my")])
    return bounds.join(sums, polygon_id).select(
        polygon_id, "minx", "miny", "maxx", "maxy", (F.col("_a") / 2.0).alias("area"),
        (F.col("minx") + F.try_divide("_mx", 3.0 * F.col("_a"))).alias("lon"), (F.col("miny") + F.try_divide("_my", 3.0 * F.col("_a"))).alias("lat"))


# --- GeoJSON ------------------------------------------------------------------------
def parts_from_geojson(df: DataFrame, column: str = "geojson") -> DataFrame:
    """Add ``parts`` of GeoJSON Polygon or MultiPolygon text; NULL for any other type."""
    ring = "array<array<double>>"
    kind = F.get_json_object(column, "$.type")
    one = F.from_json(column, f"coordinates array<{ring}>")["coordinates"]
    many = F.from_json(column, f"coordinates array<array<{ring}>>")["coordinates"]
    raw = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    vertices = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return df.withColumn("parts", F.transform(raw, lambda rings: F.transform(rings, vertices)))


def geojson_of_parts(parts: Column) -> Column:
    """GeoJSON text of parts: a Polygon where there is one, else a MultiPolygon."""
    coords = F.transform(parts, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    text = lambda kind, c: F.to_json(F.struct(F.lit(kind).alias("type"), c.alias("coordinates")))
    return F.when(F.size(parts) == 1, text("Polygon", coords[0])).otherwise(text("MultiPolygon", coords))


# --- points inside -------------------------------------------------------------------
def _tile_edges(edges: DataFrame, ids: list[str], size: float) -> DataFrame:
    """Every edge once per tile column it touches: (ids, _tx, _lo, _hi, _border, edge), with the tiles it may pass through.

    ``_border`` tells whether the edge crosses the meridian of the column's eastern
    border; below ``_lo`` such an edge is above every point of a tile, above ``_hi`` it
    is below.
    """
    slack = size * 1e-6
    edges = edges.withColumns({
        "_minx": F.least("x1", "x2"), "_maxx": F.greatest("x1", "x2"), "_miny": F.least("y1", "y2"), "_maxy": F.greatest("y1", "y2")})
    tile = lambda c: F.floor(c / F.lit(size)).cast("long")
    cut = edges.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))).withColumn(
        "_tx", F.explode(F.sequence(tile(F.col("_minx") - slack), tile(F.col("_maxx") + slack))))
    xr = (F.col("_tx") + 1) * F.lit(size)
    along = lambda x: F.col("y1") + (F.col("y2") - F.col("y1")) * F.try_divide(
        F.least(F.greatest(x, F.col("_minx")), F.col("_maxx")) - F.col("x1"), F.col("x2") - F.col("x1"))
    a, b = along(F.col("_tx") * F.lit(size) - slack), along(xr + slack)
    low, high = F.coalesce(F.least(a, b), F.col("_miny")), F.coalesce(F.greatest(a, b), F.col("_maxy"))
    return cut.select(
        *ids, "_tx", tile(F.greatest(low, F.col("_miny")) - slack).alias("_lo"), tile(F.least(high, F.col("_maxy")) + slack).alias("_hi"),
        ((F.col("x1") > xr) != (F.col("x2") > xr)).alias("_border"), F.struct(*EDGE).alias("_e"))


def polygon_tiles(edges: DataFrame, ids: Sequence[str], size: float) -> DataFrame:
    """(ids, _tx, _ty, _odd, _edges): the tiles of every polygon that hold edges or lie inside."""
    ids = list(ids)
    cut = _tile_edges(edges, ids, size)
    passed = cut.select(*ids, "_tx", F.explode(F.sequence("_lo", "_hi")).alias("_ty"), F.lit(0).alias("_odd"), "_e")
    # along a column the parity changes at every odd number of border edges
    turns = cut.where("_border").groupBy(*ids, "_tx", "_lo").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1")
    down = W.partitionBy(*ids, "_tx").orderBy(F.col("_lo").desc())
    spans = turns.select(*ids, "_tx", "_lo", F.lead("_lo").over(down).alias("_end"), F.row_number().over(down).alias("_k")).where("_k % 2 = 1")
    inner = spans.select(*ids, "_tx", F.explode(F.sequence(F.col("_end"), F.col("_lo") - 1)).alias("_ty"), F.lit(1).alias("_odd"),
                         F.lit(None).cast(passed.schema["_e"].dataType).alias("_e"))
    return passed.unionByName(inner).groupBy(*ids, "_tx", "_ty").agg(F.sum("_odd").alias("_odd"), F.collect_list("_e").alias("_edges"))


def fitting_tile(edges: DataFrame, ids: Sequence[str], size: float, most: int = TILE_EDGES) -> float:
    """A tile size with which no tile of a polygon holds more than ``most`` edges, as far as cutting tiles helps."""
    least = size * SMALLEST
    while size > least:
        cut = _tile_edges(edges, list(ids), size).select(*ids, "_tx", F.explode(F.sequence("_lo", "_hi")).alias("_ty"))
        top = cut.groupBy(*ids, "_tx", "_ty").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if top <= most:
            break
        size /= 4.0
    return size


def crossings(edges: str, lon: str, lat: str, east: str) -> str:
    """Number of edges that change the parity of a point, as SQL: on its way to the eastern border, or above the border."""
    over = f"((e.y1 > {lat}) <> (e.y2 > {lat}))"
    at = f"greatest(least(try_divide((e.x2 - e.x1) * ({lat} - e.y1), e.y2 - e.y1) + e.x1, greatest(e.x1, e.x2)), least(e.x1, e.x2))"
    above = f"if({over}, ({at} > {east}) <> ((e.x2 > e.x1) = (e.y2 > e.y1)), e.y1 > {lat})"
    way = f"({over} and (({at} > {lon}) <> ({at} > {east})))"
    return f"size(filter({edges}, e -> {way} <> (((e.x1 > {east}) <> (e.x2 > {east})) and {above})))"


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, polygon_id: str = "polygon_id", tile: float = 0.05, lon: str = "lon", lat: str = "lat",
    most: int = TILE_EDGES,
) -> DataFrame:
    """Inner join of points and the polygons they lie in: the columns of ``points`` and ``polygon_id``.

    ``polygons`` as in ``polygon_edges``.  Rows grow with the edges and with the tiles
    inside a polygon; a tile's edges travel together, at most ``most`` of them, else the
    tiles are cut smaller.  Points without coordinates lie nowhere.
    """
    edges = polygon_edges(polygons, polygon_id).select(polygon_id, *[F.col(c).cast("double").alias(c) for c in EDGE])
    size = fitting_tile(edges, [polygon_id], tile, most)
    tiles = polygon_tiles(edges, [polygon_id], size)
    at = lambda c: F.floor(F.col(c).cast("double") / F.lit(size)).cast("long")
    placed = points.withColumns({"_tx": at(lon), "_ty": at(lat)})
    east = f"((_tx + 1) * {size!r}D)"
    odd = F.expr(f"(_odd + {crossings('_edges', f'cast(`{lon}` as double)', f'cast(`{lat}` as double)', east)}) % 2 = 1")
    return placed.join(tiles, ["_tx", "_ty"]).where(odd).select(*points.columns, polygon_id)
