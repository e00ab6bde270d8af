"""Queries on grids, polygons, zones, neighbourhoods and prescriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom import constants as C
from heatloom.functions import labels
from heatloom.operators import feasibility, grid, lookups, neighbors, polygons as polygons_, prescribe, zones
from heatloom.operators.rundir import run_dir
from heatloom.plans import sqltext as S
from heatloom.plans.catalog_index import RISK, risked
from heatloom.plans.registry import query
from heatloom.plans.views import oracle, view
from heatloom.sources import writers

STEP = C.CELL_SIZE_M / C.M_PER_DEGREE


def cells(spark, sf):
    return view(spark, sf, "cells")


# --- areas ----------------------------------------------------------------------
@query("bbox_filter", oracle("cells", f"""select cell_id, row, col from cells where lon between {72.51 - 5 * STEP!r}::double and {72.53 + 5 * STEP!r}::double
    and lat between {23.005 - 5 * STEP!r}::double and {23.03 + 5 * STEP!r}::double"""))
def _(spark, sf):
    return grid.bbox_filter(cells(spark, sf), 72.51, 23.005, 72.53, 23.03, grow_cells=5).select("cell_id", "row", "col")


# Fixed outline of the test polygons, relative to their centre.
SHAPE = [(0.00537, 0.00011), (0.00123, 0.00157), (-0.00017, 0.00733), (-0.00213, 0.00131), (-0.00641, -0.00327), (0.00311, -0.00471)]
POLYGON_SQL = (
    ", shape(i, x, y) as (values " + ", ".join(f"({i}, {x}::double, {y}::double)" for i, (x, y) in enumerate([*SHAPE, SHAPE[0]])) + "),"
    " centres as (select cast(s_suppkey as bigint) as polygon_id, 72.5::double + 0.0005::double * (s_suppkey % 97) as cx,"
    " 23::double + 0.001::double * (s_suppkey * 7 % 41) as cy from supplier),"
    " edges as (select polygon_id, cx + a.x as x1, cy + a.y as y1, cx + b.x as x2, cy + b.y as y2 from centres, shape a join shape b on b.i = a.i + 1),"
    " hits as (select cell_id, polygon_id from cells, edges where (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1"
    " group by 1, 2 having count(*) % 2 = 1)"
)


def polygons(spark, sf):
    key = F.col("s_suppkey")
    cx, cy = F.lit(72.5) + 0.0005 * (key % 97), F.lit(23.0) + 0.001 * (key * 7 % 41)
    ring = F.array(*[F.struct((cx + x).alias("x"), (cy + y).alias("y")) for x, y in [*SHAPE, SHAPE[0]]])
    return view(spark, sf, "supplier").select(key.cast("bigint").alias("polygon_id"), ring.alias("ring"))


@query("cells_in_polygon", oracle("cells", POLYGON_SQL + " select cell_id, polygon_id from hits"))
def _(spark, sf):
    return grid.cells_in_polygon(cells(spark, sf), polygons(spark, sf), tile_deg=0.005).select("cell_id", "polygon_id")


@query("cells_in_any_polygon", oracle("cells", POLYGON_SQL + " select distinct cell_id from hits"))
def _(spark, sf):
    return grid.cells_in_any_polygon(cells(spark, sf), polygons(spark, sf), tile_deg=0.005).select("cell_id")


# Two parts for each supplier: the outline with a lake in it, and an island of the lake's shape further east.
LAKE, ISLAND = 0.3, 0.0125
PARTS_SQL = POLYGON_SQL.split(" edges as (")[0] + (
    f" rings(ring, part, ring_no, f, dx) as (values (0, 0, 0, 1::double, 0::double), (1, 0, 1, {LAKE}::double, 0::double), (2, 1, 0, {LAKE}::double, {ISLAND}::double)),"
    " edges as (select polygon_id, part, ring_no, cx + dx + f * a.x as x1, cy + f * a.y as y1, cx + dx + f * b.x as x2, cy + f * b.y as y2"
    " from centres, rings, shape a join shape b on b.i = a.i + 1)"
)
PARTS_HITS = PARTS_SQL + (
    ", hits as (select cell_id, polygon_id from cells, edges where (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1"
    " group by 1, 2 having count(*) % 2 = 1)")
RING_SUMS = PARTS_SQL + (
    ", o as (select polygon_id, min(x1) as minx, max(x1) as maxx, min(y1) as miny, max(y1) as maxy from edges group by 1),"
    " l as (select polygon_id, part, ring_no, x1 - minx as x1, x2 - minx as x2, y1 - miny as y1, y2 - miny as y2 from edges join o using (polygon_id)),"
    " r as (select polygon_id, ring_no, sum(x1 * y2 - x2 * y1) as a, sum((x1 * y2 - x2 * y1) * (x1 + x2)) as mx,"
    " sum((x1 * y2 - x2 * y1) * (y1 + y2)) as my from l group by polygon_id, part, ring_no),"
    " g as (select polygon_id, sum(s * a) as a, sum(s * mx) as mx, sum(s * my) as my"
    " from (select *, sign(a) * case when ring_no = 0 then 1 else -1 end as s from r) group by 1)")


def parted(spark, sf):
    """Suppliers' areas as parts: an outline with a hole, and an island."""
    key = F.col("s_suppkey")
    cx, cy = F.lit(72.5) + 0.0005 * (key % 97), F.lit(23.0) + 0.001 * (key * 7 % 41)
    ring = lambda f, dx: F.array(*[F.struct((cx + dx + f * F.lit(x)).alias("x"), (cy + f * F.lit(y)).alias("y")) for x, y in [*SHAPE, SHAPE[0]]])
    parts = F.array(F.array(ring(1.0, 0.0), ring(LAKE, 0.0)), F.array(ring(LAKE, ISLAND)))
    return view(spark, sf, "supplier").select(key.cast("bigint").alias("polygon_id"), parts.alias("parts"))


@query("cells_in_multipolygon", oracle("cells", PARTS_HITS + " select cell_id, polygon_id from hits"))
def _(spark, sf):
    return grid.cells_in_polygon(cells(spark, sf), parted(spark, sf), tile_deg=0.005).select("cell_id", "polygon_id")


@query("multipolygon_measures", oracle("cells", RING_SUMS + """ select polygon_id, round(minx, 6) as minx, round(miny, 6) as miny, round(maxx, 6) as maxx, round(maxy, 6) as maxy,
    round(a / 2 * 1e6, 4) as area, round(minx + mx / (3 * a), 6) as lon, round(miny + my / (3 * a), 6) as lat from g join o using (polygon_id)"""))
def _(spark, sf):
    found = grid.geometry_measures(parted(spark, sf), "polygon_id")
    return found.withColumn("area", F.round(F.col("area") * 1e6, 4))


@query("multipolygon_geojson", oracle("cells", PARTS_SQL + """ select polygon_id, part::int as part, ring_no::int as ring_no, count(*) + 1 as n_points, round(max(x1), 6) as maxx, round(max(y1), 6) as maxy
    from edges group by 1, 2, 3"""))
def _(spark, sf):
    back = polygons_.parts_from_geojson(grid.aoi_geojson(parted(spark, sf)).drop("parts"))
    rings = back.select("polygon_id", F.posexplode("parts").alias("part", "rings")).select("polygon_id", "part", F.posexplode("rings").alias("ring_no", "ring"))
    bounds = grid.ring_bounds(F.col("ring"))
    return rings.select("polygon_id", "part", "ring_no", F.size("ring").cast("bigint").alias("n_points"), bounds["maxx"].alias("maxx"), bounds["maxy"].alias("maxy"))


HAVERSINE = ("2 * 6371008.8::double * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))")


@query("aoi_circle_cells", oracle("cells", f""", c as (select aoi_id, round(avg(lat), 6) as lat0, round(avg(lon), 6) as lon0, 1.23::double as radius_km from cells group by 1)
    select aoi_id, cell_id from cells join c using (aoi_id) where {HAVERSINE} <= radius_km * 1000"""))
def _(spark, sf):
    c = cells(spark, sf)
    circles = c.groupBy("aoi_id").agg(F.round(F.avg("lat"), 6).alias("lat0"), F.round(F.avg("lon"), 6).alias("lon0"), F.lit(1.23).alias("radius_km"))
    return grid.aoi_circle_cells(c, circles).select("aoi_id", "cell_id")


def site_rings(spark, sf):
    s = view(spark, sf, "sites").withColumn("side", F.lit(0.01) + F.col("k") * 0.003)
    x, y, d = F.col("lon"), F.col("lat"), F.col("side")
    # A right-angled quadrilateral with one corner pulled out.
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in
                     [(x, y), (x + d, y), (x + d * 2, y + d), (x, y + d), (x, y)]])
    return s.select("aoi_id", "year", ring.alias("ring"))


RING_SQL = ", q as (select aoi_id, lon as x, lat as y, 0.01::double + k * 0.003::double as d from sites)"


@query("aoi_bounds_centroid", oracle("sites", RING_SQL + """ select aoi_id, round(x, 6) as minx, round(y, 6) as miny, round(x + 2 * d, 6) as maxx, round(y + d, 6) as maxy,
    round(x + d * 7 / 9, 6) as lon, round(y + d * 5 / 9, 6) as lat from q"""))
def _(spark, sf):
    return grid.aoi_bounds_centroid(site_rings(spark, sf)).select("aoi_id", "minx", "miny", "maxx", "maxy", "lon", "lat")


MERC = "6378137::double * ln(tan(pi() / 4 + radians({0}) / 2))"


@query("cell_count_estimate", oracle("sites", RING_SQL + f""", a as (select aoi_id, abs(6378137::double * radians(1.5 * d) * ({MERC.format('y + d')} - {MERC.format('y')})) as area from q)
    select aoi_id, round(area / 1e6, 5) as area_km2, greatest(1, ceil(area / 10000))::bigint as n_cells,
    case when ceil(area / 10000) <= 9 then 'moore' when ceil(area / 10000) <= 500 then 'direct' when ceil(area / 10000) <= 5000 then 'meso' else 'hierarchical' end as mode from a"""))
def _(spark, sf):
    return grid.cell_count_estimate(site_rings(spark, sf)).select("aoi_id", F.round("area_km2", 5).alias("area_km2"), "n_cells", "mode")


@query("aoi_geojson", oracle("cells", """, b as (select aoi_id, min(row) as r0, max(row) as r1, min(col) as c0, max(col) as c1 from cells group by 1)
    select aoi_id, '{"type":"Polygon","coordinates":[[[' || c0 || '.5,' || r0 || '.5],[' || c1 || '.5,' || r0 || '.5],[' || c1 || '.5,' || r1 || '.5],[' || c0 || '.5,' || r1 || '.5],[' || c0 || '.5,' || r0 || '.5]]]}' as geojson,
    5::bigint as n_points, (c1 + 0.5)::double as maxx, (r1 + 0.5)::double as maxy from b"""))
def _(spark, sf):
    b = cells(spark, sf).groupBy("aoi_id").agg(*[f(c).alias(n) for n, f, c in (("r0", F.min, "row"), ("r1", F.max, "row"), ("c0", F.min, "col"), ("c1", F.max, "col"))])
    ring = grid.box_ring(F.col("c0") + F.lit(0.5), F.col("r0") + F.lit(0.5), F.col("c1") + F.lit(0.5), F.col("r1") + F.lit(0.5))
    text = grid.aoi_geojson(b.select("aoi_id", ring.alias("ring")))
    back = grid.ring_from_geojson(text.drop("ring"))
    bounds = grid.ring_bounds(F.col("ring"))
    return back.select("aoi_id", "geojson", F.size("ring").cast("bigint").alias("n_points"), bounds["maxx"].alias("maxx"), bounds["maxy"].alias("maxy"))


GRID_SQL = f""", b as (select aoi_id, min(lon) as minx, max(lon) as maxx, min(lat) as miny, max(lat) as maxy from cells group by 1),
    s as (select *, {STEP!r}::double as dy, 100::double / (111320::double * cos(radians((miny + maxy) / 2))) as dx from b),
    n as (select *, ceil((maxy - (miny + dy / 2)) / dy)::int as nr, ceil((maxx - (minx + dx / 2)) / dx)::int as nc from s),
    r as (select *, unnest(range(nr)) as row from n), g as (select *, unnest(range(nc)) as col from r)"""


@query("cell_grid", oracle("cells", GRID_SQL + """ select aoi_id, (row * nc + col)::bigint as cell_id, row::int as row, col::int as col,
    round(minx + (col + 0.5) * dx, 6) as lon, round(miny + (row + 0.5) * dy, 6) as lat from g"""))
def _(spark, sf):
    b = cells(spark, sf).groupBy("aoi_id").agg(F.min("lon").alias("minx"), F.max("lon").alias("maxx"), F.min("lat").alias("miny"), F.max("lat").alias("maxy"))
    return grid.cell_grid(b)


@query("moore_cells", oracle("sites", S.values(", o", ["i", "r", "c", "type", "weight"], [(i, r, c, t, float(w)) for i, (r, c, t, w) in enumerate(C.MOORE_OFFSETS)]) + f"""
    select aoi_id, i::bigint as cell_id, round(lon + c * 100::double / (111320::double * cos(radians(lat))), 6) as lon, round(lat + r * {STEP!r}::double, 6) as lat, type, weight, i as zone_id from sites, o"""))
def _(spark, sf):
    return grid.moore_cells(view(spark, sf, "sites").select("aoi_id", "lat", "lon"))


@query("direct_cells", oracle("cells", "select aoi_id, cell_id, cell_id::int as zone_id from cells"))
def _(spark, sf):
    return grid.direct_cells(cells(spark, sf)).select("aoi_id", "cell_id", "zone_id")


@query("pixel_center", oracle("cells", "select cell_id, round(72.1::double + (col + 0.5) * 0.005::double, 6) as x, round(23.4::double + (row + 0.5) * (-0.002)::double, 6) as y from cells"))
def _(spark, sf):
    x, y = grid.pixel_center(F.col("row"), F.col("col"), F.lit(72.1), F.lit(23.4), F.lit(0.005), F.lit(-0.002))
    return cells(spark, sf).select("cell_id", x.alias("x"), y.alias("y"))


# --- neighbourhoods ---------------------------------------------------------------
@query("moore_neighbors", oracle("cells", """select a.aoi_id, a.cell_id, b.cell_id as neighbor_id from cells a join cells b on a.aoi_id = b.aoi_id
    and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 and a.cell_id <> b.cell_id"""))
def _(spark, sf):
    return neighbors.moore_neighbors(cells(spark, sf))


def window_sql(half: int, src: str = "cells", code: str = "dw_label") -> str:
    span = f"range(-{half}, {half + 1})"
    return (
        f", b as (select aoi_id, min(row) as r0, max(row) as r1, min(col) as c0, max(col) as c1 from {src} group by 1),"
        f" o as (select r.unnest as dr, c.unnest as dc from unnest({span}) r, unnest({span}) c),"
        f" w as (select t.aoi_id, t.row, t.col, t.{code} as own, dr = 0 and dc = 0 as centre, s.{code} as code from {src} t join b using (aoi_id), o, {src} s"
        f" where s.aoi_id = t.aoi_id and s.row = greatest(least(t.row + dr, r1), r0) and s.col = greatest(least(t.col + dc, c1), c0))"
    )


@query("majority_filter", oracle("cells", window_sql(1) + """, v as (select aoi_id, row, col, code, count(*) as n from w group by 1, 2, 3, 4),
    x as (select *, row_number() over (partition by aoi_id, row, col order by n desc, code) as rn from v) select aoi_id, row, col, code as dw_label from x where rn = 1"""))
def _(spark, sf):
    return neighbors.majority_filter(cells(spark, sf), "dw_label")


@query("majority_filter_5x5", oracle("cells", window_sql(2) + """, v as (select aoi_id, row, col, code, count(*) as n from w group by 1, 2, 3, 4),
    x as (select *, row_number() over (partition by aoi_id, row, col order by n desc, code) as rn from v) select aoi_id, row, col, code as dw_label from x where rn = 1"""))
def _(spark, sf):
    return neighbors.majority_filter(cells(spark, sf), "dw_label", window=5)


STICKY = """, v as (select aoi_id, row, col, own, code, count(*) as n from w where not centre and code >= 0 group by 1, 2, 3, 4, 5),
    x as (select *, max(case when code = own then n else 0 end) over (partition by aoi_id, row, col) as same,
      row_number() over (partition by aoi_id, row, col order by n desc, code) as rn from v),
    sticky as (select aoi_id, row, col, case when same >= 6 then own else code end as code from x where rn = 1)"""


@query("majority_filter_sticky", oracle("cells", ", flags as (select aoi_id, row, col, case when dw_label < 5 then 1 else 2 end as flag from cells)"
       + window_sql(1, "flags", "flag") + STICKY + " select aoi_id, row, col, code as flag from sticky"))
def _(spark, sf):
    c = cells(spark, sf).withColumn("flag", F.when(F.col("dw_label") < 5, 1).otherwise(2))
    return neighbors.majority_filter_sticky(c, "flag")


@query("square_layout", oracle("cells", """, n as (select aoi_id, count(*) as n, ceil(sqrt(count(*)))::bigint as side from cells group by 1),
    r as (select aoi_id, cell_id - aoi_id * 500 as i, dw_label as code, false as is_padding from cells
      union all select aoi_id, unnest(range(n, side * side)), 0, true from n)
    select aoi_id, i, code, is_padding, floor(i / side)::int as row, (i % side)::int as col from r join n using (aoi_id)"""))
def _(spark, sf):
    c = cells(spark, sf).select("aoi_id", (F.col("cell_id") - F.col("aoi_id") * 500).alias("i"), F.col("dw_label").alias("code"))
    return neighbors.square_layout(c, "i")


# --- feasibility ----------------------------------------------------------------------
BASE = "(population >= 1 and dw_label not in (0, 3, 8))"
OPEN = "least(greatest(1 - built_frac, 0), 1)"
RULES = {
    "SR1_cooling_center": f"{BASE} and built_frac >= 0.3", "SR2_misting_station": f"{BASE} and built_frac >= 0.3",
    "SR3_welfare_check": f"{BASE} and elderly_frac > 0.1", "SR4_medical_prepositioning": BASE,
    "SR5_shade_structure": f"{BASE} and canopy_height < 3", "LR1_tree_planting": f"{BASE} and {OPEN} >= 0.1",
    "LR2_cool_roof": f"{BASE} and built_frac >= 0.3 and building_height < 20",
    "LR3_bgi": f"{BASE} and {OPEN} >= 0.2 and building_height < 5",
    "LR4_cool_pavement": f"{BASE} and built_frac >= 0.4", "LR5_green_corridor": BASE,
    "LR6_green_roof": f"{BASE} and built_frac >= 0.3 and building_height < 20",
    "LR7_cool_morphology": f"{BASE} and built_frac >= 0.2 and built_frac <= 0.8 and building_height < 5 and dw_label <> 0",
    "LR8_blue_infrastructure": f"{BASE} and {OPEN} >= 0.2 and building_height < 5",
}


@query("feasibility_masks", oracle("cells", f"select cell_id, {', '.join(f'{v} as {k}' for k, v in RULES.items())} from cells"))
def _(spark, sf):
    return feasibility.feasibility_masks(cells(spark, sf)).select("cell_id", *RULES)


def _register_masks() -> None:
    for key, rule in RULES.items():
        def run(spark, sf, key=key):
            return feasibility.feasibility_masks(cells(spark, sf), [key]).select("aoi_id", "cell_id", F.col(key).alias("feasible"))

        query(f"feasible_{key.split('_')[0].lower()}", oracle("cells", f"select aoi_id, cell_id, {rule} as feasible from cells"))(run)


_register_masks()


@query("prescribable_flag", oracle("cells", """, c as (select cell_id, case when cell_id % 11 = 0 then -9999 else population end as population,
    case when cell_id % 13 = 0 then -9999 else dw_label end as dw_label from cells)
    select cell_id, dw_label not in (0, 3, 8) and population >= 1 and dw_label not in (-9999, -9998, -32768, 65535) and population::bigint not in (-9999, -9998, -32768, 65535)
    and population >= -1 as prescribable from c"""))
def _(spark, sf):
    c = cells(spark, sf).withColumns({
        "population": F.when(F.col("cell_id") % 11 == 0, -9999.0).otherwise(F.col("population")),
        "dw_label": F.when(F.col("cell_id") % 13 == 0, -9999).otherwise(F.col("dw_label")),
    })
    return feasibility.prescribable_flag(c).select("cell_id", "prescribable")


LONG_RULES = " union all ".join(f"select cell_id, '{k}' as intervention_key, '{'short_run' if k[0] == 'S' else 'long_run'}' as scope from cells where {v}" for k, v in RULES.items())


@query("union_interventions", oracle("cells", LONG_RULES))
def _(spark, sf):
    c = cells(spark, sf)
    return feasibility.union_interventions(
        feasibility.feasible_long(c, ["cell_id"], C.SHORT_RUN_KEYS), feasibility.feasible_long(c, ["cell_id"], C.LONG_RUN_KEYS))


@query("intervention_code", oracle("decisions", "select intervention_key, k + 5 as code, count(*) as n from decisions group by 1, 2"))
def _(spark, sf):
    d = view(spark, sf, "decisions")
    return d.groupBy("intervention_key", labels.intervention_code(F.col("intervention_key")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


NAMES = "case dw_label + 6 " + " ".join(f"when {v} then '{k}'" for k, v in C.INTERVENTION_CODES.items()) + " else 'unknown' end"


@query("code_to_name", oracle("cells", f"select cell_id, {NAMES} as name from cells"))
def _(spark, sf):
    return cells(spark, sf).select("cell_id", labels.code_to_name(F.col("dw_label") + 6).alias("name"))


# --- prescriptions ---------------------------------------------------------------------
def plan(spark, sf):
    """Quantities of one plan: a few dozen cells per zone and intervention."""
    d = view(spark, sf, "decisions").groupBy("zone_id", "k", "intervention_key").agg(F.round(F.sum("qty") * 3, 6).alias("qty"))
    return d


def scored_cells(spark, sf):
    c = cells(spark, sf)
    return c.withColumns({"zone_id": F.floor(F.col("cell_id") / 100.0).cast("int"), "hri": F.round(F.col("uhi") / 10, 3)})


TOPK = (
    ", plan as (select zone_id, k, intervention_key, round(sum(qty) * 3, 6) as qty from decisions group by 1, 2, 3),"
    f" f as (select cells.*, floor(cell_id / 100)::int as zone_id, round(uhi / 10, 3) as hri from cells),"
    " opt as (" + " union all ".join(f"select zone_id, cell_id, hri, '{k}' as intervention_key from f where {RULES[k]}" for k in C.LONG_RUN_KEYS[:7]) + "),"
    " rk as (select opt.*, k, qty, row_number() over (partition by opt.zone_id, intervention_key order by hri desc, cell_id) as rn from opt join plan using (zone_id, intervention_key)),"
    " top as (select zone_id, cell_id, max(k) + 5 as code from rk where rn <= floor(qty) group by 1, 2),"
    " presc as (select f.aoi_id, f.row, f.col, f.lon, f.lat, f.zone_id, f.cell_id, f.hri, coalesce(code, 0)::int as code from f left join top using (zone_id, cell_id))"
)
SMOOTH = TOPK + window_sql(1, "presc", "code") + STICKY + ", fin as (select p.* exclude (code), s.code::int as code from presc p join sticky s using (aoi_id, row, col))"


def prescribed(spark, sf):
    return prescribe.prescribe(scored_cells(spark, sf), plan(spark, sf), ["aoi_id"])


@query("priority_topk", oracle("cells decisions", TOPK + " select zone_id, cell_id, hri, code from presc"))
def _(spark, sf):
    return prescribe.priority_topk(scored_cells(spark, sf), plan(spark, sf)).select("zone_id", "cell_id", "hri", "code")


@query("prescribe", oracle("cells decisions", SMOOTH + " select zone_id, cell_id, code from fin"))
def _(spark, sf):
    return prescribed(spark, sf).select("zone_id", "cell_id", "code")


CODE_NAME = NAMES.replace("dw_label + 6", "code")


@query("prescription_cells", oracle("cells decisions", SMOOTH + f" select cell_id, zone_id, round(lon, 6) as lon, round(lat, 6) as lat, code as intervention_code, {CODE_NAME} as intervention_name, hri as hri_value from fin"))
def _(spark, sf):
    return prescribe.prescription_cells(prescribed(spark, sf))


@query("prescription_stats", oracle("cells decisions", SMOOTH + S.values(", codes", ["intervention_name", "c"], list(C.INTERVENTION_CODES.items())) +
       " select aoi_id, intervention_name, count(case when code = c then 1 end) as n_cells from fin, codes group by 1, 2"))
def _(spark, sf):
    return prescribe.prescription_stats(prescribed(spark, sf), ["aoi_id"])


SUMMARY = SMOOTH + f" select {CODE_NAME} as intervention_name, count(*) as n_cells, round(avg(hri), 6) as mean_hri from fin group by 1"


@query("prescription_summary", oracle("cells decisions", SUMMARY))
def _(spark, sf):
    return prescribe.prescription_summary(prescribe.prescription_cells(prescribed(spark, sf)))


@query("prescription_summary_join", oracle("cells decisions", SMOOTH + f" select aoi_id, {CODE_NAME} as intervention_name, count(*) as n_cells, round(avg(hri), 6) as mean_hri from fin group by 1, 2"))
def _(spark, sf):
    kept = prescribe.prescription_cells(prescribed(spark, sf), ["aoi_id", "cell_id"])
    return prescribe.prescription_summary(kept, ["aoi_id"])


@query("write_prescription", oracle("cells decisions", SUMMARY))
def _(spark, sf):
    out = writers.write_prescription(prescribed(spark, sf), run_dir(spark, "prescription"))
    return spark.read.csv(out["summary"], header=True, schema="intervention_name string, n_cells bigint, mean_hri double")


@query("moore_best_intervention", oracle("sites", """select aoi_id, case when k = 0 then 'primary' else 'neighbor' end as type,
    case when n_cells >= aoi_id and n_cells >= year then 'SR1' when aoi_id >= year then 'SR2' else 'SR3' end as intervention,
    greatest(n_cells, aoi_id, year)::double as quantity, case when k = 0 then 1.0 else 0.65 end::double as weight from sites"""))
def _(spark, sf):
    s = view(spark, sf, "sites").select(
        "aoi_id", (F.col("k") == 0).alias("is_primary"),
        F.array(F.col("n_cells").cast("double"), F.col("aoi_id").cast("double"), F.col("year").cast("double")).alias("x"))
    return prescribe.moore_best_intervention(s).select("aoi_id", "type", "intervention", "quantity", "weight")


# --- zones ---------------------------------------------------------------------------------
@query("zones_kmeans")
def _(spark, sf):
    return zones.zones_kmeans(cells(spark, sf))


@query("zones_hierarchical")
def _(spark, sf):
    return zones.zones_hierarchical(cells(spark, sf))


def sized_areas(spark, sf):
    """Areas of different size: a few cells, the usual 500, and two areas in one."""
    area = F.when(F.col("cell_id") % 500 < 6, F.col("aoi_id") + 1000).otherwise(F.floor(F.col("aoi_id") / 2))
    return cells(spark, sf).withColumn("aoi_id", area.cast("int"))


@query("decompose")
def _(spark, sf):
    return zones.decompose(sized_areas(spark, sf))


MOORE_VALUES = S.values("mo", ["i", "r", "c", "type", "weight"], [(i, r, c, t, float(w)) for i, (r, c, t, w) in enumerate(C.MOORE_OFFSETS)])


@query("decompose_small", oracle("cells", f""", {MOORE_VALUES}, ar as (select case when cell_id % 500 < 6 then aoi_id + 1000 else aoi_id // 2 end::int as area, cell_id, lon, lat from cells),
    sz as (select area, count(*) as n, avg(lon) as x, avg(lat) as y from ar group by 1),
    small as (select area as aoi_id, i::bigint as cell_id, 'moore' as mode, i::int as zone_id, round(x + c * 100::double / (111320::double * cos(radians(y))), 6) as lon,
      round(y + r * 100::double / 111320::double, 6) as lat, type, weight from sz, mo where n <= 9),
    direct as (select ar.area as aoi_id, cell_id::bigint as cell_id, 'direct' as mode, (row_number() over (partition by ar.area order by cell_id) - 1)::int as zone_id, round(lon, 6) as lon, round(lat, 6) as lat,
      null::varchar as type, null::double as weight from ar join sz on ar.area = sz.area where n > 9 and n <= 500)
    select * from small union all select * from direct"""))
def _(spark, sf):
    return zones.decompose(sized_areas(spark, sf)).where(F.col("mode").isin("moore", "direct")).drop("macro_zone_id")


ZONED = """select aoi_id, count(*) as n_cells, least(15, count(distinct (lon, lat)))::bigint as n_zones, 0::bigint as misplaced, true as best_start from cells group by 1"""


@query("zones_kmeans_report", oracle("cells", ZONED))
def _(spark, sf):
    c = cells(spark, sf)
    many, one = (zones.zones_report(c, zones.zones_kmeans(c, starts=n)).select("aoi_id", "n_cells", "n_zones", "misplaced", F.col("inertia").alias(f"i{n}")) for n in (10, 1))
    return many.join(one.select("aoi_id", "i1"), "aoi_id").select(
        "aoi_id", "n_cells", "n_zones", "misplaced", (F.col("i10") <= F.col("i1") + 1e-6).alias("best_start"))


@query("zone_summary", oracle("zones cells", """select zone_id, count(*) as cell_count, round(avg(lat), 6) as centroid_lat, round(avg(lon), 6) as centroid_lon
    from zones join cells using (cell_id) group by 1"""))
def _(spark, sf):
    z = view(spark, sf, "zones").join(cells(spark, sf).select("cell_id", "lat", "lon"), "cell_id")
    return zones.zone_summary(z)


@query("zone_risk_summary", oracle("cells zones", f""", {RISK} select zone_id, count(*) as cell_count, round(avg(hvi), 4) as mean_hvi,
    round(avg(hri), 4) as mean_hri, round(sum(ad_baseline), 4) as total_ad_baseline from risk join zones using (cell_id) group by 1"""))
def _(spark, sf):
    z = risked(spark, sf).join(view(spark, sf, "zones"), "cell_id")
    return zones.zone_risk_summary(z).drop("centroid_lat", "centroid_lon")


@query("zone_rollup", oracle("zones cells", """select macro_zone_id, zone_id, count(*) as cell_count, round(sum(population), 6) as total, round(avg(population), 6) as mean
    from zones join cells using (cell_id) group by rollup (macro_zone_id, zone_id)"""))
def _(spark, sf):
    z = view(spark, sf, "zones").join(cells(spark, sf).select("cell_id", "population"), "cell_id")
    return zones.zone_rollup(z, "population")


@query("scenario_cross", oracle("cells", S.values(", sc", ["scenario", "t_delta", "pop_factor", "event_days", "description"], list(C.SCENARIOS)) +
       " select cell_id, scenario, t_delta, pop_factor, event_days from cells, sc"))
def _(spark, sf):
    return lookups.scenario_cross(cells(spark, sf).select("cell_id")).drop("description")
