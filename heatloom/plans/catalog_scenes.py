"""Queries on scene pixels, population bands and source tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom import constants as C
from heatloom.functions import raster as R
from heatloom.functions.basic import clamp
from heatloom.functions.dates import month_window
from heatloom.operators import grid, lookups, scenes
from heatloom.operators.rundir import run_dir
from heatloom.plans.registry import query
from heatloom.plans.sqltext import d, r6, values
from heatloom.plans.views import oracle, view
from heatloom.sources import readers, writers

ST = "(st_b10 * 0.00341802::double + 149::double - 273.15::double)"


def sr(b: str) -> str:
    return f"({b} * 0.0000275::double + (-0.2)::double)"


ALBEDO = "(-0.0018::double + " + " + ".join(f"{sr(b)} * {d(c)}" for b, c in C.ALBEDO_COEFFS.items()) + ")"
START, END = "1994-01-01", "1996-01-01"
STRICT = "cloud_cover < 15 and st_b10 is not null"
PIXEL = ("sensor", "orderkey", "linenumber", "cell_id", "cloud_cover")


def pixels(spark, sf):
    return view(spark, sf, "scene_pixels")


@query("scene_filter", oracle("scene_pixels", f"""select {', '.join(PIXEL)} from scene_pixels
    where {STRICT} and ts >= timestamp '{START}' and ts < timestamp '{END}'"""))
def _(spark, sf):
    return scenes.scene_filter(pixels(spark, sf), START, END).select(*PIXEL)


@query("landsat_cloud_mask", oracle("scene_pixels", f"""select {', '.join(PIXEL)}, (qa_pixel & 26) = 0 as strict
    from scene_pixels where (qa_pixel & 8) = 0"""))
def _(spark, sf):
    return scenes.landsat_cloud_mask(pixels(spark, sf), relaxed=True).select(
        *PIXEL, R.strict_clear(F.col("qa_pixel")).alias("strict"))


@query("s2_scl_mask", oracle("scene_pixels", f"""select {', '.join(PIXEL)}, scl from scene_pixels
    where cloud_cover < 30 and scl not in (3, 8, 9, 10, 11)"""))
def _(spark, sf):
    return scenes.s2_scl_mask(pixels(spark, sf)).select(*PIXEL, "scl")


@query("landsat_scale", oracle("scene_pixels", f"""select orderkey, linenumber, round({ST}, 6) as lst_c,
    {', '.join(f'round({sr(b)}, 6) as {b}' for b in C.ALBEDO_COEFFS)} from scene_pixels"""))
def _(spark, sf):
    return scenes.landsat_scale(pixels(spark, sf)).select("orderkey", "linenumber", "lst_c", *C.ALBEDO_COEFFS)


@query("broadband_albedo", oracle("scene_pixels", f"""select cell_id,
    round(least(greatest(avg({ALBEDO}), 0), 1), 6) as albedo from scene_pixels where {STRICT} and (qa_pixel & 26) = 0 group by 1"""))
def _(spark, sf):
    clear = scenes.landsat_cloud_mask(scenes.scene_filter(pixels(spark, sf)))
    return scenes.broadband_albedo(scenes.landsat_scale(clear))


@query("normalized_difference", oracle("scene_pixels", """select cell_id,
    round(least(greatest(median((b8 - b4) / (b8 + b4)), -1), 1), 6) as ndvi from scene_pixels
    where cloud_cover < 30 and scl not in (3, 8, 9, 10, 11) group by 1"""))
def _(spark, sf):
    return scenes.spectral_index(scenes.s2_scl_mask(pixels(spark, sf)), "b8", "b4", "ndvi")


@query("tree_cover_effective", oracle("scene_pixels", """select orderkey, linenumber,
    case when linenumber * 4 between 1 and least(2018 - 2000, 23) then 0::double else cloud_cover end as tree_cover
    from scene_pixels"""))
def _(spark, sf):
    base = pixels(spark, sf).select("orderkey", "linenumber", F.col("cloud_cover").alias("treecover2000"),
                                    (F.col("linenumber") * 4).alias("lossyear"))
    return scenes.tree_cover_effective(base, 2018).select("orderkey", "linenumber", "tree_cover")


@query("canopy_height", oracle("epochs", """select cell_id, least(greatest(
    arg_max(case when built_height > 20 then built_height * 1.5 end, epoch), 0), 50)::double as canopy_height
    from epochs group by 1"""))
def _(spark, sf):
    h = F.col("built_height")
    tiles = view(spark, sf, "epochs").select(
        "cell_id", F.col("epoch").alias("tile_order"), F.when(h > 20, h * 1.5).alias("height"))
    return scenes.canopy_height(tiles)


@query("nightlight_raw", oracle("cells", """select cell_id, round(least(greatest(coalesce(viirs_dnb * 5, population), 0), 200), 6)::double
    as viirs_dnb_raw from cells"""))
def _(spark, sf):
    base = view(spark, sf, "cells").select(
        "cell_id", (F.col("viirs_dnb") * 5).alias("maximum"), F.col("population").alias("avg_rad"))
    return scenes.nightlight_raw(base).select("cell_id", "viirs_dnb_raw")


@query("built_fraction", oracle("epochs", """select cell_id, epoch,
    round(least(greatest(built_surface / 10000, 0), 1), 6) as built_frac from epochs"""))
def _(spark, sf):
    return scenes.built_fraction(view(spark, sf, "epochs")).select("cell_id", "epoch", "built_frac")


@query("building_height", oracle("epochs", "select cell_id, built_height as building_height from epochs where epoch = 2015"))
def _(spark, sf):
    return scenes.building_height(view(spark, sf, "epochs"), 2015)


@query("population_clamp", oracle("cells", "select cell_id, round(least(greatest(population - 700, 0), 1e9)::double, 6) as population from cells"))
def _(spark, sf):
    cells = view(spark, sf, "cells").withColumn("population", F.col("population") - 700)
    return scenes.population_clamp(cells).select("cell_id", "population")


@query("population_total", oracle("age_bands", "select cell_id, sum(people) as population from age_bands group by 1"))
def _(spark, sf):
    return scenes.population_total(view(spark, sf, "age_bands"))


SUMS = """, sums as (select cell_id, sum(people) as population,
    sum(case when age >= 60 then people else 0 end) as old, sum(case when age in (0, 1) then people else 0 end) as young
    from age_bands group by 1)"""


@query("age_fractions", oracle("age_bands", SUMS + """ select cell_id, population,
    round(least(greatest(old / greatest(population, 1e-6), 0), 0.7), 6)::double as elderly_frac,
    round(least(greatest(young / greatest(population, 1e-6), 0), 0.5), 6)::double as child_frac from sums"""))
def _(spark, sf):
    return scenes.age_fractions(view(spark, sf, "age_bands"))


@query("age_fractions_catalog", oracle("age_bands", SUMS + """ select cell_id, population,
    round(case when population >= 1 then least(greatest(old / (population + 1e-6), 0), 1) else 0 end, 6)::double as elderly_frac,
    round(case when population >= 1 then least(greatest(young / (population + 1e-6), 0), 1) else 0 end, 6)::double as child_frac
    from sums"""))
def _(spark, sf):
    return scenes.age_fractions(view(spark, sf, "age_bands"), catalog=True)


@query("clip_values", oracle("cells", "select cell_id, least(greatest(viirs_dnb, 20), 40)::double as viirs_dnb from cells where viirs_dnb is not null "
       "union all select cell_id, null from cells where viirs_dnb is null"), digits=10)
def _(spark, sf):
    return view(spark, sf, "cells").select("cell_id", clamp(F.col("viirs_dnb"), 20.0, 40.0).alias("viirs_dnb"))


@query("built_mask", oracle("scene_pixels", """select cell_id, round(median(b4 * 6), 6) as impervious,
    median(b4 * 6) > 0.5 as is_built from scene_pixels group by 1"""))
def _(spark, sf):
    med = scenes.composite_median(pixels(spark, sf), {"impervious": F.col("b4") * 6})
    return scenes.built_mask(med)


STACK_SQL = oracle("scene_pixels cells", f"""select aoi_id, cell_id, round(cells.lst, 6) as lst, n_scenes, round(median_ndwi, 6) as median_ndwi,
    mode_scl from cells
    join (select aoi_id, cell_id, count(*) as n_scenes from scene_pixels group by 1, 2) using (aoi_id, cell_id)
    join (select aoi_id, cell_id, median((b8 - b11) / (b8 + b11)) as median_ndwi from scene_pixels where scl < 8 group by 1, 2) using (aoi_id, cell_id)
    join (select aoi_id, cell_id, scl as mode_scl from (select aoi_id, cell_id, scl, row_number() over
      (partition by aoi_id, cell_id order by count(*) desc, scl) as rn from scene_pixels group by 1, 2, 3) where rn = 1) using (aoi_id, cell_id)""")


def stacked_parts(spark, sf):
    by = ["aoi_id", "cell_id"]
    p = pixels(spark, sf)
    ndwi = scenes.composite_median(p.where(F.col("scl") < 8), {"median_ndwi": R.normalized_difference(F.col("b8"), F.col("b11"))}, by)
    mode = scenes.composite_mode(p, "scl", by).withColumnRenamed("scl", "mode_scl")
    return view(spark, sf, "cells").select(*by, "lst"), p.groupBy(*by).agg(F.count(F.lit(1)).alias("n_scenes")), ndwi, mode


@query("stack_bands", STACK_SQL)
def _(spark, sf):
    return scenes.stack_bands(*stacked_parts(spark, sf))


@query("stack_bucketed", STACK_SQL)
def _(spark, sf):
    # Each part is a stored table, bucketed and sorted by cell; joining them needs no shuffle.
    names = [writers.write_bucketed(p, run_dir(spark, f"bands-{i}"), buckets=8) for i, p in enumerate(stacked_parts(spark, sf))]
    return scenes.stack_bucketed([spark.table(n) for n in names])


@query("scene_table", oracle("scene_pixels", f"""select {', '.join(PIXEL)} from scene_pixels
    where {STRICT} and ts >= timestamp '{START}' and ts < timestamp '{END}'"""))
def _(spark, sf):
    folder = writers.write_scene_table(pixels(spark, sf), run_dir(spark, "scenes"))
    return scenes.scene_filter(readers.read_scene_table(spark, folder), START, END).select(*PIXEL)


@query("merge_age_rasters", oracle("cells age_bands", SUMS + """ select aoi_id, cell_id,
    case when lon <= 72.54 then coalesce(case when cell_id % 3 <> 0 then sums.population end, cells.population) end as population,
    round(case when lon <= 72.54 then coalesce(case when cell_id % 3 <> 0 then least(old / greatest(sums.population, 1e-6), 0.7) end,
      cells.elderly_frac) end, 6) as elderly_frac
    from cells left join sums using (cell_id)"""))
def _(spark, sf):
    cells = view(spark, sf, "cells").select("aoi_id", "cell_id", "lon", "population", "elderly_frac")
    ages = scenes.age_fractions(view(spark, sf, "age_bands"))
    # The second source lacks some cells.
    has = F.col("cell_id") % 3 != 0
    ages = ages.select(F.floor(F.col("cell_id") / 500.0).cast("int").alias("aoi_id"), "cell_id",
                       F.when(has, F.col("population")).alias("population"), F.when(has, F.col("elderly_frac")).alias("elderly_frac"))
    return scenes.merge_age_rasters(cells, ages, F.col("lon") <= 72.54).select("aoi_id", "cell_id", "population", "elderly_frac")


@query("union_sensors", oracle("scene_pixels", "select sensor, count(*) as n, sum(cloud_cover) as cloud from scene_pixels group by 1"))
def _(spark, sf):
    p = pixels(spark, sf)
    both = scenes.union_sensors(p.where("sensor = 'L8'"), p.where("sensor = 'L9'"))
    return both.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.sum("cloud_cover").alias("cloud"))


@query("composite_percentile", oracle("scene_pixels", f"""select cell_id, round(quantile_cont({ST}, 0.9), 6) as lst
    from scene_pixels where {STRICT} and (qa_pixel & 26) = 0 group by 1"""))
def _(spark, sf):
    clear = scenes.landsat_cloud_mask(scenes.scene_filter(pixels(spark, sf)))
    return scenes.composite_percentile(scenes.landsat_scale(clear), "lst_c", name="lst")


@query("composite_mean", oracle("scene_pixels", "select cell_id, round(avg(sqrt(b8)), 6) as b8 from scene_pixels group by 1"))
def _(spark, sf):
    return scenes.composite_mean(pixels(spark, sf), F.sqrt("b8"), "b8")


@query("composite_median", oracle("scene_pixels", """select cell_id, round(median(b4), 6) as impervious,
    round(median(b11), 6) as cropland from scene_pixels group by 1"""))
def _(spark, sf):
    return scenes.composite_median(pixels(spark, sf), {"impervious": F.col("b4"), "cropland": F.col("b11")})


@query("composite_mode", oracle("scene_pixels", """select cell_id, scl from (select cell_id, scl,
    row_number() over (partition by cell_id order by count(*) desc, scl) as rn from scene_pixels group by 1, 2) where rn = 1"""))
def _(spark, sf):
    return scenes.composite_mode(pixels(spark, sf), "scl")


@query("lst_with_fallback", oracle("scene_pixels", f""", n as (select cell_id, count(distinct scene_id) as n from scene_pixels where {STRICT} group by 1),
    kept as (select cell_id, coalesce(n, 0) < 12 as relaxed, {ST} as lst from scene_pixels left join n using (cell_id)
      where st_b10 is not null and cloud_cover < 30 and ((coalesce(n, 0) < 12 and (qa_pixel & 8) = 0)
        or (coalesce(n, 0) >= 12 and cloud_cover < 15 and (qa_pixel & 26) = 0)))
    select cell_id, relaxed, round(quantile_cont(lst, 0.9), 6) as lst from kept group by 1, 2"""))
def _(spark, sf):
    return scenes.lst_with_fallback(pixels(spark, sf), group=["cell_id"], min_scenes=12)


@query("uhi_intensity", oracle("cells", """select aoi_id, cell_id, round(least(greatest(lst -
    coalesce(avg(case when dw_label <> 6 then lst end) over (partition by aoi_id), avg(lst) over (partition by aoi_id)), -5), 20), 6)::double as uhi
    from cells"""))
def _(spark, sf):
    cells = view(spark, sf, "cells").select("aoi_id", "cell_id", "lst", "dw_label")
    return scenes.uhi_intensity(cells, F.col("dw_label") != C.BUILT_LABEL).select("aoi_id", "cell_id", "uhi")


@query("scene_count", oracle("scene_pixels", """select sensor, count(distinct scene_id) as n_scenes,
    count(distinct scene_id) >= 100 as sufficient from scene_pixels group by 1"""))
def _(spark, sf):
    return scenes.scene_count(pixels(spark, sf), minimum=100)


@query("epoch_asof", oracle("epochs", """select cell_id, coalesce(max(case when epoch <= 1998 then epoch end), min(epoch)) as epoch_used,
    coalesce(arg_max(case when epoch <= 1998 then built_surface end, case when epoch <= 1998 then epoch end), arg_min(built_surface, epoch)) as built_surface
    from epochs group by 1"""))
def _(spark, sf):
    return lookups.epoch_asof(view(spark, sf, "epochs"), 1998)


@query("year_proxy_asof", oracle("yearly", """, ranked as (select *, row_number() over (partition by cell_id order by
    case when source = 'extended' and year = 2023 then 30000 when source = 'native' and year = 2020 then 20000 else year end desc,
    (source = 'native') desc) as rn from yearly)
    select cell_id, year as year_used, source as source_used, population from ranked where rn = 1"""))
def _(spark, sf):
    return lookups.year_proxy_asof(view(spark, sf, "yearly"), 2023)


@query("month_window", oracle("sites", """, w as (select aoi_id, year, 1 + (aoi_id * 5 % 11)::int as m1, 2 + (aoi_id * 5 % 11)::int as m2 from sites)
    select aoi_id, (make_date(year, m1, 1) - interval 1 month)::date as start_date,
    (make_date(year, m2, 1) + interval 2 month)::date as end_date from w"""))
def _(spark, sf):
    s = view(spark, sf, "sites")
    m1 = (F.lit(1) + F.col("aoi_id") * 5 % 11).cast("int")
    start, end = month_window(F.col("year"), F.array(m1, m1 + 1))
    return s.select("aoi_id", start.alias("start_date"), end.alias("end_date"))


@query("month_window_exact", oracle("sites", """, w as (select aoi_id, year, 1 + (aoi_id * 5 % 11)::int as m1, 2 + (aoi_id * 5 % 11)::int as m2 from sites)
    select aoi_id, make_date(year, m1, 1) as start_date, (make_date(year, m2, 1) + interval 1 month)::date as end_date from w"""))
def _(spark, sf):
    s = view(spark, sf, "sites")
    m1 = (F.lit(1) + F.col("aoi_id") * 5 % 11).cast("int")
    start, end = month_window(F.col("year"), F.array(m1, m1 + 1), margin=0)
    return s.select("aoi_id", start.alias("start_date"), end.alias("end_date"))


# --- lookup tables -------------------------------------------------------------
def _rows(name: str, schema) -> list[tuple]:
    cast = {"double": float, "int": int, "string": str}
    with open(f"{readers.DATA}/{name}", encoding="utf-8") as f:
        lines = [ln.rstrip("\n").split(",") for ln in f if ln.strip() and not ln.startswith("#")][1:]
    kinds = [cast[x.dataType.simpleString()] for x in schema.fields]
    return [tuple(k(v) for k, v in zip(kinds, row)) for row in lines]


from heatloom import schemas  # noqa: E402

CDR_VALUES = values("cdr", schemas.CDR.names, _rows("cdr.csv", schemas.CDR))
BETA_VALUES = values("beta", schemas.BETA.names, _rows("beta.csv", schemas.BETA))
PARAM_VALUES = values("params", schemas.INTERVENTIONS.names, _rows("interventions.csv", schemas.INTERVENTIONS))
GRID_COLUMNS = ["grid_id", "lat_center", "lon_center", "d245", "d245_p10", "d245_p90", "d585", "d585_p10", "d585_p90"]
GRID_VALUES = values("grid", GRID_COLUMNS, [(i, *r) for i, r in enumerate(_rows("cmip6_delta.csv", schemas.CMIP6_DELTA))])
ISO3 = "case " + " ".join(
    f"when lat between {a} and {b} and lon between {c} and {e} then '{iso}'" for a, b, c, e, iso in C.ISO3_BOXES
) + " else 'UNKNOWN' end"
ZONE = ("case when abs(lat) < 25 then 'A' when abs(lat) < 35 then 'B' when abs(lat) < 55 then 'C' "
        "when abs(lat) < 70 then 'D' else 'E' end")


def sites(spark, sf):
    return lookups.iso3_from_centroid(view(spark, sf, "sites"))


@query("iso3_from_centroid", oracle("sites", f"select aoi_id, {ISO3} as iso3 from sites"))
def _(spark, sf):
    return sites(spark, sf).select("aoi_id", "iso3")


@query("koppen_zone", oracle("sites", f"select aoi_id, {ZONE} as climate_zone from sites"))
def _(spark, sf):
    from heatloom.functions.labels import koppen_zone

    return view(spark, sf, "sites").select("aoi_id", koppen_zone(F.col("lat")).alias("climate_zone"))


@query("size_mode", oracle("sites", """select aoi_id, case when n_cells <= 9 then 'moore' when n_cells <= 500 then 'direct'
    when n_cells <= 5000 then 'meso' else 'hierarchical' end as mode from sites"""))
def _(spark, sf):
    from heatloom.functions.labels import size_mode

    return view(spark, sf, "sites").select("aoi_id", size_mode(F.col("n_cells")).alias("mode"))


@query("join_beta", oracle("sites", f", {BETA_VALUES} select aoi_id, climate_zone, beta_per_degC as beta from (select *, {ZONE} as climate_zone from sites) join beta using (climate_zone)"))
def _(spark, sf):
    from heatloom.functions.labels import koppen_zone

    s = view(spark, sf, "sites").withColumn("climate_zone", koppen_zone(F.col("lat")))
    return lookups.join_beta(s, readers.read_beta_table(spark)).select("aoi_id", "climate_zone", "beta")


@query("join_cdr", oracle("sites", f""", {CDR_VALUES} select aoi_id, iso3, coalesce(cdr_per_person_per_year, 0.0074::double) as cdr
    from (select *, {ISO3} as iso3 from sites) left join cdr on country_iso3 = iso3"""))
def _(spark, sf):
    return lookups.join_cdr(sites(spark, sf), readers.read_cdr_table(spark)).select("aoi_id", "iso3", "cdr")


@query("read_cdr_table", oracle("sites", f""", {CDR_VALUES} select country_iso3, country_name, region, count(aoi_id) as n_sites,
    max(cdr_per_person_per_year) as cdr from cdr left join (select *, {ISO3} as iso3 from sites) on country_iso3 = iso3 group by 1, 2, 3"""))
def _(spark, sf):
    cdr = readers.read_cdr_table(spark)
    counts = sites(spark, sf).groupBy("iso3").agg(F.count(F.lit(1)).alias("n_sites"))
    return cdr.join(counts, F.col("country_iso3") == F.col("iso3"), "left").select(
        "country_iso3", "country_name", "region", F.coalesce("n_sites", F.lit(0)).alias("n_sites"),
        F.col("cdr_per_person_per_year").alias("cdr"))


@query("read_beta_table", oracle("sites", f""", {BETA_VALUES} select climate_zone, koppen_description, beta_per_degC as beta, count(aoi_id) as n_sites
    from beta left join (select *, {ZONE} as z from sites) on z = climate_zone group by 1, 2, 3"""))
def _(spark, sf):
    from heatloom.functions.labels import koppen_zone

    counts = view(spark, sf, "sites").groupBy(koppen_zone(F.col("lat")).alias("climate_zone")).agg(F.count(F.lit(1)).alias("n_sites"))
    return readers.read_beta_table(spark).join(counts, "climate_zone", "left").select(
        "climate_zone", "koppen_description", F.col("beta_per_degC").alias("beta"), F.coalesce("n_sites", F.lit(0)).alias("n_sites"))


NEAREST = f""", {GRID_VALUES}, ranked as (select sites.*, grid.*, row_number() over (partition by aoi_id order by
    sqrt((lat_center - lat) * (lat_center - lat) + (lon_center - lon) * (lon_center - lon)), grid_id) as rn,
    sqrt((lat_center - lat) * (lat_center - lat) + (lon_center - lon) * (lon_center - lon)) as distance from sites, grid),
    nearest as (select * from ranked where rn = 1)"""


@query("nearest_delta", oracle("sites", NEAREST + " select aoi_id, grid_id, round(distance, 6) as distance, d245, d585 from nearest"))
def _(spark, sf):
    out = lookups.nearest_delta(view(spark, sf, "sites"), readers.read_cmip6_delta_grid(spark))
    return out.select("aoi_id", "grid_id", "distance", "d245", "d585")


@query("read_cmip6_delta_grid", oracle("sites", NEAREST + """ select grid.grid_id, any_value(grid.lat_center) as lat_center,
    any_value(grid.lon_center) as lon_center, any_value(grid.d245_p10) as d245_p10, any_value(grid.d585_p90) as d585_p90, count(nearest.aoi_id) as n_sites
    from grid left join nearest using (grid_id) group by 1"""))
def _(spark, sf):
    g = readers.read_cmip6_delta_grid(spark)
    counts = lookups.nearest_delta(view(spark, sf, "sites"), g).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_sites"))
    return g.join(counts, "grid_id", "left").select(
        "grid_id", "lat_center", "lon_center", "d245_p10", "d585_p90", F.coalesce("n_sites", F.lit(0)).alias("n_sites"))


@query("read_intervention_params", oracle("decisions", f""", {PARAM_VALUES}, used as (select intervention_key, sum(qty) as qty from decisions group by 1)
    select intervention_key, scope, count(*) as n_parameters,
    max(case when parameter_name = 'cost_per_unit_usd' then value_mode end) as cost_mode,
    min(case when parameter_name = 'delta_LST_per_unit' then value_max end) as d_lst_max, round(coalesce(max(qty), 0), 6) as qty
    from params left join used using (intervention_key) group by 1, 2"""))
def _(spark, sf):
    lib = readers.intervention_library(readers.read_intervention_params(spark))
    used = view(spark, sf, "decisions").groupBy("intervention_key").agg(F.sum("qty").alias("qty"))
    triple = lambda name: F.try_element_at("parameters", F.lit(name))
    return lib.join(used, "intervention_key", "left").select(
        "intervention_key", "scope", F.size("parameters").cast("bigint").alias("n_parameters"),
        triple("cost_per_unit_usd")["value_mode"].alias("cost_mode"), triple("delta_LST_per_unit")["value_max"].alias("d_lst_max"),
        F.coalesce("qty", F.lit(0.0)).alias("qty"))


def _registry_values() -> str:
    import json

    with open(f"{readers.DATA}/registry.json", encoding="utf-8") as f:
        entries = json.load(f)["indicators"]
    names = list(next(iter(entries.values())))
    return values("reg", ["indicator", *names], [(k, *[v[n] for n in names]) for k, v in entries.items()])


VALID = " union all ".join(f"select '{c}' as indicator, count({c}) as n_valid from cells" for c in C.INDICATORS)


@query("read_indicator_registry", oracle("cells", f""", {_registry_values()} select indicator, sub_index, direction, native_resolution_m,
    temporal_tier, composite_method, n_valid from reg join ({VALID}) using (indicator)"""))
def _(spark, sf):
    from heatloom.operators.ordering import unpivot

    counts = unpivot(view(spark, sf, "cells"), [], C.INDICATORS).groupBy("indicator").agg(F.count(F.lit(1)).alias("n_valid"))
    return readers.read_indicator_registry(spark).join(counts, "indicator").select(
        "indicator", "sub_index", "direction", "native_resolution_m", "temporal_tier", "composite_method", "n_valid")


@query("registry_flatten", oracle("cells", f""", {_registry_values()} select indicator, sub_index, temporal_range_start, output_resolution_m, n_valid
    from reg join ({VALID}) using (indicator)"""))
def _(spark, sf):
    # The registry text is read back from a folder, as a user's own registry would be.
    from heatloom.operators.ordering import unpivot

    folder = run_dir(spark, "registry")
    with open(f"{readers.DATA}/registry.json", encoding="utf-8") as f:
        spark.createDataFrame([(" ".join(f.read().split()),)], "value string").coalesce(1).write.text(folder)
    counts = unpivot(view(spark, sf, "cells"), [], C.INDICATORS).groupBy("indicator").agg(F.count(F.lit(1)).alias("n_valid"))
    return readers.read_indicator_registry(spark, folder).join(counts, "indicator").select(
        "indicator", "sub_index", "temporal_range_start", "output_resolution_m", "n_valid")


# --- cell tables ----------------------------------------------------------------
@query("read_indicator_cells", oracle("cells", f"""select aoi_id, cell_id, row, col, round(lon, 10) as lon, round(lat, 10) as lat,
    {', '.join(C.INDICATORS)} from cells"""), digits=10)
def _(spark, sf):
    folder = run_dir(spark, "cells")
    cells = view(spark, sf, "cells")
    keys = ["aoi_id", "cell_id", "row", "col", "lon", "lat"]
    filled = cells.select(*keys, *[F.coalesce(F.col(c), F.lit(C.NODATA)).alias(c) for c in C.INDICATORS])
    filled.write.parquet(folder)
    return readers.read_indicator_cells(spark, folder, validate=True)


@query("write_result_cells", oracle("cells", """select aoi_id, cell_id, lst, coalesce(viirs_dnb, -9999::double) as viirs_dnb from cells"""), digits=10)
def _(spark, sf):
    folder = run_dir(spark, "results")
    writers.write_result_cells(view(spark, sf, "cells").select("aoi_id", "cell_id", "lst", "viirs_dnb"), folder, ["lst", "viirs_dnb"])
    return spark.read.parquet(folder).select(F.col("aoi_id").cast("int").alias("aoi_id"), "cell_id", "lst", "viirs_dnb")


@query("aoi_validate", oracle("sites", """, a as (select aoi_id, year, n_cells % 5 = 0 as flat from sites)
    select aoi_id, case when flat or year > 2025 or year < 2016 then 'error' else 'warning' end as status,
    case when flat then 'zero area' when year > 2025 or year < 2016 then 'year out of range' else 'many cells' end as reason from a"""))
def _(spark, sf):
    s = view(spark, sf, "sites")
    side = F.when(F.col("n_cells") % 5 == 0, 0.0).otherwise(0.2)
    ring = grid.box_ring(F.col("lon"), F.col("lat"), F.col("lon") + side, F.col("lat") + side)
    return grid.aoi_validate(s.select("aoi_id", "year", ring.alias("ring")), 2025).select("aoi_id", "status", "reason")
