"""Input views over the driver tables.

The tables hold no rasters, so cells, scenes and forecasts are derived from the
order tables.  Every view is one SQL text that Spark and DuckDB both run; table
names stand in braces.  Values that later decide ranks or thresholds are rounded,
so that both engines see equal numbers whatever the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "events", "part", "customer", "supplier", "nation")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "cells": ((), """
        select cast(l_partkey as bigint) as cell_id, cast(floor(l_partkey / 50e0) as int) as row,
          cast(l_partkey % 50 as int) as col, cast(floor(l_partkey / 500e0) as int) as aoi_id,
          72.5e0 + 0.001e0 * (l_partkey % 50) as lon, 23e0 + 0.001e0 * floor(l_partkey / 50e0) as lat,
          round(25e0 + avg(l_quantity) / 2e0, 10) as lst, round(0.05e0 + 2e0 * avg(l_discount), 10) as albedo,
          round(100e0 * avg(l_tax), 10) as uhi, round(sum(l_quantity), 10) as population,
          round(avg(case when l_returnflag <> 'N' then 1e0 else 0e0 end), 10) as built_frac,
          round(0.25e0 * avg(case when l_linestatus = 'O' then 1e0 else 0e0 end), 10) as elderly_frac,
          round(0.02e0 * avg(l_linenumber), 10) as child_frac,
          round(avg(case when l_discount > 0.05e0 then 1e0 else 0e0 end), 10) as impervious,
          round(0.5e0 * avg(case when l_tax > 0.04e0 then 1e0 else 0e0 end), 10) as cropland,
          round(140e0 * avg(l_discount * l_tax), 10) as ndvi, round(5e0 * avg(l_tax) - 0.2e0, 10) as ndwi,
          round(max(l_quantity), 10) as tree_cover, round(0.4e0 * min(l_quantity), 10) as canopy_height,
          case when count(*) % 7 = 0 then null else round(avg(l_extendedprice) / 1000e0, 10) end as viirs_dnb,
          cast(sum(l_linenumber) % 9 as int) as dw_label,
          round(avg(l_extendedprice) / 4000e0, 12) as building_height
        from {lineitem} group by l_partkey"""),
    "scene_pixels": ((), """
        select case when l_suppkey % 2 = 0 then 'L8' else 'L9' end as sensor, l_orderkey as scene_id,
          l_shipdate as ts, round(300e0 * l_discount, 6) as cloud_cover,
          cast(floor(l_partkey / 500e0) as int) as aoi_id, l_partkey as cell_id,
          cast(cast(l_quantity as int) % 32 as int) as qa_pixel,
          case when l_linenumber = 7 then null else 44000e0 + 150e0 * l_quantity end as st_b10,
          8000e0 + 100e0 * l_quantity as sr_b2, 8500e0 + 100e0 * l_quantity as sr_b4,
          15000e0 - 100e0 * l_quantity as sr_b5, 14000e0 - 80e0 * l_quantity as sr_b6,
          12000e0 - 60e0 * l_quantity as sr_b7, cast(l_linenumber + 2 as int) as scl,
          round(0.05e0 + l_tax, 6) as b4, round(0.20e0 + l_discount, 6) as b8, round(0.10e0 + l_tax, 6) as b11,
          l_orderkey as orderkey, l_linenumber as linenumber
        from {lineitem}"""),
    "forecast": ((), """
        select cast(user_id % 10 as int) as aoi_id, event_id, ts as valid_time,
          18e0 + least(value, 200e0) / 12.5e0 as t2m_c, cast(30 + (event_id % 60) as double) as rh_pct
        from {events}"""),
    "monthly_climate": ((), """
        select cast(o_custkey % 10 as int) as aoi_id, cast(year(o_orderdate) as int) as year,
          cast(month(o_orderdate) as int) as month, 283.15e0 + o_totalprice / 20000e0 as temperature_2m,
          278.15e0 + o_totalprice / 40000e0 as dewpoint_temperature_2m
        from {orders}"""),
    "age_bands": ((), """
        select l_partkey as cell_id, case l_linenumber when 1 then 0 when 2 then 1 when 3 then 20 when 4 then 40
          when 5 then 60 when 6 then 75 else 90 end as age, l_quantity as people
        from {lineitem}"""),
    "zones": ((), """
        select distinct cast(l_partkey as bigint) as cell_id, cast(floor(l_partkey / 100e0) as int) as zone_id,
          cast(floor(l_partkey / 500e0) as int) as macro_zone_id
        from {lineitem}"""),
    # Plans over all zones of the cells: 50 solutions, as many zones as the table has.
    "decisions": ((), """
        select cast(l_orderkey % 50 as bigint) as solution_id, cast(floor(l_partkey / 100e0) as int) as zone_id,
          cast(l_linenumber as int) as k,
          case l_linenumber when 1 then 'LR1_tree_planting' when 2 then 'LR2_cool_roof' when 3 then 'LR3_bgi'
            when 4 then 'LR4_cool_pavement' when 5 then 'LR5_green_corridor' when 6 then 'LR6_green_roof'
            else 'LR7_cool_morphology' end as intervention_key,
          round(sum(l_quantity) / 1000e0, 6) as qty
        from {lineitem} group by 1, 2, 3, 4"""),
    # One plan per order, so the number of candidate solutions grows with the table.
    "order_plans": ((), """
        select cast(l_orderkey as bigint) as solution_id, cast(floor(l_partkey / 100e0) as int) as zone_id,
          cast(l_linenumber as int) as k,
          case l_linenumber when 1 then 'LR1_tree_planting' when 2 then 'LR2_cool_roof' when 3 then 'LR3_bgi'
            when 4 then 'LR4_cool_pavement' when 5 then 'LR5_green_corridor' when 6 then 'LR6_green_roof'
            else 'LR7_cool_morphology' end as intervention_key,
          round(sum(l_quantity) / 10e0, 6) as qty
        from {lineitem} group by 1, 2, 3, 4"""),
    "emergency_plans": ((), """
        select cast(l_orderkey % 50 as bigint) as solution_id, cast(floor(l_partkey / 100e0) as int) as zone_id,
          case l_linenumber when 1 then 'SR1_cooling_center' when 2 then 'SR2_misting_station'
            when 3 then 'SR3_welfare_check' when 4 then 'SR4_medical_prepositioning'
            else 'SR5_shade_structure' end as intervention_key,
          round(sum(l_quantity) / 100e0, 6) as qty
        from {lineitem} group by 1, 2, 3"""),
    # Five objectives per order; all are to be small.
    "candidates": ((), """
        select cast(l_orderkey as bigint) as solution_id, round(avg(l_quantity) / 50e0, 6) as f1,
          round(sum(l_extendedprice) / 10000e0, 6) as f2, round(1e0 - avg(l_discount) * 10e0, 6) as f3,
          round(-1e0 * sum(l_tax), 6) as f4, round(max(l_quantity) - min(l_quantity), 6) as f5,
          round(sum(l_quantity) - 150e0, 6) as c1, round(count(*) - 6e0, 6) as c2, round(max(l_tax) - 0.075e0, 6) as c3
        from {lineitem} group by 1"""),
    "zone_state": (("cells",), """
        select cast(floor(cell_id / 100e0) as int) as zone_id, round(avg(lst), 10) as lst, round(avg(ndvi), 10) as ndvi,
          round(avg(tree_cover), 10) as tree_cover, round(avg(canopy_height), 10) as canopy_height,
          round(avg(ndwi), 10) as ndwi, round(avg(viirs_dnb), 10) as viirs_dnb, round(avg(built_frac), 10) as e,
          round(avg(impervious), 10) as s, round(sum(population), 6) as population,
          round(avg(elderly_frac), 10) as elderly_frac, round(avg(uhi) / 10e0, 10) as hri,
          round(0.0004e0 * sum(population), 10) as ad_baseline
        from cells group by 1"""),
    "bounds": ((), """
        select cast(floor(l_partkey / 100e0) as int) as zone_id,
          case l_linenumber when 1 then 'LR1_tree_planting' when 2 then 'LR2_cool_roof' when 3 then 'LR3_bgi'
            when 4 then 'LR4_cool_pavement' when 5 then 'LR5_green_corridor' when 6 then 'LR6_green_roof'
            else 'LR7_cool_morphology' end as intervention_key,
          round(avg(l_quantity) / 125e0, 10) as max_qty
        from {lineitem} group by 1, 2"""),
    # One place per customer.
    "sites": ((), """
        select cast(c_custkey as bigint) as aoi_id, -40e0 + (c_custkey * 37 % 1100) / 10e0 as lat,
          -100e0 + (c_custkey * 53 % 2260) / 10e0 as lon, cast(2010 + c_custkey % 18 as int) as year,
          cast(c_custkey * 7919 % 30000 as bigint) as n_cells, cast(c_custkey % 7 as int) as k, c_acctbal as acctbal
        from {customer}"""),
    # Coarse raster: the cells of an area as pixels, rows counted within the area.
    "coarse": (("cells",), """
        select aoi_id, cast(row % 10 as int) as row, col, cell_id, viirs_dnb as ntl, population, lst, building_height as ghs
        from cells"""),
    # Tiles and epochs: several observations of one cell.
    "epochs": ((), """
        select l_partkey as cell_id, cast(1975 + 5 * (l_orderkey % 11) as int) as epoch,
          floor(max(l_extendedprice)) + 0e0 as built_surface, max(l_quantity) as built_height
        from {lineitem} group by 1, 2"""),
    "yearly": ((), """
        select l_partkey as cell_id, case when l_suppkey % 2 = 0 then 'native' else 'extended' end as source,
          cast(2012 + l_orderkey % 14 as int) as year, max(l_extendedprice) as population
        from {lineitem} group by 1, 2, 3"""),
}


def with_clause(*names: str, tables: dict[str, str] | None = None) -> str:
    """``with`` list of views and everything they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for d in VIEWS[name][0]:
            add(d)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    names_of = tables or {t: t for t in TABLES}
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][1].format(**names_of)})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(f"{with_clause(name, tables=tables)} select * from {name}")


def oracle(names: str, body: str) -> str:
    """DuckDB text: the named views, then the query (which may start with more views)."""
    head = with_clause(*names.split())
    body = body.strip()
    return f"{head},\n{body[1:].strip()}" if body.startswith(",") else f"{head}\n{body}"
