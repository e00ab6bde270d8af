"""Registered queries return the whole result, not the part that is cheap."""

import re

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from heatloom import constants as C
from heatloom.operators import index, uncertainty
from test_queries import SF, compare, con  # noqa: F401


def test_open_episodes_are_returned(spark, con):  # noqa: F811
    got = entry.queries()["stream_heat_episodes"](spark, SF)
    assert compare(got.toPandas(), con.execute(entry.oracle_sql()["stream_heat_episodes"]).df()) == ""
    sf = SF.replace("sf0.001", "sf0.01")
    last = spark.read.parquet(f"{sf}/events.parquet").agg(F.max("ts")).first()[0]
    late = entry.queries()["stream_heat_episodes"](spark, sf).where(F.col("end") > F.lit(last) - F.expr("interval 2 days"))
    assert late.count() > 0  # the watermark has not closed these yet


def test_every_draw_has_a_hash_of_its_own(spark, con):  # noqa: F811
    sql = entry.oracle_sql()["perturb_indicators"]
    assert len(set(re.findall(r"md5\(([^)]*)\)", sql))) == len(C.BAND_NOISE)
    got = entry.queries()["perturb_indicators"](spark, SF)
    some = "cell_id % 40 = 0"
    assert compare(got.where(some).select("aoi_id", "cell_id", "sample_id", *[F.round(c, 6).alias(c) for c in C.INDICATORS]).toPandas(),
                   con.execute(f"select * from ({sql}) where {some}").df()) == ""


def test_both_numbers_of_a_draw_have_a_hash_of_their_own(spark, con):  # noqa: F811
    sql = entry.oracle_sql()["perturb_indicators"]
    md5 = lambda end: "md5(('42' || '|' || sample_id::varchar || '|' || aoi_id::varchar || '|' || cell_id::varchar || '|' || '%s'::varchar) || '|' || '%s')" % end
    assert sql.count("md5(") == 2 * len(C.BAND_NOISE) and all(md5((c, x)) in sql for c in C.BAND_NOISE for x in "ab")
    u = [f"(('0x' || substr(md5('42|' || sample_id || '|' || aoi_id || '|' || cell_id || '|lst|{x}'), 1, 8))::bigint + 0.5) / 4294967296" for x in "ab"]
    entry.queries()["perturb_indicators"](spark, SF).where("cell_id % 50 = 0 and sample_id % 100 = 99").select("aoi_id", "cell_id", "sample_id", "lst").createOrReplaceTempView("drawn")
    got = spark.table("drawn").toPandas()  # noqa: F841
    off = con.execute(f"select max(abs(lst - c.mean_lst - 0.4 * sqrt(-2 * ln({u[0]})) * cos({u[1]} * 2 * pi()))), count(*) from got join "
                      "(select l_partkey as cell_id, round(25 + avg(l_quantity) / 2, 10) as mean_lst from lineitem group by 1) c using (cell_id)").fetchone()
    assert off[1] > 0 and off[0] < 1e-6  # queries round to six digits


def test_samples_are_not_shuffled(spark):
    """Areas as many as tasks: rows move before they are copied; fewer areas: the copies still do not move."""
    rng = np.random.default_rng(1)
    few, many = ([(a, i, *rng.random(len(C.INDICATORS)).tolist()) for a in range(areas) for i in range(6)] for areas in (2, 40))
    schema = "aoi_id int, cell_id long, " + ", ".join(f"{c} double" for c in C.INDICATORS)
    for rows in (few, many):
        cells = spark.createDataFrame(rows, schema)
        out = uncertainty.mc_distribution(cells, 9)
        plan = out._jdf.queryExecution().executedPlan().toString()
        lines = [x.strip(" :+-") for x in plan.splitlines()]
        made = max(i for i, x in enumerate(lines) if "sample_id" in x and "Generate explode" in x)
        moved = [x for x in lines[:made] if x.startswith("Exchange")]
        assert len(moved) == (rows is few) and not any("lst" in x for x in moved)
        slow = index.hvi(uncertainty.perturb_indicators(cells, 9, key=("aoi_id", "cell_id")), by=["aoi_id", "sample_id"])
        want = slow.groupBy("aoi_id", "cell_id").agg(F.avg("hvi").alias("mean"), F.count("hvi").alias("n")).orderBy("aoi_id", "cell_id").collect()
        got = out.orderBy("aoi_id", "cell_id").collect()
        assert [(r.aoi_id, r.cell_id, r.n_valid) for r in got] == [(r.aoi_id, r.cell_id, r.n) for r in want]
        np.testing.assert_allclose([r["mean"] for r in got], [r["mean"] for r in want], atol=1e-9)


def test_samples_are_made_in_many_tasks(spark):
    """Few cells are few bytes, yet 500 times as many rows: not all of them in the one task that holds the cells."""
    got = entry.queries()["perturb_indicators"](spark, SF).groupBy(F.spark_partition_id().alias("task")).count().collect()
    cells = sum(r["count"] for r in got)
    assert len(got) > 1 and max(r["count"] for r in got) < cells / 2
