"""Costly steps run once."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from heatloom.operators import ordering, zones

SF = "/root/testdata/sf0.001"


def test_gini_takes_the_size_of_plans_from_the_decisions(spark, monkeypatch):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    given, own = [], ordering.ensure_profile
    monkeypatch.setattr(ordering, "ensure_profile", lambda df, by, profile: given.append(profile) or own(df, by, profile))
    assert entry.queries()["f3_gini"](spark, SF).count() > 0
    assert given and all(p is not None for p in given)


def test_zones_are_clustered_once(spark, monkeypatch):
    runs, own = spark.sparkContext.accumulator(0), zones.lloyd

    def counted(points, cents, iterations):
        runs.add(1)
        return own(points, cents, iterations)

    monkeypatch.setattr(zones, "lloyd", counted)
    cells = spark.range(60).select(
        (F.col("id") % 2).cast("int").alias("aoi_id"), F.col("id").alias("cell_id"), (F.col("id") % 6).cast("double").alias("lon"),
        F.floor(F.col("id") / 6).cast("double").alias("lat"))
    out = zones.zones_hierarchical(cells, 3, 2, starts=2).collect()
    # two starts for each of two areas, and for each of their three parts
    assert len(out) == 60 and len({(r["aoi_id"], r["zone_id"]) for r in out}) == 12
    assert runs.value == 2 * 2 + 2 * 2 * 3
