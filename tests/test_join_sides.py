"""Rasters made by exploding look small to the planner; joins must not collect them on the driver."""

import pytest
from pyspark.sql import functions as F

from heatloom.operators import downscale as D, grid
from heatloom.operators.groups import GroupProfile


def pixels(spark):
    meta = spark.createDataFrame(
        [(a, 4, 4, 0.0, 0.0, 1.0, 1.0) for a in range(3)], "aoi_id int, height int, width int, x0 double, y0 double, dx double, dy double")
    return grid.fine_grid(meta, 2.0).select("aoi_id", "row", "col")


def final_plan(df):
    df.collect()  # adaptive execution decides on the way
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_covariate_rasters_are_not_broadcast(spark):
    fine = pixels(spark)
    raster = fine.withColumn("lst", F.col("row") + F.lit(30.0))
    filled, _ = D.prepare_covariates(fine, {"lst": (raster, 1)}, zoom=2.0, mean=())
    plan = final_plan(filled)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert filled.where(F.col("lst") == F.col("row") + 30).count() == 3 * 64


@pytest.mark.parametrize("profile", [GroupProfile(3, 64), GroupProfile(3, 64, broadcast_groups=1)])
def test_pixels_are_never_the_broadcast_side(spark, profile):
    fine = pixels(spark)
    placed = D._anchored(fine, 2.0).select("aoi_id", "row", "col", "_ar", "_ac")
    known = spark.createDataFrame([(a, r, c, 1.0) for a in range(2) for r in range(4) for c in range(4)], "aoi_id int, row int, col int, v double")
    out = D._with_extents(placed, known, ["aoi_id"], 5, profile)
    joins = [x for x in final_plan(out).splitlines() if "Join" in x and "aoi_id" in x]
    # the top join is the one with the pixels
    assert "BuildRight" in joins[0] if profile.broadcastable else "SortMergeJoin" in joins[0]
    got = {(r["aoi_id"], r["_extent"]) for r in out.collect()}
    assert out.count() == 3 * 64 and got == {(0, 3), (1, 3), (2, 0)}
