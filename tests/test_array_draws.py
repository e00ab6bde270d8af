"""md5 draws made in numpy equal those of the column expressions."""

import math

import numpy as np
from pyspark.sql import functions as F

from heatloom import constants as C
from heatloom.functions.draws import Draws
from heatloom.functions.random import normal
from heatloom.operators import index, uncertainty


def cells_of(spark, areas=3, each=7):
    rng = np.random.default_rng(3)
    rows = []
    for a in range(areas):
        for i in range(each):
            values = [None if (a + i + j) % 9 == 0 else float(v) for j, v in enumerate(rng.random(len(C.INDICATORS)) * 20)]
            rows.append((a, 10**i + a, None if i == 2 else f"name {i}" * (1 + 9 * (i == 3)), *values))
    return spark.createDataFrame(rows, "aoi_id int, cell_id long, name string, " + ", ".join(f"{c} double" for c in C.INDICATORS))


def test_array_draws_equal_expressions(spark):
    keys = spark.createDataFrame([(0, 1), (12, 345678), (None, 10), (7, None), (None, None)], "a int, c long")
    samples = [0, 9, 10, 123]
    rows = keys.select("*", uncertainty._key_text(["a", "c"]).alias("k"), F.explode(F.array(*map(F.lit, samples))).alias("sample_id"))
    for hashes in (1, 2):
        got = rows.withColumn("z", normal(42, "sample_id", "a", "c", F.lit("lst"), method="md5", hashes=hashes)).collect()
        texts = list(dict.fromkeys(r.k for r in got))
        z = Draws(42, [t.encode() for t in texts], np.array(samples)).normal("lst", hashes)
        for r in got:
            assert math.isclose(r.z, z[texts.index(r.k), samples.index(r.sample_id)], abs_tol=1e-12)


def test_samples_are_drawn_by_arrays(spark):
    """No hash of one text after another in the plan; rows, columns and gaps as by expressions."""
    cells, key, n = cells_of(spark), ("aoi_id", "name", "cell_id"), 13
    for hashes in (1, 2):
        got = uncertainty.perturb_indicators(cells, n, 42, key, method="md5", hashes=hashes)
        assert "md5(" not in got._jdf.queryExecution().optimizedPlan().toString()
        rows = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_id"))
        want = uncertainty._noisy(rows, 42, key, C.INDICATORS, "md5", hashes)
        assert got.dtypes == want.dtypes
        order = ["aoi_id", "cell_id", "sample_id"]
        a, b = (x.toPandas().sort_values(order).reset_index(drop=True) for x in (got, want))
        assert a[[*order, "name"]].equals(b[[*order, "name"]])
        np.testing.assert_allclose(a[C.INDICATORS].to_numpy(float), b[C.INDICATORS].to_numpy(float), atol=1e-9, equal_nan=True)


def test_distribution_by_arrays(spark, monkeypatch):
    """No rows of samples, and the same values; areas that are fewer than tasks, or large, are dealt by sample."""
    n = 9
    for areas, most in ((2, None), (40, None), (40, 20)):
        if most:
            monkeypatch.setattr(uncertainty, "TASK_SAMPLES", most)
        cells = cells_of(spark, areas).drop("name")
        cells = cells.unionByName(cells.where("cell_id < 10").withColumn("ndvi", F.col("ndvi") + 1))  # a cell may have two rows
        cells = cells.unionByName(cells.limit(1).select("aoi_id", F.lit(-1).cast("long").alias("cell_id"), *[F.lit(None).cast("double").alias(c) for c in C.INDICATORS]))
        got = uncertainty.mc_distribution(cells, n, method="md5")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "md5(" not in plan and "Window" not in plan
        rows = uncertainty._noisy(cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_id")), 42, ("aoi_id", "cell_id"), C.INDICATORS, "md5")
        scored = index.hvi(rows, by=["aoi_id", "sample_id"])
        p = F.percentile("hvi", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
        want = scored.groupBy("aoi_id", "cell_id").agg(
            p[0].alias("p10"), p[1].alias("p50"), p[2].alias("p90"), F.avg("hvi").alias("mean"), F.stddev_pop("hvi").alias("std"),
            (p[2] - p[0]).alias("confidence_width"), F.count("hvi").alias("n_valid"))
        assert got.dtypes == want.dtypes
        a, b = (x.orderBy("aoi_id", "cell_id").toPandas() for x in (got, want))
        assert set(b.n_valid) == {0, n, 2 * n}
        np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), atol=1e-9, equal_nan=True)
