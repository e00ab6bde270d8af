"""Narrowed order statistics equal the sorting aggregate, whatever the values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatloom.operators import index, normalize, ordering, quantiles as Q, summaries
from heatloom.operators.groups import GroupProfile
from heatloom.plans.views import view

PROBS = [0.0, 0.02, 0.31, 0.5, 0.98, 1.0]
NAN, INF = float("nan"), float("inf")


def groups(seed=0):
    rng = np.random.default_rng(seed)
    tied = rng.normal(size=3000).round(1)
    tied[rng.random(3000) < 0.7] = 0.25
    two = np.where(rng.random(2500) < 0.0004, 2.0, 1.0)  # the rank lies at the end of a run of equal values
    nan = rng.normal(size=2000)
    nan[rng.random(2000) < 0.3] = NAN
    return {"skew": rng.exponential(size=4000) ** 4, "tied": tied, "two": two, "equal": np.full(2000, 7.5), "nan": nan, "all_nan": np.full(20, NAN),
            "inf": np.concatenate([rng.normal(size=1500), [INF] * 400, [-INF] * 200]), "one": np.array([3.0]), "pair": np.array([1.0, 2.0]),
            "steps": np.repeat(np.arange(40.0), rng.integers(1, 200, 40)), "huge": rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000)}


@pytest.mark.parametrize("grid, accuracy, sorted_values", [(1000, 10_000, 5_000), (1000, 10_000, 5), (16, 40, 3)])
@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_equal_to_sorting(spark, monkeypatch, grid, accuracy, sorted_values, broadcast):
    monkeypatch.setattr(Q, "GRID", grid)
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    if broadcast == 0 and grid == 1000:
        pytest.skip("one sketch size is enough for joins")
    rows = [(g, float(v)) for g, values in groups().items() for v in values] + [("tied", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5).cache()
    got = {r["g"]: r["p"] for r in Q.ranked_values(df, ["g"], PROBS, GroupProfile(12, 4000, broadcast_groups=broadcast), sorted_values).collect()}
    want = df.where("value is not null").groupBy("g").agg(F.percentile("value", F.array(*[F.lit(p) for p in PROBS])).alias("p")).collect()
    assert set(got) == {r["g"] for r in want}
    for r in want:
        a, b = np.array(got[r["g"]]), np.array(r["p"])
        if r["g"] == "inf":  # between two infinities the sorting aggregate gives NaN, and so may we
            a, b = a[np.isfinite(b)], b[np.isfinite(b)]
        np.testing.assert_allclose(a, b, rtol=1e-12, err_msg=r["g"])
    df.unpersist()


def test_indices_do_not_depend_on_the_path(spark, monkeypatch):
    cells = view(spark, "/root/testdata/sf0.001", "cells").cache()
    results = []
    for limit in (1_000_000, 10):
        monkeypatch.setattr(ordering, "BUFFER_VALUES", limit)
        monkeypatch.setattr(Q, "SORTED_VALUES", 30)
        out = [normalize.robust_normalize(cells).toPandas().sort_values("cell_id"), index.hvi(cells).toPandas().sort_values("cell_id"),
               summaries.validate_bands(cells).toPandas().sort_values(["aoi_id", "indicator"])]
        results.append([o.reset_index(drop=True) for o in out])
    for a, b in zip(*results):
        pd.testing.assert_frame_equal(a, b, rtol=1e-9, check_dtype=False)
    cells.unpersist()
