"""Pareto fronts in blocks, and rank correlations with gaps, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatloom.operators import pareto as P, uncertainty as U
from heatloom.operators.groups import GroupProfile


def front_of(x):
    """Positions of the front: each vector against the front of those with smaller sums (ties by their parts)."""
    order = np.lexsort([*x.T[::-1], x.sum(axis=1)])
    kept = np.zeros((0, x.shape[1]))
    out = []
    for i in order:
        lost = ((kept <= x[i]).all(axis=1) & (kept < x[i]).any(axis=1)).any()
        if not lost:
            out.append(int(i))
            kept = np.vstack([kept, x[i]])
    return sorted(out)


def frame(spark, groups):
    pdf = pd.concat([pd.DataFrame({"g": g, "solution_id": np.arange(len(x)), **{f"f{k + 1}": x[:, k] for k in range(x.shape[1])}}) for g, x in groups.items()])
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("block", [16, 300, 100_000])
def test_fronts_of_groups_equal_brute_force(spark, block):
    rng = np.random.default_rng(0)
    simplex = rng.dirichlet([1, 1, 1], 700)  # sums are equal but for rounding: nearly all on the front
    same = np.repeat(rng.integers(0, 3, (40, 3)).astype(float), 5, axis=0)
    huge = np.column_stack([np.ones(30), np.full(30, 1e20), rng.permutation(30) + 1.0])  # sums equal by rounding, one vector wins
    groups = {1: rng.normal(size=(900, 3)), 2: simplex, 3: same, 4: huge, 5: np.zeros((1, 3))}
    df = frame(spark, groups)
    got = P.pareto_front(df, ["f1", "f2", "f3"], by=["g"], block_rows=block).toPandas()
    for g, x in groups.items():
        assert sorted(got[got.g == g].solution_id) == front_of(x), g


def test_large_front_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(95_000, 4)), rng.dirichlet([1] * 4, 5_000) * 4 - 4.0])
    df = frame(spark, {0: x}).repartition(16)
    got = P.pareto_front(df, ["f1", "f2", "f3", "f4"], block_rows=1000).toPandas()
    assert sorted(got.solution_id) == front_of(x)


def test_what_is_left_is_thinned_without_a_shuffle(spark):
    df = frame(spark, {0: np.random.default_rng(2).normal(size=(500, 2))}).drop("g", "solution_id").withColumn("_b", F.lit(0).cast("long"))
    best = df.drop("_b").orderBy(F.col("f1") + F.col("f2")).limit(10)
    plan = P._thinned(df, best, ["f1", "f2"], [])._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]


def spearman(a, b):
    use = np.isfinite(a) & np.isfinite(b)
    if use.sum() <= 5:
        return use.sum(), None
    ra, rb = pd.Series(a[use]).rank(), pd.Series(b[use]).rank()
    return use.sum(), np.corrcoef(ra, rb)[0, 1] if ra.std() > 0 and rb.std() > 0 else None


@pytest.mark.parametrize("profile", [GroupProfile(2, 400), GroupProfile(2, 400, direct_rows=40)])
def test_rank_correlations_with_gaps(spark, profile):
    rng = np.random.default_rng(5)
    cols = ["a", "b", "c", "d", "e"]
    x = rng.normal(size=(700, 5)).round(1)
    x[:, 1] += x[:, 0]
    x[rng.random(700) < 0.3, 1] = np.nan
    x[rng.random(700) < 0.5, 2] = np.nan
    x[:, 4] = 1.0
    x[:300, 3] = np.nan
    pdf = pd.DataFrame(x, columns=cols).assign(aoi_id=np.repeat([1, 2], 350), cell_id=np.arange(700))
    df = spark.createDataFrame(pdf).select("aoi_id", "cell_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    got = {(r["aoi_id"], r["indicator_a"], r["indicator_b"]): (r["n"], r["rho"]) for r in U.spearman_matrix(df, cols, profile=profile).collect()}
    for aoi, g in pdf.groupby("aoi_id"):
        for i, a in enumerate(cols):
            for b in cols[i + 1:]:
                n, rho = spearman(g[a].to_numpy(), g[b].to_numpy())
                if n:
                    assert got[aoi, a, b][0] == n
                    assert got[aoi, a, b][1] == (None if rho is None else pytest.approx(rho, abs=1e-9))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_gaps_add_no_exchange(spark):
    base = spark.range(100).selectExpr("1 as aoi_id", "id as cell_id", *[f"cast(id * {i + 1} % 17 as double) as c{i}" for i in range(6)])
    gappy = base.withColumns({f"c{i}": F.when(F.col("cell_id") % (i + 2) != 0, F.col(f"c{i}")) for i in range(5)})
    cols, profile = [f"c{i}" for i in range(6)], GroupProfile(1, 100)
    assert exchanges(U.spearman_matrix(base, cols, profile=profile)) == exchanges(U.spearman_matrix(gappy, cols, profile=profile))
