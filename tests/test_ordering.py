"""Ordered operators: the bucketed form must equal the direct form and NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatloom.operators import ordering as O
from heatloom.operators.groups import GroupProfile, group_profile

DIRECT = GroupProfile(3, 1_000_000)
# 100 rows per task: groups are cut into many buckets.
CUT = GroupProfile(3, 4_000, direct_rows=100)
SHUFFLED = GroupProfile(3, 4_000, direct_rows=100, broadcast_groups=0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 6_000
    pdf = pd.DataFrame({"aoi_id": rng.choice([1, 2, 3], n, p=[0.66, 0.33, 0.01]), "cell_id": np.arange(n)})
    v = rng.normal(size=n).round(3)
    v[rng.random(n) < 0.4] = 0.5  # one frequent value
    pdf["v"] = v
    pdf["w"] = rng.exponential(size=n) * 1e4
    pdf["amount"] = rng.integers(1, 9, n).astype(float)
    return pdf, spark.createDataFrame(pdf).cache()


def test_profile(rows):
    pdf, df = rows
    p = group_profile(df)
    assert (p.n_groups, p.max_rows) == (3, int(pdf.aoi_id.value_counts().max()))
    assert p.direct and CUT.n_buckets > 10


@pytest.mark.parametrize("profile", [DIRECT, CUT, SHUFFLED])
def test_percentiles(rows, profile):
    pdf, df = rows
    probs = [0.0, 0.02, 0.5, 0.75, 0.98, 1.0]
    got = O.percentiles(df, ["v", "w"], probs, profile=profile).toPandas().set_index("aoi_id")
    for aoi, g in pdf.groupby("aoi_id"):
        for c in ("v", "w"):
            np.testing.assert_allclose(got.loc[aoi, f"{c}_p"], np.percentile(g[c], np.array(probs) * 100), rtol=1e-12)


@pytest.mark.parametrize("profile", [DIRECT, CUT])
def test_percentiles_of_missing_columns(spark, profile):
    df = spark.createDataFrame([(1, 1.0, None), (1, None, None), (2, 3.0, 4.0)], "aoi_id int, a double, b double")
    got = {r["aoi_id"]: r for r in O.percentiles(df, ["a", "b"], [0.5], profile=profile).collect()}
    assert got[1]["a_p"] == [1.0] and got[1]["b_p"] is None and got[2]["b_p"] == [4.0]


@pytest.mark.parametrize("profile", [DIRECT, CUT, SHUFFLED])
@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers(rows, profile, descending):
    pdf, df = rows
    got = O.row_numbers(df, "v", "cell_id", profile=profile, descending=descending).toPandas().set_index("cell_id")["rn"]
    want = pdf.sort_values(["v", "cell_id"], ascending=[not descending, True]).groupby("aoi_id").cumcount() + 1
    want.index = pdf.loc[want.index, "cell_id"]
    assert (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("profile", [DIRECT, CUT])
def test_row_numbers_missing_last(spark, profile):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, 7.0)], "aoi_id int, cell_id int, v double")
    got = {r["cell_id"]: r["rn"] for r in O.row_numbers(df, "v", "cell_id", profile=profile, descending=True).collect()}
    assert got == {3: 1, 2: 2, 1: 3}


@pytest.mark.parametrize("profile", [DIRECT, CUT])
def test_average_ranks(rows, profile):
    pdf, df = rows
    got = O.average_ranks(df, "v", profile=profile).toPandas().set_index("cell_id")["rank"].sort_index()
    want = pdf.groupby("aoi_id")["v"].rank(method="average")
    want.index = pdf["cell_id"]
    np.testing.assert_allclose(got, want.sort_index())


@pytest.mark.parametrize("profile", [DIRECT, CUT])
def test_running_totals(rows, profile):
    pdf, df = rows
    got = O.running_totals(df, "v", "cell_id", "amount", profile=profile, number="pos").toPandas().set_index("cell_id").sort_index()
    s = pdf.sort_values(["v", "cell_id"])
    want = pd.DataFrame({"cell_id": s.cell_id, "run": s.groupby("aoi_id")["amount"].cumsum(), "pos": s.groupby("aoi_id").cumcount() + 1})
    want = want.set_index("cell_id").sort_index()
    np.testing.assert_allclose(got["running"], want["run"])
    assert (got["pos"] == want["pos"]).all()


def test_result_does_not_depend_on_partitioning(spark, rows):
    _, df = rows
    seen = set()
    for n in (1, 4, 50):
        out = O.average_ranks(df.repartition(n), "v", profile=CUT)
        seen.add(out.agg(F.sum(F.col("rank") * F.col("cell_id"))).first()[0])
    assert len(seen) == 1


def _mixed(spark):
    """Missing, NaN and infinite values, one frequent value, string ids with a common prefix."""
    nan, inf = float("nan"), float("inf")
    rows = [(i % 2, f"cell_{i:05d}", [None, nan, inf, -inf, 7.0, 7.0, 7.0, 0.0, -0.0, float(i % 37)][i % 10], float(i % 11)) for i in range(400)]
    return spark.createDataFrame(rows, "aoi_id int, cell_id string, v double, amount double")


def _same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.select(*a.columns).collect()))


def test_bucketed_paths_equal_direct_ones(spark):
    from heatloom.operators import ordering as O
    from heatloom.operators.groups import group_profile

    df = _mixed(spark)
    small, large = group_profile(df, direct_rows=20), group_profile(df)
    assert large.direct and not small.direct
    for descending in (False, True):
        _same(O.row_numbers(df, "v", "cell_id", profile=large, descending=descending),
              O.row_numbers(df, "v", "cell_id", profile=small, descending=descending))
    _same(O.running_totals(df, "v", "cell_id", "amount", profile=large, number="n"),
          O.running_totals(df, "v", "cell_id", "amount", profile=small, number="n"))
    _same(O.average_ranks(df, "v", profile=large), O.average_ranks(df, "v", profile=small))


def test_all_values_equal_or_missing(spark):
    from heatloom.operators import ordering as O
    from heatloom.operators.groups import group_profile

    for v in (None, 3.0):
        df = spark.createDataFrame([(1, f"é{i}", v) for i in range(90)], "aoi_id int, cell_id string, v double")
        small = group_profile(df, direct_rows=10)
        _same(O.row_numbers(df, "v", "cell_id"), O.row_numbers(df, "v", "cell_id", profile=small))
        _same(O.average_ranks(df, "v"), O.average_ranks(df, "v", profile=small))


def test_labels_of_any_size(spark):
    from heatloom.operators.neighbors import majority_filter
    from heatloom.operators.scenes import composite_mode

    field = spark.createDataFrame([(1, r, c, -1) for r in range(5) for c in range(5)], "aoi_id int, row int, col int, code int")
    assert {r["code"] for r in majority_filter(field).collect()} == {-1}
    rows = [(1, 1, x) for x in (-1, -1, 2_000_000, None)] + [(1, 2, x) for x in (2_000_000, 5, 5, 2_000_000, -9)]
    px = spark.createDataFrame(rows, "aoi_id int, cell_id int, label int")
    got = {r["cell_id"]: r["label"] for r in composite_mode(px, "label", ["aoi_id", "cell_id"]).collect()}
    assert got == {1: -1, 2: 5}


def test_forest_keeps_every_pixel(spark):
    from heatloom.operators.downscale import rf_trend

    rows = [(1, i // 10, i % 10, float(i), None if i % 4 == 0 else float(i % 7), float("nan") if i == 9 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "aoi_id int, row int, col int, light double, a double, b double")
    coarse, fine, _ = rf_trend(df, df.drop("light"), "light", ["a", "b"], trees=(5,))
    assert coarse.count() == fine.count() == 60
    assert fine.where("trend is null").count() == coarse.where("pred is null").count() == 16


def test_missing_objective_is_an_error(spark):
    import pytest

    from heatloom.operators.pareto import pareto_front

    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0)], "solution_id int, a double, b double")
    with pytest.raises(Exception, match="objective a is missing"):
        pareto_front(df, ["a", "b"]).collect()


def test_long_hot_spells(spark, tmp_path):
    """A run of 100 days over several files is one run."""
    from heatloom.streaming.forecast import ROCKSDB, run_available, stream_heatwave_alert

    schema = "aoi_id int, valid_time timestamp, heat_index_c double"
    for part in range(4):
        days = [d for d in range(100) if d // 25 == part]
        rows = spark.createDataFrame([(1, d) for d in days], "aoi_id int, d int").selectExpr(
            "aoi_id", "timestampadd(DAY, d, timestamp'2024-03-01 12:00:00') as valid_time", "45.0D as heat_index_c")
        rows.coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
    import os
    import shutil
    (tmp_path / "all").mkdir()
    for part in range(4):
        for f in (tmp_path / f"in{part}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "all" / f"{part}.parquet")
            os.utime(tmp_path / "all" / f"{part}.parquet", (1_700_000_000 + part,) * 2)  # read in this order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    got = run_available(stream_heatwave_alert(stream, 40.0), "alert", ["aoi_id"], state_store=ROCKSDB).collect()
    assert [(r["run_days"], r["alert"]) for r in got] == [(100, True)]
