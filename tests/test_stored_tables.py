"""Stored layouts: bucketed cell tables, partitioned scenes, lookup files with all columns."""

import json

from pyspark.sql import functions as F

from heatloom.operators import scenes
from heatloom.sources import readers, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_bands_are_joined_without_a_shuffle(spark, tmp_path):
    base = spark.range(5000).selectExpr("cast(id % 7 as int) as aoi_id", "id as cell_id", "cast(id as double) as a")
    parts = [base, base.where("cell_id % 2 = 0").selectExpr("aoi_id", "cell_id", "a * 2 as b"), base.where("cell_id % 3 = 0").selectExpr("aoi_id", "cell_id", "a * 3 as c")]
    names = [writers.write_bucketed(p, str(tmp_path / f"part{i}"), buckets=4) for i, p in enumerate(parts)]
    out = scenes.stack_bucketed([spark.table(n) for n in names])
    text = plan(out)
    assert "Exchange" not in text and text.count("SortMergeJoin") == 2
    want = scenes.stack_bands(*parts)
    assert sorted(map(tuple, out.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    for n in names:
        spark.sql(f"drop table {n}")


def test_scene_windows_prune_months_and_row_groups(spark, tmp_path):
    px = spark.range(4000).selectExpr(
        "timestampadd(DAY, cast(id % 700 as int), timestamp'2020-01-15') as ts", "cast(id * 37 % 101 as double) as cloud_cover", "id as cell_id", "cast(1 as double) as st_b10")
    stored = readers.read_scene_table(spark, writers.write_scene_table(px, str(tmp_path / "scenes")))
    got = scenes.scene_filter(stored, "2020-03-10", "2020-05-01", 15.0)
    text = plan(got)
    assert "PartitionFilters: [isnotnull(scene_year" in text and "PushedFilters: [IsNotNull(cloud_cover)" in text and "LessThan(cloud_cover,15.0)" in text
    want = scenes.scene_filter(px, "2020-03-10", "2020-05-01", 15.0)
    assert sorted(r["cell_id"] for r in got.collect()) == sorted(r["cell_id"] for r in want.collect()) and want.count() > 0
    assert {(r[0], r[1]) for r in got.select(F.year("ts"), F.month("ts")).distinct().collect()} == {(2020, 3), (2020, 4)}


def test_lookup_files_with_all_columns(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "intervention_key,intervention_name,scope,parameter_group,parameter_name,value_min,value_mode,value_max,primary_citation,evidence_level,notes\n"
        'K1,Name,short_run,A,p,0,1,2,"Author, A. (2001). Title, with commas",high,\n')
    r = readers.read_intervention_params(spark, str(tmp_path / "p.csv")).first()
    assert (r["value_max"], r["primary_citation"], r["evidence_level"], r["notes"]) == (2.0, "Author, A. (2001). Title, with commas", "high", None)
    (tmp_path / "old.csv").write_text("intervention_key,intervention_name,scope,parameter_group,parameter_name,value_min,value_mode,value_max\nK1,N,s,A,p,0,1,2\n")
    assert readers.read_intervention_params(spark, str(tmp_path / "old.csv")).first()["primary_citation"] is None
    assert readers.read_intervention_params(spark).where("primary_citation is null and value_mode is not null").count() > 100
    entry = {"name": "Land surface", "sub_index": "hazard", "direction": "positive", "native_resolution_m": 30, "scale_factor": 0.5, "automatable": True, "notes": "n"}
    (tmp_path / "reg.json").write_text(json.dumps({"version": "1", "indicators": {"lst": entry}}))
    got = readers.read_indicator_registry(spark, str(tmp_path / "reg.json")).first()
    assert (got["indicator"], got["name"], got["scale_factor"], got["automatable"], got["citation"]) == ("lst", "Land surface", 0.5, True, None)
