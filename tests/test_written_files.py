"""Files and passes of written results."""

import glob

from pyspark.sql import functions as F

from heatloom.sources import writers


def test_a_group_is_written_once_and_in_few_files(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    cells = spark.range(800).repartition(8).select(
        (F.col("id") % 20).cast("int").alias("aoi_id"), F.col("id").alias("cell_id"), (F.col("id") / 7).alias("hvi"),
        F.when(F.col("id") % 9 > 0, F.col("id") / 3).alias("hri"))
    paths = writers.save_outputs(cells.mapInPandas(count, cells.schema), str(tmp_path / "out"))
    want = {(r["aoi_id"], r["cell_id"]): r for r in cells.collect()}
    for name, path in paths.items():
        got = spark.read.parquet(path).collect()
        assert len(glob.glob(f"{path}/aoi_id=*/*.parquet")) == 20 and len(got) == len(want)
        for r in got:
            w = want[r["aoi_id"], r["cell_id"]][name]
            assert r[name] == (-9999.0 if w is None else w)
    assert seen.value == 800
