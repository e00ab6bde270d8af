"""Writers of results."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from heatloom import constants as C
from heatloom.operators.pareto import FIVE, pareto_table
from heatloom.operators.prescribe import prescription_cells, prescription_summary
from heatloom.operators.rundir import stage

RESULT_BANDS = ("h_s", "e", "s", "ac", "hvi", "hri", "af", "ad_baseline")


def write_result_cells(
    results: DataFrame, path: str, bands: Sequence[str] = RESULT_BANDS, by: Sequence[str] = ("aoi_id",),
    nodata: float = C.NODATA, fmt: str = "parquet",
) -> str:
    """Write result bands partitioned by group; missing values become the fill value.

    The rows of a group are brought together first, so that not every task writes a file of
    every group; adaptive execution splits what is too large for one task.
    """
    keys = [c for c in ("cell_id", "row", "col", "lon", "lat") if c in results.columns]
    filled = results.select(*by, *keys, *[
        F.coalesce(F.nanvl(F.col(b).cast("double"), F.lit(nodata)), F.lit(nodata)).alias(b) for b in bands
    ])
    filled.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).format(fmt).save(path)
    return path


def write_bucketed(df: DataFrame, path: str, buckets: int = 64, by: Sequence[str] = ("aoi_id", "cell_id"), name: str | None = None) -> str:
    """Store a cell table in buckets of its key, each in one sorted file, and return the table's name.

    Tables of equal keys and bucket numbers are joined without a shuffle.  The files lie
    in ``path``; the catalog of the session keeps the name.
    """
    name = name or "t_" + "".join(c if c.isalnum() else "_" for c in os.path.basename(path.rstrip("/")))
    df.repartition(buckets, *by).write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return name


def write_scene_table(pixels: DataFrame, path: str, ts: str = "ts") -> str:
    """Store scene pixels by year and month of the scene, sorted by cloud cover, so that a date window and a cloud limit skip files and row groups."""
    keyed = pixels.withColumns({"scene_year": F.year(ts), "scene_month": F.month(ts)})
    keyed.repartition("scene_year", "scene_month").sortWithinPartitions("scene_year", "scene_month", "cloud_cover").write.mode(
        "overwrite").partitionBy("scene_year", "scene_month").parquet(path)
    return path


def save_outputs(results: DataFrame, folder: str, by: Sequence[str] = ("aoi_id",)) -> dict[str, str]:
    """Write the vulnerability and the risk index as separate tables; both are worked out once."""
    keys = [c for c in ("cell_id", "row", "col", "lon", "lat") if c in results.columns and c not in by]
    both = stage(results.select(*by, *keys, "hvi", "hri"), "outputs")
    return {
        "hvi": write_result_cells(both, f"{folder}/hvi", ["hvi"], by),
        "hri": write_result_cells(both, f"{folder}/hri", ["hri"], by),
    }


def write_prescription(
    prescription: DataFrame, folder: str, fmt: str = "csv", keep: Sequence[str] = ("cell_id", "zone_id", "lon", "lat"),
) -> dict[str, str]:
    """Write the cell table and a summary per intervention.

    The summary is taken from the written cells, so the prescription is computed
    once without holding it in memory.
    """
    out = {"cells": f"{folder}/cells", "summary": f"{folder}/summary"}
    cells = prescription_cells(prescription, keep)
    options = {"header": True} if fmt == "csv" else {}
    cells.write.mode("overwrite").format(fmt).options(**options).save(out["cells"])
    written = prescription.sparkSession.read.format(fmt).options(**options).schema(cells.schema).load(out["cells"])
    prescription_summary(written).write.mode("overwrite").format(fmt).options(**options).save(out["summary"])
    return out


def write_pareto(front: DataFrame, path: str, objectives: Sequence[str] = FIVE, **table) -> str:
    """Write the report of a front as CSV."""
    pareto_table(front, objectives, **table).write.mode("overwrite").csv(path, header=True)
    return path
