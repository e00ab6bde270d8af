"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (input folder), BENCH_CPUS (local threads),
BENCH_QUERIES (comma-separated names; default: the headline list).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "hvi", "hri_pipeline", "validate_bands", "weights_entropy", "composite_percentile", "lst_with_fallback",
    "majority_filter", "majority_filter_sticky", "prescribe", "cells_in_polygon", "feasibility_masks",
    "long_run_objectives", "pareto_front", "mc_distribution", "weight_sensitivity", "heatwave_runs",
    "future_deaths", "knn_coarse", "kriging_residuals", "stream_daily_max",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.codegen.cache.maxEntries", "1000")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from heatloom.plans.catalog import QUERIES

    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    _drain(QUERIES["hvi"](spark, sf_dir))  # start workers and compile common code
    for n in names:
        for _ in range(2):
            t = time.time()
            rows[n] = _drain(QUERIES[n](spark, sf_dir))
            times[n] = min(times.get(n, 1e9), round(time.time() - t, 3))
    rates = {}
    for n, label in (("hvi", "hvi_cells_per_s"), ("majority_filter", "majority_cells_per_s"),
                     ("kriging_residuals", "kriging_pixels_per_s")):
        if n in times:
            rates[label] = round(rows[n] / times[n])
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))
    spark.stop()


def _drain(df) -> int:
    """Compute every row and column, and count the rows on the way."""
    from pyspark.sql import Observation, functions as F

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return int(seen.get["n"])


if __name__ == "__main__":
    main()
