"""Validation reports, plausibility checks and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from heatloom import constants as C
from heatloom.operators.groups import DEFAULT_BY, GroupProfile, ensure_profile, join_stats
from heatloom.operators.ordering import percentiles, unpivot


def validate_bands(
    cells: DataFrame, by: Sequence[str] = DEFAULT_BY, profile: GroupProfile | None = None,
    columns: Sequence[str] = tuple(C.INDICATORS),
) -> DataFrame:
    """Status (ok, warning, fail) and issue per group and band.

    Bands outside the range table are left out.  A failing non-critical band is
    a warning.
    """
    profile = ensure_profile(cells, by, profile)
    bands = [c for c in columns if c in cells.columns and c in C.BAND_RANGES]
    size = F.count(F.lit(1))
    stats = cells.groupBy(*by).agg(size.alias("n_total"), *[
        F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"),
                 F.avg(c).alias("mean")).alias(f"_s_{c}") for c in bands
    ])
    joined = stats.join(percentiles(cells, bands, C.CLIP_PERCENTILES, by, profile), list(by))
    rows = []
    for c in bands:
        s, p = F.col(f"_s_{c}"), F.col(f"{c}_p")
        lo, hi = C.BAND_RANGES[c]
        issue = (
            F.when(s["n"] / F.col("n_total") < C.MIN_VALID_FRACTION, "too few valid pixels")
            .when((s["n"] > 0) & (s["lo"] == 0) & (s["hi"] == 0), "all zero")
            .when((p[1] < lo) | (p[0] > hi), "outside physical range")
        )
        bad = "warning" if c in C.NON_CRITICAL_BANDS else "fail"
        rows.append(F.struct(
            F.lit(c).alias("indicator"), F.when(issue.isNotNull(), bad).otherwise("ok").alias("status"),
            issue.alias("issue"), s["n"].alias("n_valid"), s["lo"].alias("min"), s["hi"].alias("max"), s["mean"].alias("mean"),
        ))
    return joined.select(*by, "n_total", F.inline(F.array(*rows)))


def assert_valid(report: DataFrame) -> None:
    """Raise if a critical band failed; the error counts all failures and names the first 20."""
    failed = report.where(F.col("status") == "fail")
    bad = failed.limit(20).collect()
    if bad:
        n = len(bad) if len(bad) < 20 else failed.count()
        raise ValueError(f"band validation failed ({n}): " + "; ".join(f"{r['indicator']}: {r['issue']}" for r in bad))


def index_plausibility(
    indexed: DataFrame, by: Sequence[str] = DEFAULT_BY, value: str = "hvi", profile: GroupProfile | None = None
) -> DataFrame:
    """Range, skewness, spread, median and coverage checks per group.

    Skewness and median are advisory and do not decide ``passed``.  Skewness is
    taken from centred moments: the mean is joined back first.
    """
    profile = ensure_profile(indexed, by, profile)
    base = indexed.select(*by, value)
    first = base.groupBy(*by).agg(F.avg(value).alias("_mean"))
    d = F.col(value) - F.col("_mean")
    moments = join_stats(base, first, by, profile).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_valid"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(d * d).alias("_m2"), F.avg(d * d * d).alias("_m3"),
    )
    mid = percentiles(base, [value], [0.5], by, profile).select(*by, F.col(f"{value}_p")[0].alias("median"))
    out = moments.join(mid, list(by))
    std = F.sqrt("_m2")
    skew = F.col("_m3") / (std * std * std + 1e-9)
    coverage = F.col("_valid") / F.col("_n")
    checks = {
        "range_ok": (F.col("min") >= -0.01) & (F.col("max") <= 1.01), "skew_ok": skew > 0, "variance_ok": std > 0.05,
        "median_ok": (F.col("median") > 0.10) & (F.col("median") < 0.90), "coverage_ok": coverage > 0.20,
    }
    checks = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    passed = checks["range_ok"] & checks["variance_ok"] & checks["coverage_ok"]
    return out.select(
        *by, "min", "max", skew.alias("skewness"), std.alias("std"), "median", coverage.alias("coverage"),
        *[v.alias(k) for k, v in checks.items()], passed.alias("passed"),
    )


def index_summary(
    indexed: DataFrame, by: Sequence[str] = DEFAULT_BY, columns: Sequence[str] = ("h_s", "e", "s", "ac", "hvi"),
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Mean and 10th and 90th percentile of the indices, with total expected deaths."""
    profile = ensure_profile(indexed, by, profile)
    total = indexed.groupBy(*by).agg(
        F.coalesce(F.sum("ad_baseline"), F.lit(0.0)).alias("total_ad"), *[F.avg(c).alias(f"_m_{c}") for c in columns]
    )
    p = percentiles(indexed, columns, [0.1, 0.9], by, profile)
    rows = F.array(*[
        F.struct(F.lit(c).alias("index_name"), F.col(f"_m_{c}").alias("mean"), F.col(f"{c}_p")[0].alias("p10"),
                 F.col(f"{c}_p")[1].alias("p90")) for c in columns
    ])
    return total.join(p, list(by)).select(*by, "total_ad", F.inline(rows))


def subindex_histogram(
    indexed: DataFrame, by: Sequence[str] = DEFAULT_BY, columns: Sequence[str] = ("h_s", "e", "s", "ac"),
    bins: int = 40, profile: GroupProfile | None = None,
) -> DataFrame:
    """Equal-width histogram per group and index, with bin start and the mean of the index.

    The last bin includes the maximum.  Empty bins have no row.  A constant index
    gets a range of one around its value.
    """
    profile = ensure_profile(indexed, by, profile)
    long = unpivot(indexed.select(*by, *columns), by, columns).withColumnRenamed("indicator", "index_name")
    keys = [*by, "index_name"]
    stats = long.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.avg("value").alias("mean"))
    flat = F.col("_hi") == F.col("_lo")
    stats = stats.select(
        *keys, "mean", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    joined = join_stats(long, stats, keys, profile.scaled(groups=len(columns)))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counted = joined.withColumn("bin", b).groupBy(*keys, "bin", "_lo", "_hi", "mean").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"), "n", "mean")
