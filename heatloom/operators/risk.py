"""Heat risk index (HRI), minimum mortality temperature and expected deaths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from heatloom import constants as C
from heatloom.functions.heat import attributable_deaths, attributable_fraction
from heatloom.operators.groups import DEFAULT_BY, GroupProfile, ensure_profile, join_stats
from heatloom.operators.normalize import minmax_norm
from heatloom.operators.ordering import percentiles


def mmt(
    cells: DataFrame,
    column: str = "lst",
    by: Sequence[str] = DEFAULT_BY,
    prob: float = C.MMT_PERCENTILE,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Minimum mortality temperature per group: a percentile of surface temperature."""
    p = percentiles(cells, [column], [prob], by, profile)
    return p.select(*by, F.coalesce(F.col(f"{column}_p")[0], F.lit(C.MMT_FALLBACK_C)).alias("mmt"))


def hri(
    df: DataFrame, by: Sequence[str] = DEFAULT_BY, profile: GroupProfile | None = None
) -> DataFrame:
    """Add hri: hazard times vulnerability, scaled to [0, 1] per group."""
    return minmax_norm(df.withColumn("hri", F.col("h_s") * F.col("hvi")), ["hri"], by, profile)


def hri_pipeline(
    indexed: DataFrame,
    by: Sequence[str] = DEFAULT_BY,
    beta: Column | float | str = C.BETA_BY_ZONE["A"],
    cdr: Column | float | str = C.CDR_DEFAULT,
    event_days: float = C.EVENT_DAYS,
    lam: float = C.LAMBDA_HVI,
    lst: str = "lst",
    population: str = "population",
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Add hri, mmt, af and ad_baseline to a table with h_s, hvi, temperature and population.

    ``beta`` and ``cdr`` may be numbers or columns that ``join_beta`` and
    ``join_cdr`` put there.  Temperature and mmt are both raw degrees.
    """
    profile = ensure_profile(indexed, by, profile)
    out = hri(indexed, by, profile)
    out = join_stats(out, mmt(indexed, lst, by, profile=profile), by, profile)
    as_col = lambda v: F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v))
    out = out.withColumn(
        "af", attributable_fraction(F.col(lst), F.col("mmt"), F.col("hvi"), as_col(beta), lam)
    )
    return out.withColumn(
        "ad_baseline", attributable_deaths(F.col(population), as_col(cdr), F.col("af"), event_days)
    )


def mmt_prior_interval(df: DataFrame, mmt_column: str = "mmt") -> DataFrame:
    """95 % interval of the minimum mortality temperature under its prior."""
    half = 1.96 * C.MMT_SIGMA_C
    m = F.col(mmt_column)
    return df.withColumns({
        "mmt_mean": m, "mmt_sd": F.lit(C.MMT_SIGMA_C),
        "mmt_low": m - half, "mmt_high": m + half, "calibration_status": F.lit("PRIOR_ONLY"),
    })


def lambda_estimate(
    observations: DataFrame | None,
    zones: DataFrame,
    by: Sequence[str] = ("climate_zone",),
    steps: int = 51,
) -> DataFrame:
    """Vulnerability modifier lambda per zone.

    ``observations`` has (by, excess_c, hvi, beta, mortality_rr).  With observed
    relative risks, lambda is the grid value of the allowed range with the
    smallest squared error against exp(beta * excess) * (1 + lambda * hvi).  The
    error is a quadratic in lambda, so three sums per zone suffice for the whole
    grid.  Zones without observations keep the prior.
    """
    lo, hi = C.LAMBDA_RANGE
    prior = zones.select(*by).distinct()
    if observations is None:
        return prior.select(
            *by, F.lit(C.LAMBDA_HVI).alias("lambda"), F.lit(lo).alias("low"), F.lit(hi).alias("high"),
            F.lit("PRIOR_ONLY").alias("calibration_status"),
        )
    base = F.exp(F.col("beta") * F.greatest(F.lit(0.0), F.col("excess_c")))
    gap, slope = F.col("mortality_rr") - base, base * F.col("hvi")
    sums = observations.groupBy(*by).agg(
        F.sum(gap * gap).alias("gg"), F.sum(gap * slope).alias("gs"), F.sum(slope * slope).alias("ss")
    )
    grid = F.array(*[F.lit(lo + (hi - lo) * i / (steps - 1)) for i in range(steps)])
    scored = F.transform(grid, lambda x: F.struct(
        (F.col("gg") - 2.0 * x * F.col("gs") + x * x * F.col("ss")).alias("sse"), x.alias("lambda")
    ))
    best = sums.select(*by, F.array_min(scored)["lambda"].alias("fitted"))
    return prior.join(best, list(by), "left").select(
        *by, F.coalesce("fitted", F.lit(C.LAMBDA_HVI)).alias("lambda"),
        F.lit(lo).alias("low"), F.lit(hi).alias("high"),
        F.when(F.col("fitted").isNull(), "PRIOR_ONLY").otherwise("CALIBRATED").alias("calibration_status"),
    )
