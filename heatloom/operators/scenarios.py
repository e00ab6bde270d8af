"""Climate scenarios and future deaths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from heatloom import constants as C
from heatloom.functions.heat import attributable_deaths, attributable_fraction
from heatloom.operators.lookups import scenario_cross


def fallback_delta(scenario: Column, year: Column) -> Column:
    """Warming of an emission scenario and target year as (mean, p10, p50, p90)."""
    value = F.lit(C.FALLBACK_DELTA)
    for (name, y), d in C.FALLBACK_DELTAS.items():
        value = F.when((scenario == name) & (year == y), F.lit(d)).otherwise(value)
    below, above = C.DELTA_BAND
    return F.struct(value.alias("delta_mean"), (value - below).alias("delta_p10"), value.alias("delta_p50"),
                    (value + above).alias("delta_p90"))


def scenario_ensemble(deltas: DataFrame, by: Sequence[str] = ("scenario", "target_year")) -> DataFrame:
    """Mean and percentiles of model deltas (one row per model, so groups are small)."""
    p = F.percentile("delta", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return deltas.groupBy(*by).agg(
        F.avg("delta").alias("delta_mean"), p.alias("_p"), F.count_distinct("model").alias("n_models")
    ).select(
        *by, "delta_mean", F.col("_p")[0].alias("delta_p10"), F.col("_p")[1].alias("delta_p50"),
        F.col("_p")[2].alias("delta_p90"), "n_models",
    )


def scenario_table(aois: DataFrame) -> DataFrame:
    """Four scenarios per area, from its d245 and d585; the fixed deltas where they are missing."""
    rows = scenario_cross(aois)
    delta = (
        F.when(F.col("scenario") == "C", F.coalesce("d245", "t_delta"))
        .when(F.col("scenario") == "D", F.coalesce("d585", "t_delta"))
        .otherwise(F.col("t_delta"))
    )
    return rows.withColumn("t_delta", delta)


def scenario_population(cells: DataFrame, scenarios: Sequence[tuple] = tuple(C.SCENARIOS)) -> DataFrame:
    """Population of every cell under every scenario."""
    return scenario_cross(cells, scenarios).withColumn("population_scenario", F.col("population") * F.col("pop_factor"))


def future_deaths(
    cells: DataFrame, beta: Column | float = C.BETA_BY_ZONE["A"], cdr: Column | float = C.CDR_DEFAULT,
    lam: float = C.LAMBDA_HVI, scenarios: Sequence[tuple] = tuple(C.SCENARIOS),
) -> DataFrame:
    """Expected deaths of every cell (lst, mmt, hvi, population) under every scenario."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    rows = scenario_population(cells, scenarios)
    af = attributable_fraction(F.col("lst") + F.col("t_delta"), F.col("mmt"), F.col("hvi"), as_col(beta), lam)
    return rows.withColumn(
        "ad_scenario", attributable_deaths(F.col("population_scenario"), as_col(cdr), af, F.col("event_days"))
    )
