"""Heatwave detection on forecast series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from heatloom import constants as C
from heatloom.functions.heat import heat_index
from heatloom.operators.groups import DEFAULT_BY


def with_heat_index(forecast: DataFrame) -> DataFrame:
    return forecast.withColumn("heat_index_c", heat_index(F.col("t2m_c"), F.col("rh_pct")))


def daily_max(forecast: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """Highest heat index per day."""
    return forecast.groupBy(*by, F.to_date("valid_time").alias("day")).agg(
        F.max("heat_index_c").alias("max_hi")
    )


def heatwave_runs(
    daily: DataFrame,
    mmt: Column | float,
    above: float = C.HEATWAVE_EXCESS_C,
    min_days: int = C.HEATWAVE_DAYS,
    by: Sequence[str] = DEFAULT_BY,
    calendar: bool = True,
) -> DataFrame:
    """Longest run of hot days per group, the earliest on ties.

    With ``calendar`` a missing day ends a run; otherwise runs follow the rows of
    the daily table.  Windows see one row per day, so their size is bounded by
    the calendar.
    """
    limit = (mmt if isinstance(mmt, Column) else F.lit(float(mmt))) + above
    d = daily.withColumn("_hot", F.col("max_hi") > limit).withColumn("_excess", F.col("max_hi") - limit)
    by_day = W.partitionBy(*by).orderBy("day")
    number = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date")) if calendar else F.row_number().over(by_day)
    d = d.withColumn("_no", number)
    hot_no = F.row_number().over(W.partitionBy(*by, "_hot").orderBy("day"))
    runs = (
        d.withColumn("_run", F.when(F.col("_hot"), F.col("_no") - hot_no))
        .groupBy(*by, "_run")
        .agg(
            F.min("day").alias("start"), F.max("day").alias("end"),
            F.when(F.col("_run").isNotNull(), F.count(F.lit(1))).otherwise(0).alias("days"),
            F.max("max_hi").alias("max_hi"),
            F.sum(F.when(F.col("_hot"), F.col("_excess"))).alias("excess"),
            F.sum(F.col("_hot").cast("int")).alias("hot"),
        )
    )
    # Longest first, then earliest start.
    order = F.struct((-F.col("days")).alias("d"), F.col("start").alias("s"))
    best = runs.groupBy(*by).agg(
        F.min_by(F.struct("start", "end", "days"), order).alias("b"),
        F.max("max_hi").alias("max_hi"),
        (F.sum("excess") / F.sum("hot")).alias("mean_excess"),
    )
    found = F.col("b.days") >= min_days
    return best.select(
        *by, found.alias("heatwave_detected"),
        F.when(found, F.col("b.start")).alias("start_date"),
        F.when(found, F.col("b.end")).alias("end_date"),
        F.when(found, F.col("b.days")).otherwise(0).cast("int").alias("event_days"),
        "max_hi",
        F.when(found, F.col("mean_excess")).otherwise(0.0).alias("mean_hi_excess"),
    )


def hri_update_scalar(
    forecast: DataFrame, context: DataFrame, by: Sequence[str] = DEFAULT_BY
) -> DataFrame:
    """Mean forecast heat index over the climatological one; 1 without a usable climatology."""
    mean = forecast.groupBy(*by).agg(F.avg("heat_index_c").alias("_forecast"))
    joined = mean.join(context.select(*by, "mean_hi_c"), list(by), "left")
    usable = F.col("mean_hi_c") > 0
    ratio = F.greatest(F.lit(0.0), F.col("_forecast") / F.when(usable, F.col("mean_hi_c")))
    return joined.select(*by, F.when(usable, ratio).otherwise(1.0).alias("scalar"))
