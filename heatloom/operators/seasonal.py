"""Hottest months, climatology and heat index of a season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from heatloom import constants as C
from heatloom.functions.heat import dewpoint_to_rh, heat_index
from heatloom.operators.groups import DEFAULT_BY


def monthly_climate_means(
    climate: DataFrame, year: Column | int | None = None, by: Sequence[str] = DEFAULT_BY, years: int = 10
) -> DataFrame:
    """Mean temperature and dew point per month over the years before ``year``, in degrees C."""
    if year is not None:
        climate = climate.where((F.col("year") >= year - years) & (F.col("year") < year))
    return climate.groupBy(*by, "month").agg(
        F.round(F.avg("temperature_2m") - C.KELVIN, 2).alias("mean_tmax_c"),
        F.round(F.avg("dewpoint_temperature_2m") - C.KELVIN, 2).alias("mean_td_c"),
    )


def hottest_months(
    monthly: DataFrame,
    scenes: DataFrame,
    year: int,
    by: Sequence[str] = DEFAULT_BY,
    start: int = C.N_HOTTEST_MONTHS,
    longest: int = C.MAX_WINDOW_MONTHS,
    min_scenes: int = C.MIN_SCENES,
) -> DataFrame:
    """The smallest window of hottest months that holds enough scenes.

    ``monthly`` has (by, month, mean_tmax_c).  ``scenes`` has (by, scene_id, ts,
    cloud_cover).  A window of the n hottest months counts every scene between
    its first and last month, below 70 % cloud.  Windows grow from ``start`` to
    ``longest`` months; the longest is used if none suffices.  Scenes are counted
    per month before the windows see them, so a window handles 12 rows at most.
    """
    ranked = monthly.withColumn(
        "rn", F.row_number().over(W.partitionBy(*by).orderBy(F.col("mean_tmax_c").desc(), "month"))
    )
    sizes = F.explode(F.array(*[F.lit(n) for n in range(start, longest + 1)]))
    windows = (
        ranked.select("*", sizes.alias("n_months"))
        .where(F.col("rn") <= F.col("n_months"))
        .groupBy(*by, "n_months")
        .agg(F.sort_array(F.collect_list("month")).alias("months"))
    )
    seen = scenes.where(
        (F.col("cloud_cover") < C.LANDSAT_COUNT_CLOUD)
        & (F.col("ts") >= f"{year}-01-01") & (F.col("ts") < f"{year + 1}-01-01")
    )
    per_month = seen.groupBy(*by, F.month("ts").alias("m")).agg(
        F.count_distinct("scene_id").alias("n")
    ).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("m", "n"))).alias("by_month"))
    span = F.sequence(F.array_min("months"), F.array_max("months"))
    counted = windows.join(per_month, list(by), "left").withColumn(
        "n_scenes",
        F.coalesce(F.aggregate(
            span, F.lit(0).cast("long"),
            lambda acc, m: acc + F.coalesce(F.try_element_at("by_month", m), F.lit(0).cast("long")),
        ), F.lit(0).cast("long")),
    )
    choice = F.when(F.col("n_scenes") >= min_scenes, F.col("n_months")).otherwise(100 - F.col("n_months"))
    return counted.groupBy(*by).agg(
        F.min_by("months", choice).alias("months"), F.min_by("n_scenes", choice).alias("n_scenes")
    )


def _chosen(monthly: DataFrame, months: DataFrame, by: Sequence[str]) -> DataFrame:
    """Climate rows of the chosen months; a month without climate keeps missing values."""
    wanted = months.select(*by, F.explode("months").alias("month"))
    return wanted.join(monthly, [*by, "month"], "left")


def period_heat_index(monthly: DataFrame, months: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """Mean and maximum heat index over the chosen months, with defaults where climate is missing.

    A single missing month takes default temperatures.  A group without any
    climate row takes the default index values.
    """
    t = F.coalesce("mean_tmax_c", F.lit(C.DEFAULT_MONTH_T_C))
    td = F.coalesce("mean_td_c", F.lit(C.DEFAULT_MONTH_TD_C))
    hi = heat_index(t, dewpoint_to_rh(t, td))
    agg = _chosen(monthly, months, by).groupBy(*by).agg(
        F.round(F.avg(hi), 2).alias("_mean"), F.round(F.max(hi), 2).alias("_max"),
        F.count("mean_tmax_c").alias("_n"),
    )
    pick = lambda c, d: F.when(F.col("_n") > 0, F.col(c)).otherwise(C.FALLBACK_HEAT_INDEX[d])
    return agg.select(
        *by, pick("_mean", "mean_hi_c").alias("mean_hi_c"), pick("_max", "max_hi_c").alias("max_hi_c"),
        pick("_max", "p90_hi_c").alias("p90_hi_c"),
    )


def scenario_heat_index(period: DataFrame, t_delta: Column) -> DataFrame:
    """Shift the heat index values by a warming."""
    return period.withColumns({c: F.col(c) + t_delta for c in ("mean_hi_c", "max_hi_c", "p90_hi_c")})


def climatological_mmt(monthly: DataFrame, months: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """Percentile of the monthly means over the chosen months (at most 12 rows per group)."""
    return _chosen(monthly, months, by).groupBy(*by).agg(
        F.percentile("mean_tmax_c", F.lit(C.MMT_PERCENTILE)).alias("mmt")
    )


def month_filters(months: DataFrame, year: Column | int, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """One [start, end) window per chosen month."""
    y = year if isinstance(year, Column) else F.lit(int(year))
    out = months.select(*by, F.explode("months").alias("month"))
    start = F.make_date(y, F.col("month"), F.lit(1))
    return out.withColumns({"start_date": start, "end_date": F.add_months(start, 1)})
