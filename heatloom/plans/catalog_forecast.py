"""Queries on seasons, heat indices, forecasts and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom.functions.heat import dewpoint_to_rh, heat_index
from heatloom.operators import heatwave, seasonal
from heatloom.plans import sqltext as S
from heatloom.plans.registry import query
from heatloom.plans.views import oracle, view
from heatloom.streaming import forecast as streams

MMT, ABOVE = 36.0, 4.0


def forecast(spark, sf):
    return heatwave.with_heat_index(view(spark, sf, "forecast"))


FC = f", fc as (select *, {S.heat_index()} as hi from forecast)"
DAILY = FC + ", daily as (select aoi_id, valid_time::date as day, max(hi) as max_hi from fc group by 1, 2)"


@query("heat_index", oracle("forecast", f"select event_id, round({S.heat_index()}, 6) as hi from forecast"))
def _(spark, sf):
    return view(spark, sf, "forecast").select("event_id", heat_index(F.col("t2m_c"), F.col("rh_pct")).alias("hi"))


@query("dewpoint_to_rh", oracle("forecast", f"select event_id, round({S.dewpoint_rh('t2m_c', '(t2m_c * 0.6 + rh_pct * 0.1)')}, 6) as rh from forecast"))
def _(spark, sf):
    return view(spark, sf, "forecast").select(
        "event_id", dewpoint_to_rh(F.col("t2m_c"), F.col("t2m_c") * 0.6 + F.col("rh_pct") * 0.1).alias("rh"))


@query("daily_max", oracle("forecast", DAILY + " select aoi_id, day, round(max_hi, 6) as max_hi from daily"))
def _(spark, sf):
    return heatwave.daily_max(forecast(spark, sf))


def runs_sql(number: str) -> str:
    return DAILY + f""", h as (select *, max_hi > 40 as hot, {number} as no from daily),
    r as (select *, no - row_number() over (partition by aoi_id, hot order by day) as run from h),
    g as (select aoi_id, run, min(day) as s, max(day) as e, count(*) as days from r where hot group by 1, 2),
    best as (select *, row_number() over (partition by aoi_id order by days desc, s) as rn from g),
    tot as (select aoi_id, max(max_hi) as max_hi, avg(case when hot then max_hi - 40 end) as ex from h group by 1)
    select tot.aoi_id, coalesce(days >= 3, false) as heatwave_detected, case when days >= 3 then s end as start_date, case when days >= 3 then e end as end_date,
    (case when days >= 3 then days else 0 end)::int as event_days, round(max_hi, 6) as max_hi, round(case when days >= 3 then ex else 0 end, 6) as mean_hi_excess
    from tot left join best on tot.aoi_id = best.aoi_id and rn = 1"""


@query("heatwave_runs", oracle("forecast", runs_sql("datediff('day', date '1970-01-01', day)")))
def _(spark, sf):
    return heatwave.heatwave_runs(heatwave.daily_max(forecast(spark, sf)), MMT, ABOVE)


@query("heatwave_runs_rows", oracle("forecast", runs_sql("row_number() over (partition by aoi_id order by day)")))
def _(spark, sf):
    return heatwave.heatwave_runs(heatwave.daily_max(forecast(spark, sf)), MMT, ABOVE, calendar=False)


# --- season --------------------------------------------------------------------------
MONTHLY = """, monthly as (select aoi_id, month, round(avg(temperature_2m) - 273.15::double, 2) as t, round(avg(dewpoint_temperature_2m) - 273.15::double, 2) as td
    from monthly_climate where year >= 1987 and year < 1997 group by 1, 2)"""
YEAR = 1995


def monthly(spark, sf):
    return seasonal.monthly_climate_means(view(spark, sf, "monthly_climate"), 1997)


def season_scenes(spark, sf):
    return view(spark, sf, "scene_pixels").select((F.col("cell_id") % 10).cast("int").alias("aoi_id"), "scene_id", "ts", "cloud_cover")


def months(spark, sf):
    return seasonal.hottest_months(monthly(spark, sf), season_scenes(spark, sf), YEAR, min_scenes=400)


MONTHS = MONTHLY + f""", rk as (select *, row_number() over (partition by aoi_id order by t desc, month) as rn from monthly),
    win as (select aoi_id, n, list_sort(list(month)) as months from rk, (select unnest([2, 3, 4, 5]) as n) where rn <= n group by 1, 2),
    pm as (select (cell_id % 10)::int as aoi_id, month(ts) as m, count(distinct scene_id) as c from scene_pixels
      where cloud_cover < 70 and ts >= timestamp '{YEAR}-01-01' and ts < timestamp '{YEAR + 1}-01-01' group by 1, 2),
    cnt as (select win.aoi_id, n, any_value(months) as months, coalesce(sum(c), 0)::bigint as n_scenes from win left join pm
      on pm.aoi_id = win.aoi_id and m between list_min(months) and list_max(months) group by 1, 2),
    pick as (select *, row_number() over (partition by aoi_id order by case when n_scenes >= 400 then n else 100 - n end) as rn from cnt),
    chosen as (select aoi_id, months, n_scenes from pick where rn = 1), cm as (select aoi_id, unnest(months) as month from chosen)"""


@query("monthly_climate_means", oracle("monthly_climate", MONTHLY + " select aoi_id, month, t as mean_tmax_c, td as mean_td_c from monthly"))
def _(spark, sf):
    return monthly(spark, sf)


@query("hottest_months", oracle("monthly_climate scene_pixels", MONTHS + " select aoi_id, array_to_string(months, ',') as months, n_scenes from chosen"))
def _(spark, sf):
    return months(spark, sf).withColumn("months", F.array_join(F.col("months").cast("array<string>"), ","))


PERIOD = MONTHS + f""", per as (select aoi_id, round(avg(hi), 2) as mean_hi_c, round(max(hi), 2) as max_hi_c, round(max(hi), 2) as p90_hi_c from
    (select cm.aoi_id, {S.heat_index('t', S.dewpoint_rh('t', 'td'))} as hi from cm join monthly using (aoi_id, month)) group by 1)"""


@query("period_heat_index", oracle("monthly_climate scene_pixels", PERIOD + " select * from per"))
def _(spark, sf):
    return seasonal.period_heat_index(monthly(spark, sf), months(spark, sf))


@query("scenario_heat_index", oracle("monthly_climate scene_pixels", PERIOD + """ select aoi_id, round(mean_hi_c + 1.5::double + aoi_id * 0.1::double, 6) as mean_hi_c,
    round(max_hi_c + 1.5::double + aoi_id * 0.1::double, 6) as max_hi_c, round(p90_hi_c + 1.5::double + aoi_id * 0.1::double, 6) as p90_hi_c from per"""))
def _(spark, sf):
    per = seasonal.period_heat_index(monthly(spark, sf), months(spark, sf))
    return seasonal.scenario_heat_index(per, F.lit(1.5) + F.col("aoi_id") * F.lit(0.1))


@query("climatological_mmt", oracle("monthly_climate scene_pixels", MONTHS + " select aoi_id, round(quantile_cont(t, 0.75), 6) as mmt from cm join monthly using (aoi_id, month) group by 1"))
def _(spark, sf):
    return seasonal.climatological_mmt(monthly(spark, sf), months(spark, sf))


@query("month_filters", oracle("monthly_climate scene_pixels", MONTHS + f""" select aoi_id, month::int as month, make_date({YEAR}, month, 1) as start_date,
    (make_date({YEAR}, month, 1) + interval 1 month)::date as end_date from cm"""))
def _(spark, sf):
    return seasonal.month_filters(months(spark, sf), YEAR)


@query("hri_update_scalar", oracle("forecast monthly_climate scene_pixels", PERIOD + FC + """ select aoi_id, round(case when mean_hi_c > 0 then greatest(0, avg(hi) / mean_hi_c) else 1 end, 6) as scalar
    from fc left join (select aoi_id, case when aoi_id = 3 then null else mean_hi_c end as mean_hi_c from per) using (aoi_id) group by aoi_id, mean_hi_c"""))
def _(spark, sf):
    per = seasonal.period_heat_index(monthly(spark, sf), months(spark, sf))
    context = per.withColumn("mean_hi_c", F.when(F.col("aoi_id") != 3, F.col("mean_hi_c")))
    return heatwave.hri_update_scalar(forecast(spark, sf), context)


# --- streams ---------------------------------------------------------------------------
def readings(spark, sf):
    """The event table as a stream of forecast readings."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = streams.read_forecast_stream(spark, sf, schema, glob="events.parquet")
    table = raw.selectExpr(
        "cast(user_id % 10 as int) as aoi_id", "event_id", "cast(ts as timestamp) as valid_time",
        "18e0 + least(value, 200e0) / 12.5e0 as t2m_c", "cast(30 + (event_id % 60) as double) as rh_pct")
    return streams.with_stream_heat_index(table)


@query("stream_daily_max", oracle("forecast", DAILY + " select aoi_id, day, round(max_hi, 6) as max_hi from daily"))
def _(spark, sf):
    return streams.run_available(streams.stream_daily_max(readings(spark, sf)), "daily", ["aoi_id", "day"])


@query("stream_rolling_hi", oracle("forecast", FC + """ select aoi_id, (valid_time::date - d)::date as start_day, round(avg(hi), 6) as mean_hi, count(*) as n
    from fc, (select unnest([0, 1, 2])::int as d) group by 1, 2"""))
def _(spark, sf):
    return streams.run_available(streams.stream_rolling_hi(readings(spark, sf)), "rolling", ["aoi_id", "start_day"])


@query("stream_heat_episodes", oracle("forecast", FC + """, hot as (select aoi_id, valid_time, hi, case when valid_time - lag(valid_time) over w < interval 1 day then 0 else 1 end as fresh
    from fc where hi > 40 window w as (partition by aoi_id order by valid_time)),
    ses as (select *, sum(fresh) over (partition by aoi_id order by valid_time rows unbounded preceding) as sid from hot)
    select aoi_id, min(valid_time) as start, max(valid_time) + interval 1 day as end, count(*) as n, round(max(hi), 6) as max_hi from ses group by aoi_id, sid"""))
def _(spark, sf):
    s = streams.stream_heat_episodes(readings(spark, sf), 40.0)
    # all sessions, those that are still open too; append mode would leave these out
    out = streams.run_available(s, "episodes", ["aoi_id", "start"], mode="complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_latest_run", oracle("forecast", FC + """, runs as (select aoi_id, date_trunc('hour', valid_time) as valid_time, event_id, hi from fc)
    select aoi_id, valid_time, max(event_id) as run_time, round(arg_max(hi, event_id), 6) as heat_index_c from runs group by 1, 2"""))
def _(spark, sf):
    # Several runs forecast the same hour; the highest run number is the newest.
    r = readings(spark, sf).withColumns({"valid_time": F.date_trunc("hour", "valid_time"), "run_time": F.col("event_id")})
    out = streams.run_available(streams.stream_latest_run(r, ["heat_index_c"]), "latest", ["aoi_id", "valid_time"])
    return out.withColumn("valid_time", F.col("valid_time").cast("timestamp_ntz"))


@query("stream_heatwave_alert", oracle("forecast", DAILY + """, h as (select aoi_id, datediff('day', date '1970-01-01', day) as d from daily where max_hi > 40),
    r as (select *, d - row_number() over (partition by aoi_id order by d) as run from h),
    g as (select aoi_id, max(d) as e, count(*) as days from r group by aoi_id, run)
    select aoi_id, max(e)::int as last_day, arg_max(days, e)::int as run_days, arg_max(days, e) >= 3 as alert from g group by aoi_id"""))
def _(spark, sf):
    s = streams.stream_heatwave_alert(readings(spark, sf), MMT + ABOVE)
    return streams.run_available(s, "alert", ["aoi_id"], state_store=streams.ROCKSDB)
