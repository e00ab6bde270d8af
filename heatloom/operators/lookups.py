"""Joins with lookup tables, as-of joins and nearest points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from heatloom import constants as C
from heatloom.functions.labels import iso3_from_point
from heatloom.operators.rundir import n_tasks, stage

MAX_LOOKUP_ROWS = 5_000
#: Grid centres that travel with the tasks and are all looked at, and distances worked out at a time (they stay in the cache).
LITERAL_ROWS, SEARCH_VALUES = 1_000, 1 << 16


def small_rows(df: DataFrame, limit: int = MAX_LOOKUP_ROWS) -> list:
    """Rows of a lookup table; an error if it is not small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a lookup table of at most {limit} rows is needed")
    return rows


def join_beta(aois: DataFrame, beta: DataFrame, zone: str = "climate_zone") -> DataFrame:
    """Add the mortality slope of the climate zone; an unknown zone is an error, raised by the row that has it."""
    side = beta.groupBy(F.col("climate_zone").alias("_zone")).agg(F.max("beta_per_degC").cast("double").alias("_beta"))
    joined = aois.join(side, F.col(zone) == F.col("_zone"), "left")
    message = F.concat(F.lit("unknown climate zone: "), F.coalesce(F.col(zone), F.lit("NULL")))
    value = F.when(F.col("_beta").isNull(), F.raise_error(message).cast("double")).otherwise(F.col("_beta"))
    return joined.withColumn("beta", value).drop("_zone", "_beta")


def join_cdr(
    aois: DataFrame, cdr: DataFrame, iso3: str = "iso3", default: float = C.CDR_DEFAULT
) -> DataFrame:
    """Add the crude death rate of the country, or the default."""
    side = cdr.select(F.upper("country_iso3").alias("_iso3"), F.col("cdr_per_person_per_year").alias("_cdr"))
    joined = aois.join(side, F.upper(F.col(iso3)) == F.col("_iso3"), "left")
    return joined.withColumn("cdr", F.coalesce("_cdr", F.lit(default))).drop("_iso3", "_cdr")


def iso3_from_centroid(aois: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return aois.withColumn("iso3", iso3_from_point(F.col(lat), F.col(lon)))


def nearest_delta(
    aois: DataFrame, grid: DataFrame, lat: str = "lat", lon: str = "lon", literal_rows: int = LITERAL_ROWS, per_tile: int = 64,
) -> DataFrame:
    """Add grid_id, distance, d245 and d585 of the nearest grid centre, the lowest grid_id on ties.

    ``grid`` has (grid_id, lat_center, lon_center, d245, d585) at any places.  A counted,
    small grid travels with the tasks and is searched for batches of rows; a larger one
    meets the rows on tiles (see ``nearest_centres``).  Rows without coordinates, or
    beside an empty grid, get NULL.
    """
    centres = grid.select(
        F.col("grid_id").cast("long").alias("grid_id"), F.col("lat_center").cast("double").alias("_y"), F.col("lon_center").cast("double").alias("_x"), "d245", "d585")
    if grid.limit(literal_rows + 1).count() > literal_rows:
        return nearest_centres(aois, centres, lat, lon, per_tile).withColumn("grid_id", F.col("grid_id").cast(grid.schema["grid_id"].dataType))
    rows = sorted(centres.collect(), key=lambda r: r["grid_id"])
    # The rows of a table stored in one file are a task or two, so they are dealt out before the search.
    return aois.repartition(n_tasks(aois)).withColumn("_b", _nearest_of(rows)(F.col(lat).cast("double"), F.col(lon).cast("double"))).withColumns({
        "grid_id": F.col("_b.id").cast(grid.schema["grid_id"].dataType), "distance": F.col("_b.dist"),
        "d245": F.col("_b.d245"), "d585": F.col("_b.d585"),
    }).drop("_b")


def _nearest_of(rows: list) -> Callable[[Column, Column], Column]:
    """Id, distance and facts of the nearest of a few centres in the order of their ids; the first one on ties."""
    ids = np.array([r["grid_id"] for r in rows], np.int64)
    y, x, d245, d585 = (np.array([r[c] for r in rows], float) for c in ("_y", "_x", "d245", "d585"))
    block = max(1, SEARCH_VALUES // max(1, len(rows)))

    def search(lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
        py, px = lat.to_numpy(dtype=float), lon.to_numpy(dtype=float)
        found = np.flatnonzero(~(np.isnan(py) | np.isnan(px))) if len(ids) else np.zeros(0, np.int64)
        at, dist = np.zeros(len(found), np.int64), np.zeros(len(found))
        for i in range(0, len(found), block):
            own = found[i:i + block]
            dy, dx = y - py[own, None], x - px[own, None]
            d = np.sqrt(dy * dy + dx * dx)
            at[i:i + block] = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
            dist[i:i + block] = np.take_along_axis(d, at[i:i + block, None], axis=1)[:, 0]
        out = pd.DataFrame({"id": ids[at], "dist": dist, "d245": d245[at], "d585": d585[at]}, index=found)
        return out.reindex(range(len(py))).astype({"id": "Int64"})

    return F.pandas_udf(search, "id long, dist double, d245 double, d585 double")


def nearest_centres(points: DataFrame, centres: DataFrame, lat: str, lon: str, per_tile: int = 64) -> DataFrame:
    """``points`` with grid_id, distance and the other columns of the nearest of ``centres`` (grid_id, _y, _x, ...).

    Centres lie on tiles of which none holds more than ``per_tile`` centres, as far as
    cutting tiles helps.  A place looks at its tile and the eight around it; what it
    finds is the nearest if no centre outside them can be nearer, else it looks again
    with tiles of twice the size.  Equal places are looked up once.
    """
    spark = points.sparkSession
    facts = [c for c in centres.columns if c not in ("_x", "_y")]
    centres = stage(centres.where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y")), "centres")
    e = centres.agg(*[f(c) for c in ("_x", "_y") for f in (F.min, F.max)], F.count(F.lit(1))).first()
    span = max((e[1] or 0) - (e[0] or 0), (e[3] or 0) - (e[2] or 0), 1e-9)
    tile = lambda c, size: F.floor(F.col(c) / F.lit(size)).cast("long")
    size = span / max(1.0, (e[4] / 4.0) ** 0.5)
    for _ in range(12):
        top = centres.groupBy(tile("_x", size), tile("_y", size)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if top <= per_tile:
            break
        size /= 4.0
    px, py = F.col(lon).cast("double").alias("_px"), F.col(lat).cast("double").alias("_py")
    open_places = points.select(px, py).distinct().where(F.col("_px").isNotNull() & F.col("_py").isNotNull() & ~F.isnan("_px") & ~F.isnan("_py"))
    found, near = None, F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while e[4]:
        tx, ty = tile("_px", size), tile("_py", size)
        asked = open_places.withColumns({"_tx": tx, "_ty": ty}).withColumn("_d", F.explode(near)).select(
            "_px", "_py", (F.col("_tx") + F.col("_d.i")).alias("_cx"), (F.col("_ty") + F.col("_d.j")).alias("_cy"))
        held = centres.withColumns({"_cx": tile("_x", size), "_cy": tile("_y", size)})
        dy, dx = F.col("_y") - F.col("_py"), F.col("_x") - F.col("_px")
        met = asked.join(held, ["_cx", "_cy"]).withColumn("distance", F.sqrt(dy * dy + dx * dx))
        best = met.groupBy("_px", "_py").agg(F.min(F.struct("distance", *facts)).alias("_b"))
        # what lies outside the nine tiles is at least this far away; nothing does if they hold all centres
        edge = F.least(*[d for c, t in (("_px", tx), ("_py", ty)) for d in (F.col(c) - (t - 1) * F.lit(size), (t + 2) * F.lit(size) - F.col(c))])
        whole = ((tx - 1) * F.lit(size) <= F.lit(e[0])) & ((tx + 2) * F.lit(size) > F.lit(e[1])) & ((ty - 1) * F.lit(size) <= F.lit(e[2])) & ((ty + 2) * F.lit(size) > F.lit(e[3]))
        looked = stage(open_places.join(best, ["_px", "_py"], "left").withColumn(
            "_sure", F.coalesce(F.col("_b.distance") < edge * (1 - 1e-9), F.lit(False)) | whole), "nearest")
        part = looked.where("_sure").select("_px", "_py", "_b.*")
        found = part if found is None else found.unionByName(part)
        open_places = looked.where("not _sure").select("_px", "_py")
        if open_places.isEmpty():
            break
        size *= 2.0
    if found is None:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in centres.schema.fields if f.name in facts)
        found = spark.createDataFrame([], f"_px double, _py double, distance double, {kinds}")
    same = (F.col(lon).cast("double") == F.col("_px")) & (F.col(lat).cast("double") == F.col("_py"))
    return points.join(found, same, "left").drop("_px", "_py")


def epoch_asof(
    epochs: DataFrame, year: Column | int, by: Sequence[str] = ("cell_id",), value: str = "built_surface",
    epoch: str = "epoch",
) -> DataFrame:
    """Value of the latest epoch up to the year per key, else of the earliest epoch."""
    y = year if isinstance(year, Column) else F.lit(int(year))
    usable = F.when(F.col(epoch) <= y, F.col(epoch))
    return epochs.groupBy(*by).agg(
        F.coalesce(F.max(usable), F.min(epoch)).alias("epoch_used"),
        F.coalesce(F.max_by(value, usable), F.min_by(value, epoch)).alias(value),
    )


def year_proxy_asof(
    yearly: DataFrame, year: Column | int, by: Sequence[str] = ("cell_id",), value: str = "population",
    native_until: int = 2020,
) -> DataFrame:
    """Value of the requested year per key, with fallbacks.

    ``yearly`` has (by, source, year, value) with sources ``native`` and
    ``extended``.  Up to ``native_until`` the native source serves its own year.
    Later years come from the extended source, else from the last native year.
    If nothing matches, the latest year at hand is used.
    """
    y = year if isinstance(year, Column) else F.lit(int(year))
    yr = F.col("year")
    own = F.when(y <= native_until, F.lit("native")).otherwise(F.lit("extended"))
    priority = (
        F.when((F.col("source") == own) & (yr == y), 3 * 10_000)
        .when((y > native_until) & (F.col("source") == "native") & (yr == native_until), 2 * 10_000)
        .otherwise(yr)
    )
    # Among rows of the same year the native source wins.
    order = priority * 2 + (F.col("source") == "native").cast("int")
    return yearly.groupBy(*by).agg(
        F.max_by("year", order).alias("year_used"),
        F.max_by("source", order).alias("source_used"),
        F.max_by(value, order).alias(value),
    )


def scenario_array(scenarios: Sequence[tuple] = tuple(C.SCENARIOS)) -> Column:
    """The scenarios as a literal array of structs."""
    return F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(float(t)).alias("t_delta"), F.lit(float(p)).alias("pop_factor"),
                 F.lit(float(d)).alias("event_days"), F.lit(text).alias("description"))
        for n, t, p, d, text in scenarios
    ])


def scenario_cross(df: DataFrame, scenarios: Sequence[tuple] = tuple(C.SCENARIOS)) -> DataFrame:
    """Every row once per scenario, without a join."""
    return df.select("*", F.inline(scenario_array(scenarios)))
