"""Zone building and zone summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from heatloom import constants as C
from heatloom.functions.labels import size_mode
from heatloom.functions.random import uniform
from heatloom.operators.groups import DEFAULT_BY, GroupProfile, ensure_profile, join_stats
from heatloom.operators.grid import moore_cells
from heatloom.operators.rundir import n_tasks, stage

CENTROIDS = "array<struct<k:int,x:double,y:double>>"
#: Starts of a group, points of a group that one task takes, and places that starts are drawn from in larger groups.
STARTS, TASK_POINTS, SEED_PLACES = 10, 50_000, 5_000
#: Rounds after which k-means is given up as not converging, and the movement that counts as none.
MAX_ITERATIONS, STILL = 300, 1e-9


def standardize(
    cells: DataFrame, columns: Sequence[str], by: Sequence[str], profile: GroupProfile
) -> DataFrame:
    """Centre and scale columns by the mean and population deviation of the group."""
    stats = cells.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    joined = join_stats(cells, stats, by, profile)
    return joined.withColumns(
        {c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9) for c in columns}
    ).drop(*[f"_{p}_{c}" for c in columns for p in ("m", "s")])


def _nearest(cents: str, x: Column, y: Column) -> Column:
    """Squared distance and number of the nearest centroid, the lowest on ties."""
    scored = F.transform(cents, lambda c: F.struct(
        ((c["x"] - x) * (c["x"] - x) + (c["y"] - y) * (c["y"] - y)).alias("d"), c["k"].alias("k")
    ))
    return F.array_min(scored)


def seeded(places: np.ndarray, k: int, seed: int, start: int) -> np.ndarray:
    """k places (all of them if fewer): each new one is drawn with a chance that grows with its squared distance to those before."""
    rng = np.random.default_rng([seed, start])
    chosen = [places[rng.integers(len(places))]]
    d = ((places - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and d.max() > 0:
        chosen.append(places[rng.choice(len(places), p=d / d.sum())])
        d = np.minimum(d, ((places - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def lloyd(points: np.ndarray, cents: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(centroids, number of the nearest for each point, inertia) when no centroid moves any more; an empty cluster keeps its place."""
    for _ in range(iterations):
        d = ((points[:, None, :] - cents[None]) ** 2).sum(axis=2)
        won = d.argmin(axis=1)
        n = np.bincount(won, minlength=len(cents))
        means = np.stack([np.bincount(won, points[:, j], len(cents)) for j in (0, 1)], axis=1) / np.maximum(n, 1)[:, None]
        new = np.where(n[:, None] > 0, means, cents)
        still = np.abs(new - cents).max() <= STILL
        cents = new
        if still:
            d = ((points[:, None, :] - cents[None]) ** 2).sum(axis=2)
            return cents, d.argmin(axis=1), float(d.min(axis=1).sum())
    raise RuntimeError(f"k-means still moves after {iterations} rounds")


def keyed_kmeans(
    points: DataFrame,
    k: int,
    by: Sequence[str],
    iterations: int = MAX_ITERATIONS,
    seed: int = 42,
    profile: GroupProfile | None = None,
    starts: int = STARTS,
    task_points: int = TASK_POINTS,
) -> DataFrame:
    """k-means on (x, y) for every group, the best of several starts; adds ``cluster``.

    Each start draws its first centroids from the group's places by squared distance and
    runs until no centroid moves (an error after ``iterations`` rounds); the start with
    the least inertia wins, the first on ties.  A group that fits into a task runs there.
    For larger ones the starts are drawn from ``SEED_PLACES`` places of the group, and
    rounds are aggregates over all groups and open starts at once.
    """
    profile = ensure_profile(points, by, profile)
    by = list(by)
    if profile.max_rows <= task_points:
        schema = T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType())])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("cell_id", kind="stable")
            xy = pdf[["x", "y"]].to_numpy(dtype=float)
            places = np.unique(xy, axis=0)
            best = min((lloyd(xy, seeded(places, k, seed, s), iterations)[1:] + (s,) for s in range(starts)), key=lambda r: (r[1], r[2]))
            return pdf.assign(cluster=best[0].astype(np.int32))

        # Few bytes but much work: as many tasks as the session has, not as few as the bytes would fill.
        return points.repartition(n_tasks(points), *by).groupBy(*by).applyInPandas(run, schema)
    cents = _distributed_centroids(points, k, by, iterations, seed, profile, starts)
    return join_stats(points, cents, by, profile, "inner").withColumn(
        "cluster", _nearest("cents", F.col("x"), F.col("y"))["k"]).drop("cents")


def _distributed_centroids(points, k: int, by: list[str], iterations: int, seed: int, profile: GroupProfile, starts: int) -> DataFrame:
    """(by, cents) of the start with the least inertia per group."""
    places = points.select(*by, "x", "y").distinct()
    pick = W.partitionBy(*by).orderBy(uniform(seed, "x", "y"), "x", "y")
    drawn = places.withColumn("_n", F.row_number().over(pick)).where(F.col("_n") <= SEED_PLACES)
    schema = T.StructType([*[points.schema[b] for b in by], T.StructField("s", T.IntegerType()), T.StructField("k", T.IntegerType()),
                           T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

    def first(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(pdf[["x", "y"]].to_numpy(dtype=float), axis=0)
        rows = [(*keys, s, j, float(x), float(y)) for s in range(starts) for j, (x, y) in enumerate(seeded(own, k, seed, s))]
        return pd.DataFrame(rows, columns=schema.names)

    every = drawn.groupBy(*by).applyInPandas(first, schema)
    entry = F.struct("k", "x", "y")
    cents = stage(every.groupBy(*by, "s").agg(F.array_sort(F.collect_list(entry)).cast(CENTROIDS).alias("cents")), "kmeans-starts")
    open_starts, done = cents, []
    for _ in range(iterations):
        joined = join_stats(points.select(*by, "x", "y"), open_starts, by, profile.scaled(groups=starts), "inner")
        placed = joined.select(*by, "s", "x", "y", _nearest("cents", F.col("x"), F.col("y"))["k"].alias("k"))
        means = placed.groupBy(*by, "s", "k").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        moved = means.groupBy(*by, "s").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("x", "y").alias("p")))).alias("_new"))
        new = open_starts.withColumnRenamed("cents", "_old").join(moved, [*by, "s"]).withColumn("cents", F.transform("_old", lambda c: F.struct(
            c["k"].alias("k"), F.coalesce(F.try_element_at("_new", c["k"])["x"], c["x"]).alias("x"),
            F.coalesce(F.try_element_at("_new", c["k"])["y"], c["y"]).alias("y"))).cast(CENTROIDS))
        step = F.zip_with("_old", "cents", lambda a, b: F.greatest(F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"])))
        new = stage(new.select(*by, "s", "cents", (F.array_max(step) <= STILL).alias("_still")), "kmeans-round")
        done.append(new.where("_still").drop("_still"))
        open_starts = new.where(~F.col("_still")).drop("_still")
        if open_starts.isEmpty():
            break
    else:
        raise RuntimeError(f"k-means still moves after {iterations} rounds")
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    ends = stage(ends, "kmeans-ends")
    inertia = join_stats(points.select(*by, "x", "y"), ends, by, profile.scaled(groups=starts), "inner").groupBy(*by, "s").agg(
        F.round(F.sum(_nearest("cents", F.col("x"), F.col("y"))["d"]), 9).alias("_i"))
    best = inertia.groupBy(*by).agg(F.min(F.struct("_i", "s")).alias("_b")).select(*by, F.col("_b.s").alias("s"))
    return stage(ends.join(best, [*by, "s"]).drop("s"), "kmeans-best")


def _points(cells: DataFrame, by: Sequence[str], profile: GroupProfile) -> DataFrame:
    base = cells.select(*by, "cell_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return stage(standardize(base, ["x", "y"], by, profile), "zone-points")


def zones_kmeans(
    cells: DataFrame, k: int = C.N_MESO_ZONES, by: Sequence[str] = DEFAULT_BY, iterations: int = MAX_ITERATIONS,
    seed: int = 42, profile: GroupProfile | None = None, starts: int = STARTS, task_points: int = TASK_POINTS,
) -> DataFrame:
    """(by, cell_id, zone_id) of k spatial zones per group, the best of ``starts`` starts."""
    profile = ensure_profile(cells, by, profile)
    out = keyed_kmeans(_points(cells, by, profile), k, by, iterations, seed, profile, starts, task_points)
    return out.select(*by, "cell_id", F.col("cluster").alias("zone_id"))


def zones_hierarchical(
    cells: DataFrame, n_macro: int = C.N_MACRO_ZONES, n_meso: int = C.N_MESO_ZONES,
    by: Sequence[str] = DEFAULT_BY, iterations: int = MAX_ITERATIONS, seed: int = 42,
    profile: GroupProfile | None = None, starts: int = STARTS, task_points: int = TASK_POINTS,
) -> DataFrame:
    """(by, cell_id, macro_zone_id, zone_id): macro zones, each cut into zones numbered per group."""
    profile = ensure_profile(cells, by, profile)
    points = _points(cells, by, profile)
    macro = keyed_kmeans(points, n_macro, by, iterations, seed, profile, starts, task_points)
    macro = stage(macro.withColumnRenamed("cluster", "macro_zone_id"), "macro-zones")
    inner = [*by, "macro_zone_id"]
    # Written, as the zones are numbered from them and then joined to them.
    meso = stage(keyed_kmeans(macro, n_meso, inner, iterations, seed, profile.scaled(groups=n_macro), starts, task_points), "meso-zones")
    numbers = meso.select(*inner, "cluster").distinct().withColumn(
        "zone_id", F.row_number().over(W.partitionBy(*by).orderBy("macro_zone_id", "cluster")) - 1
    )
    joined = join_stats(meso, numbers, [*inner, "cluster"], profile.scaled(groups=n_macro * n_meso))
    return joined.select(*by, "cell_id", "macro_zone_id", "zone_id")


def decompose(
    cells: DataFrame, by: Sequence[str] = DEFAULT_BY, n_meso: int = C.N_MESO_ZONES,
    n_macro: int = C.N_MACRO_ZONES, iterations: int = MAX_ITERATIONS, profile: GroupProfile | None = None,
    centres: DataFrame | None = None,
) -> DataFrame:
    """Zones by the size of the group.

    Up to nine cells: the nine weighted cells around the centre (``centres``: by, lat,
    lon; the mean of the cells if not given), each its own zone.  Up to 500: every cell
    its own zone.  Above: clusters, in two levels for the largest.  Returns (by, cell_id,
    mode, macro_zone_id, zone_id, lon, lat, type, weight); type and weight are those of
    the nine cells, NULL in other modes.  Branches without groups are not planned.
    """
    profile = ensure_profile(cells, by, profile)
    by = list(by)
    sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("mode", size_mode(F.col("_n")))
    tagged = join_stats(cells, sizes.drop("_n"), by, profile)
    modes = {r["mode"] for r in sizes.select("mode").distinct().collect()}
    none = {"macro_zone_id": "int", "type": "string", "weight": "double"}
    columns = [*by, "cell_id", "mode", "macro_zone_id", "zone_id", "lon", "lat", "type", "weight"]

    def finished(df: DataFrame) -> DataFrame:
        gaps = {c: F.lit(None).cast(kind) for c, kind in none.items() if c not in df.columns}
        return df.withColumns(gaps).withColumns({"zone_id": F.col("zone_id").cast("int"), "cell_id": F.col("cell_id").cast("long")}).select(columns)

    def clustered(zoned: DataFrame, mode: str) -> DataFrame:
        place = tagged.where(F.col("mode") == mode).select(*by, "cell_id", "lon", "lat")
        return finished(zoned.join(place, [*by, "cell_id"]).withColumn("mode", F.lit(mode)))

    parts = []
    if "moore" in modes:
        small = tagged.where("mode = 'moore'").groupBy(*by).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
        if centres is not None:
            small = small.select(*by).join(centres.select(*by, "lat", "lon"), by)
        parts.append(finished(moore_cells(small, by).withColumn("mode", F.lit("moore"))))
    if "direct" in modes:
        order = W.partitionBy(*by).orderBy("cell_id")  # 500 cells at most
        parts.append(finished(tagged.where("mode = 'direct'").withColumn("zone_id", F.row_number().over(order) - 1)))
    if "meso" in modes:
        parts.append(clustered(zones_kmeans(tagged.where("mode = 'meso'"), n_meso, by, iterations, profile=profile), "meso"))
    if "hierarchical" in modes:
        zoned = zones_hierarchical(tagged.where("mode = 'hierarchical'"), n_macro, n_meso, by, iterations, profile=profile)
        parts.append(clustered(zoned, "hierarchical"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def zones_report(cells: DataFrame, zones: DataFrame, by: Sequence[str] = DEFAULT_BY, tolerance: float = 1e-6) -> DataFrame:
    """(by, n_cells, n_zones, misplaced, inertia): how many cells lie nearer to another zone's mean than to their own, on standardised coordinates."""
    by = list(by)
    points = _points(cells, by, ensure_profile(cells, by, None)).join(zones.select(*by, "cell_id", "zone_id"), [*by, "cell_id"])
    points = stage(points, "zoned-points")
    means = points.groupBy(*by, "zone_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    per_area = means.groupBy(*by).agg(F.collect_list(F.struct(F.col("zone_id").cast("int").alias("k"), F.col("mx").alias("x"), F.col("my").alias("y"))).cast(CENTROIDS).alias("cents"))
    d = lambda x, y: (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    both = points.join(means, [*by, "zone_id"]).join(per_area, by).select(
        *by, "zone_id", d(F.col("mx"), F.col("my")).alias("own"), _nearest("cents", F.col("x"), F.col("y"))["d"].alias("least"))
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"), F.countDistinct("zone_id").alias("n_zones"),
        F.sum((F.col("own") > F.col("least") + tolerance).cast("long")).alias("misplaced"), F.sum("own").alias("inertia"))


def zone_summary(cells: DataFrame, by: Sequence[str] = ("zone_id",)) -> DataFrame:
    """Cells and mean centre per zone."""
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.round(F.avg("lat"), 6).alias("centroid_lat"), F.round(F.avg("lon"), 6).alias("centroid_lon"),
    )


def zone_risk_summary(cells: DataFrame, by: Sequence[str] = ("zone_id",)) -> DataFrame:
    """Mean indices and expected deaths per zone."""
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.round(F.avg("lat"), 6).alias("centroid_lat"), F.round(F.avg("lon"), 6).alias("centroid_lon"),
        F.round(F.avg("hvi"), 4).alias("mean_hvi"), F.round(F.avg("hri"), 4).alias("mean_hri"),
        F.round(F.coalesce(F.sum("ad_baseline"), F.lit(0.0)), 4).alias("total_ad_baseline"),
    )


def zone_rollup(cells: DataFrame, measure: str) -> DataFrame:
    """Totals per zone, per macro zone and overall."""
    return cells.rollup("macro_zone_id", "zone_id").agg(
        F.count(F.lit(1)).alias("cell_count"), F.sum(measure).alias("total"), F.avg(measure).alias("mean")
    )
