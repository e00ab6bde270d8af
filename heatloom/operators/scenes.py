"""Scene pixels to indicator composites: one row per cell and group in, one per cell out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from heatloom import constants as C
from heatloom.functions import raster as R
from heatloom.functions.basic import clamp, total
from heatloom.operators.groups import DEFAULT_BY, GroupProfile, ensure_profile, join_stats
from heatloom.operators.ordering import percentiles

CELL = ("cell_id",)


def scene_filter(
    pixels: DataFrame,
    start: Column | str | None = None,
    end: Column | str | None = None,
    max_cloud: float = C.LANDSAT_MAX_CLOUD,
    thermal: str | None = "st_b10",
) -> DataFrame:
    """Scenes of a date window [start, end) below a cloud cover, with a thermal band.

    All tests compare a column with a constant, so they reach the file scan.  A table
    partitioned by year and month (``write_scene_table``) is pruned to the months of a
    window that is given as text.
    """
    keep = F.col("cloud_cover") < max_cloud
    if {"scene_year", "scene_month"} <= set(pixels.columns):
        month = F.col("scene_year") * 12 + F.col("scene_month")
        for bound, side in ((start, 0), (end, 1)):
            if isinstance(bound, str):
                at = int(bound[:4]) * 12 + int(bound[5:7])
                keep = keep & ((month <= at) if side else (month >= at))
    if start is not None:
        keep = keep & (F.col("ts") >= start)
    if end is not None:
        keep = keep & (F.col("ts") < end)
    if thermal is not None:
        keep = keep & F.col(thermal).isNotNull()
    return pixels.where(keep)


def landsat_cloud_mask(pixels: DataFrame, relaxed: bool = False) -> DataFrame:
    test = R.relaxed_clear if relaxed else R.strict_clear
    return pixels.where(test(F.col("qa_pixel")))


def s2_scl_mask(pixels: DataFrame, max_cloud: float = C.S2_MAX_CLOUD) -> DataFrame:
    return pixels.where((F.col("cloud_cover") < max_cloud) & R.scl_clear(F.col("scl")))


def landsat_scale(pixels: DataFrame) -> DataFrame:
    """Digital numbers to reflectance and degrees C; a missing thermal band stays missing."""
    bands = {b: R.surface_reflectance(F.col(b)) for b in C.ALBEDO_COEFFS}
    return pixels.withColumns({**bands, "lst_c": R.surface_temperature_c(F.col("st_b10"))})


def union_sensors(*parts: DataFrame) -> DataFrame:
    """Scenes of several sensors in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def composite_percentile(
    pixels: DataFrame, value: str, prob: float = C.LST_PERCENTILE, by: Sequence[str] = CELL,
    name: str | None = None, profile: GroupProfile | None = None,
) -> DataFrame:
    """Percentile of a band over the scenes of each cell."""
    p = percentiles(pixels, [value], [prob], by, profile)
    return p.select(*by, F.col(f"{value}_p")[0].alias(name or value))


def composite_mean(pixels: DataFrame, value: Column, name: str, by: Sequence[str] = CELL) -> DataFrame:
    return pixels.groupBy(*by).agg(F.avg(value).alias(name))


def composite_median(
    pixels: DataFrame, columns: dict[str, Column], by: Sequence[str] = CELL,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Median of one or more expressions over the scenes of each cell."""
    values = pixels.select(*by, *[c.alias(n) for n, c in columns.items()])
    p = percentiles(values, list(columns), [0.5], by, profile)
    return p.select(*by, *[F.col(f"{n}_p")[0].alias(n) for n in columns])


def composite_mode(pixels: DataFrame, label: str, by: Sequence[str] = CELL) -> DataFrame:
    """Most frequent label per cell, the lowest one on ties; any integer is a label."""
    counts = pixels.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by(F.col(label), F.struct("_n", -F.col(label).cast("long")))
    return counts.groupBy(*by).agg(best.cast("int").alias(label))


def broadband_albedo(pixels: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Mean albedo per cell within [0, 1], from scaled reflectances."""
    value = R.broadband_albedo({b: F.col(b) for b in C.ALBEDO_COEFFS})
    mean = composite_mean(pixels, value, "albedo", by)
    return mean.withColumn("albedo", clamp(F.col("albedo"), 0.0, 1.0))


def spectral_index(
    pixels: DataFrame, a: str, b: str, name: str, by: Sequence[str] = CELL,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Median normalised difference per cell within [-1, 1]."""
    out = composite_median(pixels, {name: R.normalized_difference(F.col(a), F.col(b))}, by, profile)
    return out.withColumn(name, clamp(F.col(name), -1.0, 1.0))


def lst_with_fallback(
    pixels: DataFrame,
    group: Sequence[str] = DEFAULT_BY,
    min_scenes: int = C.MIN_SCENES,
    prob: float = C.LST_PERCENTILE,
    profile: GroupProfile | None = None,
    cell_profile: GroupProfile | None = None,
) -> DataFrame:
    """LST composite per cell; where a group has too few scenes the relaxed mask is used.

    The scene count decides per group.  Each pixel then keeps only the value its
    group asked for, so a single percentile per cell remains.
    """
    profile = ensure_profile(pixels, group, profile)
    strict_scene = (F.col("cloud_cover") < C.LANDSAT_MAX_CLOUD) & F.col("st_b10").isNotNull()
    relaxed_scene = (F.col("cloud_cover") < C.LANDSAT_RELAXED_CLOUD) & F.col("st_b10").isNotNull()
    scenes = (
        pixels.where(strict_scene).select(*group, "scene_id").distinct()
        .groupBy(*group).agg(F.count(F.lit(1)).alias("n_scenes"))
    )
    joined = join_stats(pixels.where(relaxed_scene), scenes, group, profile)
    relaxed = F.coalesce(F.col("n_scenes"), F.lit(0)) < min_scenes
    keep = (relaxed & R.relaxed_clear(F.col("qa_pixel"))) | (
        ~relaxed & strict_scene & R.strict_clear(F.col("qa_pixel"))
    )
    keys = list(dict.fromkeys([*group, "cell_id"]))
    # All pixels of a cell bound those that are kept, and counting them is a narrow scan.
    cell_profile = ensure_profile(pixels, keys, cell_profile)
    kept = joined.where(keep).select(
        *keys, relaxed.alias("relaxed"), R.surface_temperature_c(F.col("st_b10")).alias("lst")
    )
    return composite_percentile(kept, "lst", prob, [*keys, "relaxed"], profile=cell_profile)


def uhi_intensity(
    cells: DataFrame, rural: Column, lst: str = "lst", by: Sequence[str] = DEFAULT_BY,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Add uhi: temperature above the rural mean of the group, within [-5, 20]."""
    profile = ensure_profile(cells, by, profile)
    base = cells.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(rural, F.col(lst))), F.avg(lst)).alias("_base")
    )
    joined = join_stats(cells, base, by, profile)
    return joined.withColumn("uhi", clamp(F.col(lst) - F.col("_base"), -5.0, 20.0)).drop("_base")


def scene_count(
    pixels: DataFrame, by: Sequence[str] = ("sensor",), minimum: int = 1, approximate: bool = False
) -> DataFrame:
    """Distinct scenes per group and whether they reach the minimum."""
    if approximate:
        counted = pixels.groupBy(*by).agg(F.approx_count_distinct("scene_id").alias("n_scenes"))
    else:
        counted = pixels.groupBy(*by).agg(F.count_distinct("scene_id").alias("n_scenes"))
    return counted.withColumn("sufficient", F.col("n_scenes") >= minimum)


def tree_cover_effective(cells: DataFrame, year: Column | int) -> DataFrame:
    y = year if isinstance(year, Column) else F.lit(int(year))
    return cells.withColumn(
        "tree_cover", R.effective_tree_cover(F.col("treecover2000"), F.col("lossyear"), y)
    )


def canopy_height(tiles: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Mosaic of height tiles: the last tile with a value wins; within [0, 50]."""
    last = F.max_by("height", F.when(F.col("height").isNotNull(), F.col("tile_order")))
    return tiles.groupBy(*by).agg(clamp(last, 0.0, 50.0).alias("canopy_height"))


def nightlight_raw(cells: DataFrame) -> DataFrame:
    return cells.withColumn("viirs_dnb_raw", R.nightlight(F.col("maximum"), F.col("avg_rad")))


def built_fraction(cells: DataFrame) -> DataFrame:
    return cells.withColumn("built_frac", R.built_fraction(F.col("built_surface")))


def building_height(epochs: DataFrame, epoch: int = C.GHS_HEIGHT_EPOCH) -> DataFrame:
    return epochs.where(F.col("epoch") == epoch).select("cell_id", F.col("built_height").alias("building_height"))


def population_clamp(cells: DataFrame) -> DataFrame:
    return cells.withColumn("population", clamp(F.col("population"), 0.0, 1e9))


def population_total(bands: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Population per cell over all age bands; missing bands count as zero unless all are missing."""
    return bands.groupBy(*by).agg(F.sum("people").alias("population"))


def age_fractions(bands: DataFrame, by: Sequence[str] = CELL, catalog: bool = False) -> DataFrame:
    """Population and the shares of elderly and small children per cell.

    The tabular variant floors the total and clips the shares at 0.7 and 0.5.
    The catalog variant clips both at 1 and sets them to 0 in empty cells.
    """
    people = F.coalesce(F.col("people"), F.lit(0.0))
    sums = bands.groupBy(*by).agg(
        F.sum("people").alias("population"),
        F.sum(F.when(F.col("age") >= C.ELDERLY_FROM_AGE, people).otherwise(0.0)).alias("_old"),
        F.sum(F.when(F.col("age").isin(C.CHILD_AGES), people).otherwise(0.0)).alias("_young"),
    )
    pop = F.col("population")
    if catalog:
        share = lambda c: F.when(pop >= C.MIN_POPULATION, clamp(F.col(c) / (pop + 1e-6), 0.0, 1.0)).otherwise(0.0)
        old, young = share("_old"), share("_young")
    else:
        floor = F.greatest(pop, F.lit(1e-6))
        old, young = clamp(F.col("_old") / floor, 0.0, 0.7), clamp(F.col("_young") / floor, 0.0, 0.5)
    return sums.select(*by, "population", old.alias("elderly_frac"), young.alias("child_frac"))


def built_mask(fractions: DataFrame, column: str = "impervious") -> DataFrame:
    return fractions.withColumn("is_built", F.col(column) > 0.5)


def stack_bands(*parts: DataFrame, by: Sequence[str] = ("aoi_id", "cell_id")) -> DataFrame:
    """Band groups of the same grid side by side.

    Rows are tagged and collected by one aggregate on the cell key instead of a
    chain of joins, so the whole stack costs a single shuffle.  A cell is kept
    if all parts hold it.
    """
    columns = [[c for c in p.columns if c not in by] for p in parts]
    rows = None
    for i, p in enumerate(parts):
        cols = [F.col(c) if j == i else F.lit(None).cast(parts[j].schema[c].dataType).alias(c)
                for j, names in enumerate(columns) for c in names]
        part = p.select(*by, F.lit(i).alias("_part"), *cols)
        rows = part if rows is None else rows.unionByName(part)
    flat = [c for names in columns for c in names]
    merged = rows.groupBy(*by).agg(
        *[F.max(c).alias(c) for c in flat],
        total([F.max((F.col("_part") == i).cast("int")) for i in range(len(parts))]).alias("_parts"),
    )
    return merged.where(F.col("_parts") == len(parts)).drop("_parts")


def stack_bucketed(parts: Sequence[DataFrame], by: Sequence[str] = ("aoi_id", "cell_id")) -> DataFrame:
    """Band groups that are stored in buckets of the cell key, side by side; a cell is kept if all parts hold it.

    Tables of ``write_bucketed`` with equal bucket numbers are merged bucket by bucket,
    without a shuffle.
    """
    out = parts[0].hint("merge")
    for p in parts[1:]:
        out = out.join(p.hint("merge"), list(by))
    return out


def merge_age_rasters(
    cells: DataFrame, ages: DataFrame, inside: Column | None = None,
    by: Sequence[str] = ("aoi_id", "cell_id"),
    columns: Sequence[str] = ("population", "elderly_frac", "child_frac"),
) -> DataFrame:
    """Replace population columns by a second source where it has the cell.

    ``inside`` limits the second source to the area of interest; cells outside
    become missing.
    """
    found = [c for c in columns if c in ages.columns]
    other = ages.select(*by, F.lit(True).alias("_found"), *[F.col(c).alias(f"_new_{c}") for c in found])
    joined = cells.join(other, list(by), "left")
    value = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in found}
    if inside is not None:
        value = {c: F.when(inside, v) for c, v in value.items()}
    return joined.withColumns(value).drop("_found", *[f"_new_{c}" for c in found])
