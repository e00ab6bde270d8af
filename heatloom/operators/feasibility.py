"""Which interventions a cell may receive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from heatloom import constants as C
from heatloom.functions.basic import clamp


def prescribable_flag(cells: DataFrame, label: str = "dw_label", population: str = "population") -> DataFrame:
    """Add prescribable: usable land cover, enough people, no fill value."""
    lab, pop = F.col(label), F.col(population)
    usable = (
        ~lab.isin(C.NON_PRESCRIBABLE_LABELS) & (pop >= C.MIN_POPULATION) & ~lab.isin(C.NODATA_SENTINELS)
        & ~F.when(F.abs(pop) < 1e9, pop.cast("long")).isin(C.NODATA_SENTINELS) & (pop >= -1)
    )
    return cells.withColumn("prescribable", F.coalesce(usable, F.lit(False)))


def feasibility_columns(columns: list[str]) -> dict[str, Column]:
    """One boolean expression per intervention, for a table with the given columns.

    Height and land-cover tests apply only where the table has those columns.
    Missing indicator columns count as absent surface, vegetation or people.
    """
    has = set(columns)
    value = lambda c, default: F.col(c) if c in has else F.lit(default)
    true = F.lit(True)
    label = F.col("dw_label") if "dw_label" in has else None
    base = value("population", 1.0) >= C.MIN_POPULATION
    if label is not None:
        base = base & ~label.isin(C.NON_PRESCRIBABLE_LABELS)
    built = value("built_frac", 0.0)
    open_land = clamp(1.0 - built, 0.0, 1.0)
    below = lambda limit: (F.col("building_height") < limit) if "building_height" in has else true
    roof = base & (built >= C.ROOF_MIN_BUILT) & below(C.ROOF_MAX_HEIGHT_M)
    water_side = base & (open_land >= C.BGI_MIN_OPEN) & below(C.BGI_MAX_HEIGHT_M)
    dry = (label != C.WATER_LABEL) if label is not None else true
    rules = {
        "SR1_cooling_center": base & (built >= C.ROOF_MIN_BUILT),
        "SR2_misting_station": base & (built >= C.MISTING_MIN_BUILT),
        "SR3_welfare_check": base & (value("elderly_frac", 0.0) > C.WELFARE_MIN_ELDERLY),
        "SR4_medical_prepositioning": base,
        "SR5_shade_structure": base & (value("canopy_height", 0.0) < C.SHADE_MAX_CANOPY_M),
        "LR1_tree_planting": base & (open_land >= C.TREE_MIN_OPEN),
        "LR2_cool_roof": roof,
        "LR3_bgi": water_side,
        "LR4_cool_pavement": base & (built >= C.PAVEMENT_MIN_BUILT),
        "LR5_green_corridor": base,
        "LR6_green_roof": roof,
        "LR7_cool_morphology": base & built.between(*C.MORPHOLOGY_BUILT) & below(C.BGI_MAX_HEIGHT_M) & dry,
        "LR8_blue_infrastructure": water_side,
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def feasibility_masks(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add one boolean column per intervention."""
    rules = feasibility_columns(cells.columns)
    return cells.withColumns({k: v for k, v in rules.items() if keys is None or k in keys})


def feasible_long(cells: DataFrame, keep: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row per cell and intervention it may receive."""
    rules = feasibility_columns(cells.columns)
    chosen = F.array_compact(F.array(*[
        F.when(rule, F.lit(k)) for k, rule in rules.items() if keys is None or k in keys
    ]))
    return cells.select(*keep, F.explode(chosen).alias("intervention_key"))


def union_interventions(short: DataFrame, long: DataFrame) -> DataFrame:
    """Short-run and long-run rows in one table, marked by scope."""
    return short.withColumn("scope", F.lit("short_run")).unionByName(long.withColumn("scope", F.lit("long_run")))
