"""Band arithmetic on scene pixels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from heatloom import constants as C
from heatloom.functions.basic import clamp


def strict_clear(qa: Column) -> Column:
    """Neither dilated cloud, cloud nor cloud shadow."""
    return qa.bitwiseAND(C.QA_STRICT_BITS) == 0


def relaxed_clear(qa: Column) -> Column:
    """No cloud; cloud edges and shadows are kept."""
    return qa.bitwiseAND(C.QA_CLOUD_BIT) == 0


def scl_clear(scl: Column) -> Column:
    return ~scl.isin(C.S2_SCL_MASK)


def surface_reflectance(dn: Column) -> Column:
    return dn * C.LANDSAT_SR_SCALE + C.LANDSAT_SR_OFFSET


def surface_temperature_c(dn: Column) -> Column:
    return dn * C.LANDSAT_ST_SCALE + C.LANDSAT_ST_OFFSET - C.KELVIN


def broadband_albedo(bands: dict[str, Column]) -> Column:
    """Albedo of one pixel from scaled reflectances."""
    total = F.lit(C.ALBEDO_INTERCEPT)
    for name, coef in C.ALBEDO_COEFFS.items():
        total = total + bands[name] * coef
    return total


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def effective_tree_cover(cover: Column, loss_year: Column, year: Column) -> Column:
    """Tree cover, 0 where it was lost up to the analysis year."""
    last = F.least(year - 2000, F.lit(C.HANSEN_LAST_LOSS_YEAR))
    return F.when(loss_year.between(F.lit(1), last), 0.0).otherwise(cover)


def nightlight(maximum: Column, avg_rad: Column) -> Column:
    return clamp(F.coalesce(maximum, avg_rad), 0.0, 200.0)


def built_fraction(surface_m2: Column) -> Column:
    return clamp(surface_m2 / C.GHS_CELL_AREA_M2, 0.0, 1.0)


def missing_if_nodata(c: Column, *nodata: float) -> Column:
    """NULL for NaN and for the fill values."""
    return F.when(~F.isnan(c.cast("double")) & ~c.isin(*(nodata or C.NODATA_SENTINELS)), c)
