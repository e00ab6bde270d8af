"""Codes, zones and other label expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from heatloom import constants as C


def intervention_code(key: Column) -> Column:
    """Code of an intervention key, taken from the part before the first underscore."""
    codes = F.create_map(*[F.lit(x) for pair in C.INTERVENTION_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.split(key, "_")[0]), F.lit(0))


def code_to_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in C.INTERVENTION_CODES.items() for x in (v, k)])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("unknown"))


def long_run_key(k: Column) -> Column:
    """Key of the k-th long-run intervention, counted from 1."""
    return F.get(F.array(*[F.lit(x) for x in C.LONG_RUN_KEYS]), k - 1)


def size_mode(n_cells: Column) -> Column:
    return (
        F.when(n_cells <= C.MOORE_MAX_CELLS, "moore")
        .when(n_cells <= C.DIRECT_MAX_CELLS, "direct")
        .when(n_cells <= C.MESO_MAX_CELLS, "meso")
        .otherwise("hierarchical")
    )


def koppen_zone(lat: Column) -> Column:
    """Climate zone letter from the absolute latitude."""
    out = None
    for limit, letter in C.KOPPEN_LIMITS:
        test = F.abs(lat) < limit
        out = F.when(test, letter) if out is None else out.when(test, letter)
    return out.otherwise("E")


def iso3_from_point(lat: Column, lon: Column) -> Column:
    """Country of a point by the first matching latitude-longitude box, else UNKNOWN."""
    out = None
    for lat0, lat1, lon0, lon1, iso3 in C.ISO3_BOXES:
        test = lat.between(lat0, lat1) & lon.between(lon0, lon1)
        out = F.when(test, iso3) if out is None else out.when(test, iso3)
    return out.otherwise("UNKNOWN")
