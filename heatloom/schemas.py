"""Declared schemas of the main tables."""

from __future__ import annotations

from pyspark.sql import types as T

from heatloom import constants as C

CELL_KEYS = "aoi_id int, cell_id bigint, row int, col int, lon double, lat double"


_TYPES = {
    "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "string": T.StringType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
}


def _schema(columns: str) -> T.StructType:
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CELLS = _schema(CELL_KEYS + ", " + ", ".join(f"{c} double" for c in C.INDICATORS))
SCENE_PIXELS = _schema(
    "sensor string, scene_id bigint, ts timestamp, cloud_cover double, aoi_id int, cell_id bigint, qa_pixel int, "
    "st_b10 double, sr_b2 double, sr_b4 double, sr_b5 double, sr_b6 double, sr_b7 double, "
    "scl int, b4 double, b8 double, b11 double"
)
FORECAST = _schema("aoi_id int, valid_time timestamp, run_time timestamp, t2m_c double, rh_pct double")
MONTHLY_CLIMATE = _schema(
    "aoi_id int, year int, month int, temperature_2m double, dewpoint_temperature_2m double"
)
DECISIONS = _schema("solution_id bigint, zone_id int, k int, intervention_key string, qty double")
BETA = _schema("climate_zone string, koppen_description string, beta_per_degC double, n_locations int")
CDR = _schema(
    "country_iso3 string, country_name string, region string, income_group string, "
    "cdr_per_person_per_year double, year int"
)
INTERVENTIONS = _schema(
    "intervention_key string, intervention_name string, scope string, parameter_group string, "
    "parameter_name string, value_min double, value_mode double, value_max double, "
    "primary_citation string, evidence_level string, notes string"
)
CMIP6_DELTA = _schema(
    "lat_center double, lon_center double, d245 double, d245_p10 double, d245_p90 double, "
    "d585 double, d585_p10 double, d585_p90 double"
)
REGISTRY_ENTRY = _schema(
    "sub_index string, direction string, native_resolution_m int, output_resolution_m int, "
    "temporal_tier int, temporal_range_start int, composite_method string, "
    "name string, temporal_range_end string, update_frequency string, gee_collection string, gee_collection_l9 string, "
    "band_name string, formula string, scale_factor double, add_offset double, automatable boolean, status string, "
    "citation string, notes string"
)
REGISTRY = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("indicators", T.MapType(T.StringType(), REGISTRY_ENTRY)),
])
