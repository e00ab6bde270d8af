"""Readers of cell tables and lookup tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from heatloom import constants as C, schemas
from heatloom.functions.raster import missing_if_nodata
from heatloom.operators.summaries import assert_valid, validate_bands

DATA = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "data")


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, comment="#")



def _local_rows(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """Rows of a packaged table.  Read on the driver, as executors need not have the package's files."""
    with open(os.path.join(DATA, name), encoding="utf-8") as f:
        lines = [ln.rstrip("\n").split(",") for ln in f if ln.strip() and not ln.startswith("#")][1:]
    cast = {"double": float, "int": int, "bigint": int, "string": str}
    kinds = [cast[f.dataType.simpleString()] for f in schema.fields]
    rest = [None] * len(schema.fields)  # columns that the packaged table does not state
    return spark.createDataFrame([tuple([k(v) for k, v in zip(kinds, row)] + rest[len(row):]) for row in lines], schema)


def read_indicator_cells(
    spark: SparkSession,
    path: str,
    bands: Sequence[str] = tuple(C.INDICATORS),
    nodata: float = C.NODATA,
    newest: bool = False,
    glob: str | None = None,
    validate: bool = False,
    by: Sequence[str] = ("aoi_id",),
) -> DataFrame:
    """Cell table with fill values and NaN turned into missing values.

    All bands must be there.  ``glob`` limits the files; ``newest`` keeps the file
    changed last.  Only keys and bands are read.
    """
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    df = reader.parquet(path)
    absent = [b for b in bands if b not in df.columns]
    if absent:
        raise ValueError(f"{len(bands)} bands are needed, missing: {absent}")
    if newest:
        last = df.select(F.max_by("_metadata.file_path", "_metadata.file_modification_time")).first()[0]
        df = df.where(F.col("_metadata.file_path") == last)
    keys = [c for c in ("aoi_id", "cell_id", "row", "col", "lon", "lat") if c in df.columns]
    out = df.select(*keys, *[missing_if_nodata(F.col(b), nodata).cast("double").alias(b) for b in bands])
    if validate:
        assert_valid(validate_bands(out, by))
    return out


def read_scene_table(spark: SparkSession, path: str) -> DataFrame:
    """Scene pixels of ``write_scene_table``, with scene_year and scene_month as partition columns."""
    return spark.read.parquet(path)


def read_cdr_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Crude death rates per country."""
    return _csv(spark, path, schemas.CDR) if path else _local_rows(spark, "cdr.csv", schemas.CDR)


def read_beta_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Mortality slopes per climate zone."""
    return _csv(spark, path, schemas.BETA) if path else _local_rows(spark, "beta.csv", schemas.BETA)


def read_intervention_params(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Parameter triples of the interventions, one row per parameter.

    Citation, evidence level and notes are read from a user's file; the packaged table
    does not state them (NULL).
    """
    if path:
        columns = schemas.INTERVENTIONS.names
        raw = spark.read.csv(path, header=True, comment="#", quote='"', escape='"', multiLine=True)
        kinds = {f.name: f.dataType for f in schemas.INTERVENTIONS.fields}
        return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
    return _local_rows(spark, "interventions.csv", schemas.INTERVENTIONS)


def intervention_library(params: DataFrame) -> DataFrame:
    """One row per intervention with its parameters as a map from name to triple."""
    triple = F.struct("value_min", "value_mode", "value_max")
    return params.groupBy("intervention_key", "scope").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter_name", triple.alias("v"))))).alias("parameters")
    )


def read_indicator_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Indicator metadata, one row per indicator; attributes that an entry does not state are NULL."""
    if path:
        raw = spark.read.json(path, schema=schemas.REGISTRY, multiLine=True)
    else:
        with open(os.path.join(DATA, "registry.json"), encoding="utf-8") as f:
            text = f.read()
        raw = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", schemas.REGISTRY).alias("r")).select("r.*")
    return registry_flatten(raw)


def registry_flatten(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("indicators").alias("indicator", "_m")).select("indicator", "_m.*")


def read_cmip6_delta_grid(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Warming per grid centre for two scenarios, with bands and a row number.

    The rows are numbered by latitude and longitude of the centre in a file of the
    user's; the packaged table keeps its order. The number decides ties between centres.
    """
    schema = T.StructType([T.StructField("grid_id", T.IntegerType()), *schemas.CMIP6_DELTA.fields])
    if path is None:
        rows = _local_rows(spark, "cmip6_delta.csv", schemas.CMIP6_DELTA).collect()  # the packaged table
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    order = W.orderBy("lat_center", "lon_center", *schemas.CMIP6_DELTA.names[2:])
    grid = _csv(spark, path, schemas.CMIP6_DELTA)
    return grid.select((F.row_number().over(order) - 1).alias("grid_id"), *schemas.CMIP6_DELTA.names)
