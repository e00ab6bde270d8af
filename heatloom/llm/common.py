"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of text that one numpy step works on.
CHUNK_CHARS = 1 << 18
#: Rows whose texts are Python strings at a time.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; NULL counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_text(col: str) -> Column:
    return F.col(col).cast("string")


def random_key(col: str) -> Column:
    """A key that orders rows by the hash of their id, the same in every run and SQL engine."""
    return F.md5(F.coalesce(id_text(col), F.lit("")).cast("binary"))


def fold(col: str, folds: int) -> Column:
    """crc32(id as text) mod folds; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_text(col), F.lit("")).cast("binary")), F.lit(folds))


def chunks(texts: list, most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) pieces of a batch with bounded characters each; a longer text stands alone."""
    start, size, out = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if out and size + len(t) > most:
            yield start, out
            start, size, out = i, 0, []
        out.append(t)
        size += len(t)
    if out:
        yield start, out


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of batches in small ones, so that few texts are held as Python strings."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand at most ``rows`` rows at a time to Python.

    Spark's own batches of whole texts or tokens take tens of MB of each executor outside
    its heap, and as much again of each Python worker.  A smaller setting stays.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(setting, rows)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def training_labels(labels: DataFrame, label: str, folds: int = 5) -> DataFrame:
    """(doc_id, y) of all training labels: ids in fold 0, without a label or with contradicting labels never train."""
    return (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != 0))
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y_max"))
        .where("y = y_max").select("doc_id", F.col("y").cast("int").alias("y"))
    )


def labelled_sample(labels: DataFrame, label: str, per_class: int, folds: int = 5) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` training ids of each class (a bounded sample), and the class counts of all training labels.

    The sample takes the ids with the smallest hash, so reruns agree.
    """
    known = training_labels(labels, label, folds)
    counts = {int(r["y"]): int(r["n"]) for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("y") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    return parts[0].unionAll(parts[1]), counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def logit(p: float) -> float:
    return float(np.log(p / (1.0 - p)))


def filter_texts(docs: DataFrame, keep: Callable[[list], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text ``keep`` accepts, all columns as they are; one pass, no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(keep(b.column(b.schema.get_field_index("text")).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, for tables that are costly to build; never for results."""
    import sys
    import types

    return sys.modules.setdefault("_heatloom_worker_store", types.ModuleType("_heatloom_worker_store")).__dict__
