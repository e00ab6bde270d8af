"""Centroid clustering by a tournament of bisectors, in exact integer arithmetic.

For every pair of centroids i < j the bisecting plane is an integer normal and a
threshold: a vector x is strictly nearer to j when x . 2(cj - ci) > |cj|^2 - |ci|^2.
A vector walks through the centroids in their order and keeps the winner of each
test, so k - 1 sign tests find the nearest one; a zero keeps the smaller number.
Only the winner's distance is worked out.

A round is one pass over the vectors: tasks return, for each cluster, a count and
component sums, which Spark adds up; the driver holds the centroids and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from heatloom.operators.rundir import stage

#: Vectors that are tested at a time.
BLOCK = 4096
#: Bytes of pair normals that a task keeps; beyond them the normals of a step are made when it comes.
PAIR_BYTES = 64 << 20
#: Components up to this size are tested in 64-bit integers, larger ones in Python integers.
SMALL = 1 << 26
#: Largest scaled component; beyond it a long cannot hold even one difference.
LARGEST = 1 << 61


def scaled(embeddings: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and x = floor(scale * component) of the vectors with exactly ``dim`` finite components."""
    e = F.col("embedding")
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    big = F.exists(e, lambda c: F.abs(c.cast("double") * scale) >= float(LARGEST))
    x = F.when(big, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(
        F.transform(e, lambda c: F.floor(c.cast("double") * scale)))
    return embeddings.select("vec_id", "embedding").where(F.coalesce((F.size(e) == dim) & fine, F.lit(False))).select("vec_id", x.alias("x"))


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


class Tournament:
    """The bisectors of all centroid pairs."""

    def __init__(self, centroids: list[list[int]]):
        self.c = np.array(centroids, object)
        self.small = all(abs(v) <= SMALL for c in centroids for v in c)
        if self.small:
            self.c = self.c.astype(np.int64)
        self.norms = (self.c * self.c).sum(axis=1)
        k, dim = self.c.shape
        self.kept = [self._pairs(j) for j in range(1, k)] if k * k * dim * 4 <= PAIR_BYTES else None

    def _pairs(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Normals and thresholds of (0, j), ..., (j - 1, j)."""
        return 2 * (self.c[j] - self.c[:j]), self.norms[j] - self.norms[:j]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, ties to the smaller number, and the squared distance."""
        c = self.c
        if not self.small or (len(x) and np.abs(x).max() > SMALL):
            x, c = x.astype(object), c.astype(object)
        won = np.zeros(len(x), np.int64)
        for j in range(1, len(c)):
            normals, thresholds = self.kept[j - 1] if self.kept else self._pairs(j)
            side = (x * normals[won]).sum(axis=1) if x.dtype == object else np.einsum("ij,ij->i", x, normals[won])
            won[np.asarray(side > thresholds[won], bool)] = j
        d = x - c[won]
        return won, (d * d).sum(axis=1)


def cluster_sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of every non-empty cluster."""
    k, dim = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, count, sums = Tournament(centroids), np.zeros(k, np.int64), [[0] * dim for _ in range(k)]
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = rows_of(b.column(0).slice(at, BLOCK), dim)
                won, _ = t.assign(x)
                count += np.bincount(won, minlength=k)
                wide = x if np.abs(x).max() < 1 << 48 else x.astype(object)
                for j in np.unique(won):  # a block's sums fit into 64 bits, or are Python integers
                    sums[j] = [a + int(v) for a, v in zip(sums[j], wide[won == j].sum(axis=0))]
        at = np.flatnonzero(count).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at, dim)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(at))), pa.array(np.repeat(count[at], dim)),
             pa.array([Decimal(v) for j in at for v in sums[j]], pa.decimal128(38, 0))], names=["cluster", "at", "n", "s"])

    parts = vectors.select("x").mapInArrow(run, "cluster int, at int, n long, s decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()):  # at most k * dim rows
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["s"]))
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance of every vector; a distance beyond a long is NULL."""
    dim = len(centroids[0])
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tournament(centroids)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                won, d = t.assign(rows_of(part.column(1), dim))
                d = pa.array([int(v) if v < 1 << 63 else None for v in d], pa.int64()) if d.dtype == object else pa.array(d)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(won.astype(np.int32)), d], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def bisector_kmeans(
    embeddings: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept row of (vec_id, embedding).

    Kept are vectors with exactly ``dim`` components, none NULL or non-finite; each
    component x becomes floor(scale * x).  The k kept rows with the smallest
    sha256("salt:vec_id") start as centroids (NULL ids last, equal ids by their
    components; fewer rows give fewer centroids).  A round assigns every vector to the
    nearest centroid, ties to the smaller number, and moves each non-empty centroid to
    floor(sum / count); after the rounds the vectors are assigned once more.  Repeated
    rows count each.  No kept row gives an empty result.  Sums and distances are exact;
    one beyond a long is NULL, and a scaled component of 2^61 or more is an error.
    Other input columns are not read.
    """
    spark = embeddings.sparkSession
    vectors = stage(scaled(embeddings, dim, scale), "kmeans-vectors")
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.orderBy(key.asc_nulls_last(), "x").limit(k).collect()  # k rows
    schema = T.StructType([
        T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
        T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not start:
        return spark.createDataFrame([], schema)
    centroids = [list(r["x"]) for r in start]
    for _ in range(rounds):
        for j, (n, sums) in cluster_sums(vectors, centroids).items():
            centroids[j] = [s // n for s in sums]
    found = stage(assigned(vectors, centroids), "kmeans-clusters")
    totals = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    fits = lambda rs: (v if (v := sum(int(r["s"]) for r in rs)) < 1 << 63 else None) if all(r["n"] == r["rows"] for r in rs) else None
    whole = fits(totals)
    facts = [(r["cluster"], fits([r]), whole, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in totals]
    of_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select([f.name for f in schema])  # k rows
