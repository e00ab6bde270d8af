"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Iterative quantisation learns rotations after which the signs of a centred vector
are balanced bits that keep angles.  The code is cut into substrings, one table
each; vectors whose substrings are equal (or few bits apart, for long substrings)
meet in a bucket, where the original vectors decide by cosine in double precision.
A pair counts in the first table in which it meets, so nothing is counted twice and
no pair is ever a row: buckets return, per vector, how many links it has and the
least vector it is connected to.  Buckets above a block size are dealt out as pairs
of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heatloom.llm.components import connected_components
from heatloom.llm.vectors import matrix, unit, usable
from heatloom.operators.rundir import n_tasks, stage

#: Bound of the sample that rotations are learned from: distinct vectors.
SAMPLE = 8000
#: Bits of a code, over as many rotations as needed.
BITS = 128
#: Vectors of a block; buckets with more are dealt out as pairs of blocks.
BLOCK = 1024
#: Chance that a pair exactly at the threshold meets in some table, at least.
MEET = 0.98


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 40) -> np.ndarray:
    """dimensions x bits: principal directions, rotated so that signs lose least (iterative quantisation)."""
    rng = np.random.default_rng(seed)
    if len(x) > 1:
        _, vectors = np.linalg.eigh(x.T @ x)
        w = vectors[:, ::-1][:, :bits]
    else:
        w = np.eye(x.shape[1])[:, :bits]
    r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    v = x @ w
    for _ in range(rounds if len(x) > 1 else 0):
        u, _, t = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ t).T
    return w @ r


def learn_codes(sample: dict[int, np.ndarray], total: int = BITS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension: centre and projection to ``total`` bits."""
    out = {}
    for dim, x in sample.items():
        x = unit(x)
        mean = x.mean(0) if len(x) > 1 else np.zeros(dim)
        bits = min(dim, 64)
        parts = [learn_rotation(x - mean, bits, seed) for seed in range(-(-total // bits))]
        out[dim] = (mean, np.concatenate(parts, axis=1)[:, :total])
    return out


def table_plan(rows: int, threshold: float, total: int = BITS) -> tuple[int, int]:
    """(substring bits, probe radius) for buckets of about 32 vectors.

    Substrings grow with log2 of the rows; the radius is the least with which a pair
    at the threshold still meets in one of the tables with chance MEET, where each
    bit differs with chance angle / pi.
    """
    bits = int(min(24, max(8, np.ceil(np.log2(max(rows, 1) / 32)))))
    p = float(np.arccos(threshold) / np.pi)
    for radius in range(bits + 1):
        meet = sum(comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(radius + 1))
        if 1 - (1 - meet) ** (total // bits) >= MEET:
            return bits, radius
    return bits, bits


def measured_plan(rows: int, threshold: float, sample: dict[int, np.ndarray], model: dict, total: int = BITS, pairs: int = 4000) -> dict[int, tuple[int, int]]:
    """For each dimension: (substring bits, probe radius) with which pairs exactly at the threshold meet, measured on the fitted codes.

    Pairs turn sample vectors towards random directions, and towards other sample
    vectors; both kinds must meet with chance MEET over all tables together.  Of the
    widths up to that of ``table_plan``, the one with the fewest probes and
    comparisons a vector is taken.
    """
    out, most = {}, table_plan(rows, threshold, total)[0]
    for dim, x in sample.items():
        if dim < 2:
            continue
        rng = np.random.default_rng(11)
        x = unit(x)
        a = x[rng.integers(0, len(x), pairs)]
        kinds = []
        for d in (rng.normal(size=a.shape), x[rng.integers(0, len(x), pairs)]):
            d = d - (d * a).sum(axis=1, keepdims=True) * a
            length = np.sqrt((d * d).sum(axis=1, keepdims=True))
            fine = length[:, 0] > 1e-6
            if fine.any():
                b = threshold * a[fine] + np.sqrt(1 - threshold**2) * d[fine] / length[fine]
                kinds.append(_codes(a[fine], model, total) != _codes(b, model, total))
        best = None
        for bits in range(8, most + 1):
            tables = total // bits
            # of every pair, the bits that differ in the table in which it is nearest
            near = [k[:, : tables * bits].reshape(len(k), tables, bits).sum(axis=2).min(axis=1) for k in kinds]
            radius = next(r for r in range(bits + 1) if all((n <= r).mean() >= MEET for n in near))
            probes = sum(comb(bits, i) for i in range(radius + 1))
            cost = tables * probes * (1 + rows / 2**bits / 32)
            if best is None or cost <= best[0]:
                best = (cost, bits, radius)
        out[dim] = best[1:]
    return out


def _codes(x: np.ndarray, model: dict, total: int) -> np.ndarray:
    """0/1 bits of unit vectors; a dimension that was not in the sample uses its signs, repeated."""
    dim = x.shape[1]
    if dim in model:
        mean, w = model[dim]
        return ((x - mean) @ w >= 0).astype(np.uint8)
    return np.tile((x >= 0).astype(np.uint8), (1, -(-total // dim)))[:, :total]


def bucket_rows(vectors: DataFrame, model: dict, plan, total: int = BITS) -> DataFrame:
    """(label, dim, tab, bucket, home, rep, copies, code, embedding): a vector in its own bucket of every table, and in those it probes."""

    def probes(bits, radius):
        flips = [np.array(c, np.int64) for r in range(radius + 1) for c in combinations(range(bits), r)]
        return np.array([int((1 << f).sum()) if len(f) else 0 for f in flips], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(4).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                b = batch.filter(pa.array(dims == dim))
                bits, radius = plan(int(dim))
                masks = probes(bits, radius)
                code = _codes(unit(matrix(b.column(3))), model, total)
                packed = np.packbits(code, axis=1)
                codes = pa.array([r.tobytes() for r in packed], pa.binary())
                weights = 1 << np.arange(bits, dtype=np.int64)
                for t in range(total // bits):
                    own = code[:, t * bits : (t + 1) * bits].astype(np.int64) @ weights
                    for i, m in enumerate(masks):
                        n = b.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(own ^ m),
                             pa.array(np.full(n, i == 0)), b.column(1), b.column(2), codes, b.column(3)],
                            names=["label", "dim", "tab", "bucket", "home", "rep", "copies", "code", "embedding"])

    kind = vectors.schema["label"].dataType.simpleString()
    element = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("label", "rep", "copies", "embedding", F.size("embedding").alias("dim")).mapInArrow(
        run, f"label {kind}, dim int, tab int, bucket long, home boolean, rep long, copies long, code binary, embedding {element}")


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """Least index connected to each row of a symmetric link matrix."""
    root = np.arange(len(linked))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bucket_links(rows: DataFrame, threshold: float, plan) -> DataFrame:
    """(rep, links, root): per bucket and vector its links to others, copies counted, and the least vector it is connected to there."""

    def compare(rep, copies, home, block, code, x, lo, hi, tab, bits, radius):
        """Links of one bucket, or of one pair of blocks of it."""
        one = np.flatnonzero(home)
        x = unit(x)
        a = one if lo == hi else one[block[one] == lo]
        probes = np.arange(len(rep))  # every vector that looks into this bucket, at home or probing
        c = probes if lo == hi else probes[block[probes] == hi]
        pairs = [(a, c)] if lo == hi else [(a, c), (one[block[one] == hi], probes[block[probes] == lo])]
        weight = np.zeros(len(rep))
        near = np.zeros((len(rep), len(rep)), bool)
        for p, q in pairs:
            if not len(p) or not len(q):
                continue
            hit = x[p] @ x[q].T >= threshold
            hit &= rep[p][:, None] < rep[q][None, :]  # each pair from its smaller vector's home
            i, j = np.nonzero(hit)
            i, j = p[i], q[j]
            near[i, j] = near[j, i] = True
            first = np.ones(len(i), bool)
            for t in range(tab):
                s = slice(t * bits, (t + 1) * bits)
                first &= (code[i, s] != code[j, s]).sum(axis=1) > radius
            weight += np.bincount(i[first], weights=copies[j[first]], minlength=len(rep))
            weight += np.bincount(j[first], weights=copies[i[first]], minlength=len(rep))
        return weight, near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, b in runs_of(batches, ["label", "dim", "tab", "bucket", "lo", "hi"]):
            if b.num_rows < 2:
                continue
            rep = b.column("rep").to_numpy()
            order = np.argsort(rep, kind="stable")
            b = b.take(pa.array(order))
            rep = rep[order]
            code = np.unpackbits(np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(rep), -1), axis=1)
            weight, near = compare(
                rep, b.column("copies").to_numpy().astype(float), b.column("home").to_numpy(zero_copy_only=False),
                b.column("block").to_numpy(), code, matrix(b.column("embedding")), key[4], key[5], key[2], *plan(int(key[1])))
            at = np.flatnonzero(near.any(axis=1))
            if not len(at):
                continue
            root = _local_roots(near[np.ix_(at, at)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[at]), pa.array(weight[at].astype(np.int64)), pa.array(rep[at][root])], names=["rep", "links", "root"])

    keys = ["label", "dim", "tab", "bucket", "lo", "hi"]
    return rows.repartition(n_tasks(rows), *keys).sortWithinPartitions(*keys).select(
        *keys, "block", "home", "rep", "copies", "code", "embedding").mapInArrow(run, "rep long, links long, root long")


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of one key after the other, from batches sorted by the key."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [b.num_rows]])
        for s, e in zip(starts[:-1], starts[1:]):
            key = tuple(c[s] for c in cols)
            if held and key != at:
                yield at, _joined(held)
                held = []
            at = key
            held.append(b.slice(s, e - s))
    if held:
        yield at, _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def near_duplicates(
    embeddings: DataFrame, threshold: float = 0.93, sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Vectors are linked when their labels are equal and not NULL, their dimensions
    equal, and their cosine is at least the threshold; every reported link is
    checked in double precision.  n_links counts other rows, so copies count each;
    component_id is the smallest vec_id reachable; kept means it is the row's own.
    Unusable vectors (NULL, zero, empty, or with NULL or non-finite components) and
    rows with a NULL label or vec_id have no link and are their own component.
    Pairs are found with a chance of at least MEET at the threshold, and nearly
    surely above it.  Other input columns are not read.
    """
    rows = embeddings.select("vec_id", "embedding", "label")
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable()
    unique = stage(
        rows.where(fine).groupBy("label", "embedding").agg(
            F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    largest = unique.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    drawn = unique.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    dims = drawn.value_lengths().to_numpy(zero_copy_only=False) if len(drawn) else np.zeros(0, int)
    drawn = {int(d): matrix(drawn.filter(pa.array(dims == d))) for d in np.unique(dims)}
    model = learn_codes(drawn)
    known, other = measured_plan(int(largest), threshold, drawn, model), table_plan(int(largest), threshold)
    plan = lambda dim: known.get(dim, other)
    dealt = bucket_rows(unique, model, plan)
    keys = ["label", "dim", "tab", "bucket"]
    big = stage(dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(
        *[F.col(k).alias("_" + k) for k in keys], F.ceil(F.col("n") / block).cast("int").alias("blocks")), "big-buckets")
    same = [F.col(k) == F.col("_" + k) for k in keys]
    blocks = F.coalesce("blocks", F.lit(1))
    placed = (
        dealt.join(big, same[0] & same[1] & same[2] & same[3], "left")
        .withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        .drop("_label", "_dim", "_tab", "_bucket", "blocks", "other")
    )
    found = stage(bucket_links(placed, threshold, plan), "bucket-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = unique.select(F.col("label").alias("_label"), F.col("embedding").alias("_e"), "rep", "copies")
    named = named.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    good = rows.where(fine).join(named, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_e")))
    good = good.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("root", "rep").alias("component_id"))
    rest = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return good.unionAll(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
