"""Embedding whitening through the singular values of the centred vectors.

The covariance is never formed.  Tasks reduce the centred rows to triangular factors,
block by block, and the factors of tasks are stacked and reduced again until one is
left.  On the driver this small triangle is made bidiagonal by Householder reflections;
the differential qd algorithm with shifts (dqds) finds its singular values to high
relative accuracy, and twisted factorisations give the directions of the largest ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from heatloom.operators.rundir import stage

EPS = float(np.finfo(np.float64).eps)
#: Rows of a block that is reduced at a time.
BLOCK = 4096
#: Triangular factors that one task stacks.
FAN_IN = 32


# --- the small triangle, on the driver ---

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right transformation v of u.T @ r @ v, upper bidiagonal, by Householder reflections."""
    a = np.array(r, np.float64)
    n = a.shape[1]
    v = np.eye(n)

    def mirror(x):
        w = x.copy()
        w[0] += np.copysign(np.sqrt(x @ x), x[0])
        length = w @ w
        return w, 2.0 / length if length > 0 else 0.0

    for i in range(n):
        w, f = mirror(a[i:, i])
        a[i:, i:] -= np.outer(f * w, w @ a[i:, i:])
        if i < n - 2:
            w, f = mirror(a[i, i + 1 :])
            a[i:, i + 1 :] -= np.outer(a[i:, i + 1 :] @ w, f * w)
            v[:, i + 1 :] -= np.outer(v[:, i + 1 :] @ w, f * w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd transform with a shift; None where the shift passes the least eigenvalue."""
    d = q[0] - shift
    if d < 0:
        return None
    new_q, new_e = [], []
    for i, off in enumerate(e):
        p = d + off
        t = q[i + 1] / p
        new_q.append(p)
        new_e.append(off * t)
        d = d * t - shift
        if not d >= 0:
            return None
    return new_q + [d], new_e


def _shift(q: list[float], e: list[float]) -> float:
    """A lower bound of the least eigenvalue, from the diagonal less its neighbours, and close to it when the end has nearly come off."""
    a, b = np.sqrt(q), np.sqrt(np.concatenate([[0.0], e, [0.0]]))
    return max(0.0, float((a - 0.5 * (b[:-1] + b[1:])).min())) ** 2


def dqds(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Squared singular values, falling, of the upper bidiagonal matrix with diagonal a and superdiagonal b."""
    top = max(float(np.abs(a).max()), float(np.abs(b).max()) if len(b) else 0.0) if len(a) else 0.0
    if top == 0:
        return np.zeros(len(a))
    out = []
    work = [([float(x) for x in (a / top) ** 2], [float(x) for x in (b / top) ** 2], 0.0, 0)]
    while work:
        q, e, moved, seen = work.pop()
        n = len(q)
        if n == 1:
            out.append(moved + q[0])
            continue
        cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * (moved + q[i]) or e[i] <= EPS * EPS * (moved + q[i + 1]) or e[i] < 1e-290), None)
        if cut is not None:
            work.append((q[: cut + 1], e[:cut], moved, 0))
            work.append((q[cut + 1 :], e[cut + 1 :], moved, 0))
            continue
        if seen > rounds + 10 * n:
            raise ArithmeticError("dqds does not converge")
        if 1.5 * q[0] < q[-1]:  # large values first, so that small ones come off at the end
            q, e = _reversed(q, e)
        shift = _shift(q, e)
        while (new := _qd_step(q, e, shift)) is None:
            shift = shift * 0.25 if shift > 1e-3 * q[-1] else 0.0
        work.append((*new, moved + shift, seen + 1))
    return np.sort(np.array(out))[::-1] * top * top


def _reversed(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array of the same eigenvalues, seen from the other end."""
    return q[::-1], e[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float, spare: int = 0) -> tuple[np.ndarray, float]:
    """Eigenvector of B'B for a value by the twisted factorisation with the (spare + 1)-th least pivot, and the value's correction."""
    n = len(a)
    q, e, ab = a * a, b * b, a[:-1] * b
    tiny = np.finfo(np.float64).tiny / EPS
    safe = lambda x: x if abs(x) > tiny else tiny
    s, lower = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        d = safe(s[i] + q[i])
        lower[i] = ab[i] / d
        s[i + 1] = e[i] * (s[i] / d) - value
    p, upper = np.empty(n), np.empty(max(n - 1, 0))
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        d = safe(e[i] + p[i + 1])
        upper[i] = ab[i] / d
        p[i] = p[i + 1] * (q[i] / d) - value
    pivot = s + p + value
    at = int(np.argsort(np.abs(np.nan_to_num(pivot, nan=np.inf)), kind="stable")[min(spare, n - 1)])
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -upper[i] * z[i]
    length = float(z @ z)
    return z / np.sqrt(length), float(pivot[at]) / length


def leading_directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of r'r, falling, their unit eigenvectors as columns, and the sum of all eigenvalues.

    Eigenvalues at rounding level are 0 and have no vector (a column of zeros).  The
    largest component of a vector is positive.
    """
    dim = r.shape[1]
    a, b, v = bidiagonal(r)
    values = dqds(a, b)
    total, k = float(values.sum()), min(k, dim)
    values = np.where(values > (EPS * dim) ** 2 * max(values[0], 0.0) if dim else False, values, 0.0)
    # a superdiagonal at rounding level separates blocks, whose vectors have no entry in common
    top = np.sqrt(values[0]) if dim else 0.0
    ends = np.concatenate([np.flatnonzero(np.abs(b) <= EPS * top) + 1, [dim]]).astype(int)
    found: list[tuple[float, np.ndarray]] = []
    lo = 0
    for hi in ends:
        own = dqds(a[lo:hi], b[lo : hi - 1])
        own = own[own > (EPS * dim) ** 2 * values[0]][:k]
        vectors: list[np.ndarray] = []
        for i, value in enumerate(own):
            close = [vectors[j] for j in range(i) if own[j] - value <= 1e-3 * own[j]]
            z = _apart(a[lo:hi], b[lo : hi - 1], float(value), close)
            vectors.append(z)
            whole = np.zeros(dim)
            whole[lo:hi] = z
            found.append((float(value), whole))
        lo = hi
    found.sort(key=lambda x: -x[0])
    out, lead = np.zeros((dim, k)), np.zeros(k)
    for i, (value, z) in enumerate(found[:k]):
        x = v @ z
        x /= np.sqrt(x @ x)
        out[:, i], lead[i] = x * np.sign(x[np.abs(x).argmax()]), value
    return lead, out, total


def _apart(a: np.ndarray, b: np.ndarray, value: float, close: list[np.ndarray]) -> np.ndarray:
    """The vector of a value, orthogonal to those of values that nearly equal it."""
    best = None
    for spare in range(len(close) + 1):
        at = value
        for _ in range(3):
            z, change = twisted(a, b, at, spare)
            if not close:
                at += change
            if abs(change) <= EPS * value:
                break
        for _ in range(2):
            for y in close:
                z = z - (z @ y) * y
        left = float(np.sqrt(z @ z))
        if left > 0:
            z = z / left
            bz = a * z
            bz[:-1] += b * z[1:]
            tz = a * bz
            tz[1:] += b * bz[:-1]
            miss = float(np.abs(tz - value * z).max())
            if best is None or miss < best[0]:
                best = (miss, z)
    return best[1]


# --- the rows, on Spark ---

def _ints(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def _by_dim(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of rows whose vectors have one length."""
    for b in batches:
        size = b.column(col).value_lengths().to_numpy(zero_copy_only=False) if b.num_rows else np.zeros(0, int)
        for dim in np.unique(size):
            part = b if (size == dim).all() else b.filter(pa.array(size == dim))
            for at in range(0, part.num_rows, BLOCK):
                yield int(dim), part.slice(at, BLOCK)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums, exact wherever it is below 2^62 (64-bit products wrap, the difference does not), and as float."""
    about = x.astype(np.float64) * n - np.array(sums, np.float64)
    wrapped = np.array([((s + (1 << 63)) % (1 << 64)) - (1 << 63) for s in sums], np.int64)
    with np.errstate(over="ignore"):
        exact = x * np.int64(n) - wrapped
    return exact, np.where(np.abs(about) < 2.0**62, exact.astype(np.float64), about)


def _deviation(exact: np.ndarray, about: np.ndarray, x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of squares of each row of n * x - sums; NULL beyond a long."""
    size = (about * about).sum(axis=1)
    out = np.where(size < 2.0**62, (exact * exact).sum(axis=1), 0)
    values: list = out.tolist()
    for i in np.flatnonzero(size >= 2.0**62):
        whole = sum((n * int(c) - s) ** 2 for c, s in zip(x[i], sums)) if size[i] < 2.0**64 else 1 << 64
        values[i] = whole if whole < 1 << 63 else None
    return pa.array(values, pa.int64())


def _dimension_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each vector length: distinct vectors and their component sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for dim, b in _by_dim(batches, 0):
            x = _ints(b.column(0), dim)
            n, hi, lo = held.get(dim, (0, 0, 0))
            held[dim] = (n + len(x), hi + (x >> 32).sum(axis=0), lo + (x & 0xFFFFFFFF).sum(axis=0))
        for dim, (n, hi, lo) in held.items():
            at = np.arange(dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dim, dim, np.int32)), pa.array(at), pa.array(np.full(dim, n)), pa.array(hi), pa.array(lo)],
                names=["dim", "at", "n", "hi", "lo"])

    parts = fit.mapInArrow(run, "dim int, at int, n long, hi long, lo long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), wide("hi"), wide("lo")).orderBy("dim", "at").collect():  # dim rows for each length
        out.setdefault(r["dim"], (r["n"], []))[1].append((int(r["hi"]) << 32) + int(r["lo"]))
    return out


def _triangles(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each vector length the triangular factor of the centred rows, by reduction in levels of FAN_IN factors."""

    def reduced(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.concatenate([r, rows]), mode="r")

    def batch(dim: int, at: int, r: np.ndarray) -> pa.RecordBatch:
        square = np.zeros((dim, dim))
        square[: len(r)] = r
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([at], pa.int64()), pa.array([square.ravel()], pa.list_(pa.float64()))], names=["dim", "at", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for dim, b in _by_dim(batches, 0):
            n, s = sums[dim]
            _, c = _centred(_ints(b.column(0), dim), n, s)
            held[dim] = reduced(held.get(dim, np.zeros((0, dim))), c / n)
        for dim, r in held.items():
            yield batch(dim, TaskContext.get().partitionId(), r)

    def merge(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        r = np.zeros((0, dim))
        for part in t.sort_by("at").column("r"):
            r = reduced(r, np.array(part.as_py(), np.float64).reshape(dim, dim))
        return pa.Table.from_batches([batch(dim, t.column("at")[0].as_py() // FAN_IN, r)])

    schema = "dim int, at long, r array<double>"
    level = stage(fit.mapInArrow(run, schema), "whitening-triangles")
    while (level.agg(F.max("at")).first()[0] or 0) > 0:
        merged = level.groupBy("dim", F.floor(F.col("at") / FAN_IN).alias("part")).applyInArrow(merge, schema)
        level = stage(merged, "whitening-triangles")
    return {r["dim"]: np.array(r["r"]).reshape(r["dim"], r["dim"]) for r in level.collect()}  # one factor for each length


def _whitened(about: np.ndarray, n: int, value: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Projections of centred rows over the deviation of each direction; NaN for a direction without variance."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(value > 0, (about / n) @ vectors / np.sqrt(value), np.nan)


def whiten(embeddings: DataFrame, k: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: k rows for every kept row of (vec_id, embedding).

    Rows whose vector is NULL or holds NULL or non-finite entries are left out; each
    entry c of the others becomes x = floor(scale * c).  Statistics are over the
    distinct x vectors: n of them, with component sums S.  Components are the unit
    eigenvectors of x's covariance (divisor n), numbered from 1 by falling eigenvalue e;
    there are no more than a vector has entries.  deviation is the sum of (n x - S)^2,
    exact, NULL beyond a long.  whitened is (x - S/n) on the component over sqrt(e),
    explained is e over the trace; for a component without variance whitened is NULL and
    explained 0 (NULL if there is no variance at all).  identity_error is the largest
    entry of whitened's covariance over the distinct vectors less the identity, over
    components with variance (NULL if there is none).  Vectors of different lengths are
    separate fits; identity_error is then the largest of all.  Repeated rows and NULL
    ids are kept; an empty vector has no component; an empty table gives no row; other
    input columns are not read.
    """
    spark = embeddings.sparkSession
    e = F.col("embedding")
    fine = F.coalesce(F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & (F.size(e) > 0), F.lit(False))
    rows = embeddings.select("vec_id", "embedding").where(fine).select(
        "vec_id", F.transform(e, lambda c: F.floor(c.cast("double") * scale)).alias("x"))
    fit = stage(rows.select("x").distinct(), "whitening-fit")
    sums = _dimension_sums(fit)
    models = {}
    for dim, r in _triangles(fit, sums).items():
        n = sums[dim][0]
        value, vectors, total = leading_directions(r / np.sqrt(n), k)
        models[dim] = (n, sums[dim][1], value, vectors, total)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for dim, b in _by_dim(batches, 0):
            n, s, value, vectors, _ = models[dim]
            w = np.nan_to_num(_whitened(_centred(_ints(b.column(0), dim), n, s)[1], n, value, vectors))
            held[dim] = held.get(dim, 0) + w.T @ w / n
        for dim, m in held.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m.size, dim, np.int32)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], names=["dim", "i", "j", "v"])

    cells = fit.mapInArrow(spread, "dim int, i long, j long, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect()  # k * k a length
    misses = [abs(r["v"] - (r["i"] == r["j"])) for r in cells if models[r["dim"]][2][r["i"]] > 0 and models[r["dim"]][2][r["j"]] > 0]
    error = max(misses, default=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in _by_dim(batches, 1):
            n, s, value, vectors, total = models[dim]
            x = _ints(b.column(1), dim)
            exact, about = _centred(x, n, s)
            w = _whitened(about, n, value, vectors)
            m = len(value)
            share = [float(v / total) if total > 0 else None for v in value]
            at = pa.array(np.repeat(np.arange(len(x)), m))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * m, n)),
                 _deviation(exact, about, x, n, s).take(at), pa.array(w.ravel(), from_pandas=True), pa.array(share * len(x), pa.float64()),
                 pa.array([error] * (len(x) * m), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
