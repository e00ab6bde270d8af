"""Whitening and bisector clustering against brute force."""

import hashlib
import math

import helpers as H
import numpy as np
import pytest

from heatloom.llm import bisector_kmeans as bk, qd_whitening as qd, queries

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster string, n string, dim string, at string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, *["x"] * 6) for r in rows], SCHEMA)


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) @ np.diag(np.linspace(0.3, 2, dim)) + 0.5
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def odd(dim):
    return [(None, [0.25] * dim), (900, None), (901, []), (902, [NAN] + [1.0] * (dim - 1)), (903, [INF] * dim), (904, [None] + [1.0] * (dim - 1)),
            (905, [0.0] * dim), (906, [-0.0] * dim), (3, [0.25] * dim), (3, [0.25] * dim)]


# --- operator 11 ---

def fine(e):
    return e is not None and len(e) > 0 and all(v is not None and math.isfinite(v) for v in e)


def brute_whitening(rows, k=4):
    """{length: (fit n, x by row, deviation by row, eigenvalues, vectors, trace)} with numpy's own eigensolver and Python integers."""
    kept = [(i, tuple(math.floor(256 * float(c)) for c in e)) for i, e in rows if fine(e)]
    out = {}
    for dim in {len(x) for _, x in kept}:
        own = [(i, x) for i, x in kept if len(x) == dim]
        fit = sorted({x for _, x in own})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        c = np.array([[float(n * a - b) / n for a, b in zip(x, s)] for x in fit])
        w, v = np.linalg.eigh(c.T @ c / n)
        out[dim] = (n, s, own, w[::-1], v[:, ::-1], w.sum())
    return out


@pytest.mark.parametrize("n, dim", [(300, 12), (3, 12), (1, 5), (60, 2)])
def test_whitening(spark, n, dim):
    rows = vectors(n, dim) + (odd(dim) if n > 1 else [])
    got = [tuple(r) for r in qd.whiten(frame(spark, rows).repartition(7)).collect()]
    want = brute_whitening(rows)[dim]
    fit_n, s, own, w, v, trace = want
    m = min(4, dim)
    assert len(got) == m * len(own)
    signs, by_component = {}, {}
    for i, x in own:
        found = [r for r in got if r[0] == i]
        dev = sum((fit_n * a - b) ** 2 for a, b in zip(x, s))
        assert dev in [r[3] for r in found] and all(r[2] == fit_n for r in found)
        assert sorted({r[1] for r in found}) == list(range(1, m + 1))
    for i, component, _, dev, white, explained, error in got:
        j = component - 1
        if w[j] <= 1e-9 * max(w[0], 1e-300):
            assert white is None and not explained
            continue
        assert abs(explained - w[j] / trace) <= 1e-9 and error < 1e-9
        options = [(np.array([a - b / fit_n for a, b in zip(x, s)]) @ v[:, j]) / math.sqrt(w[j]) for k, x in own if k == i]
        if len(set(options)) == 1 and abs(options[0]) > 1e-6:
            by_component.setdefault(j, set()).add(round(white / options[0], 6))
    assert all(len(x) == 1 and abs(next(iter(x))) == 1 for x in by_component.values()) and (n == 1 or by_component)


def test_whitening_of_nothing_and_of_mixed_lengths(spark):
    assert qd.whiten(frame(spark, [])).count() == 0
    assert qd.whiten(frame(spark, [(1, None), (2, []), (3, [NAN])])).count() == 0
    rows = vectors(50, 6) + [(100 + i, e) for i, e in vectors(40, 3, 2)] + [(500, [7.0])]
    got = qd.whiten(frame(spark, rows)).collect()
    assert len(got) == 50 * 4 + 40 * 3 + 1 and {r["n"] for r in got} == {50, 40, 1}
    assert [r["whitened"] for r in got if r["vec_id"] == 500] == [None]
    assert max(r["identity_error"] for r in got) < 1e-9


def test_long_deviations_are_exact_or_null(spark):
    rows = [(i, [float(2**k) for k in (20, 30, 0)]) for i in range(1)] + [(1, [0.0, 0.0, 1.0]), (2, [2.0**20, 1.0, -3.0]), (3, [2.0**24, 2.0**23, 5.0])]
    got = {r["vec_id"]: r["deviation"] for r in qd.whiten(frame(spark, rows)).collect()}
    n, s, own, *_ = brute_whitening(rows)[3]
    for i, x in own:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        assert got[i] == (dev if dev < 2**63 else None)
    assert None in got.values()


def spectra():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    for d in (1, 2, 3, 64, 150):
        yield np.triu(rng.normal(size=(d, d)))
    yield np.eye(10)
    yield np.zeros((5, 5))
    yield np.linalg.qr(rng.normal(size=(500, 64)) @ np.diag(np.logspace(0, -8, 64)), mode="r")
    yield np.linalg.qr(np.vstack([rng.normal(size=(3, 20)), np.zeros((30, 20))]), mode="r")
    for s in ([5] * 10 + [1] * 54, list(5 + 1e-9 * np.arange(6)) + [1] * 58, list(5 + 1e-4 * rng.normal(size=20)) + [1] * 44, [3, 1] + [0] * 62):
        yield np.linalg.qr(np.diag(np.array(s, float)) @ turn, mode="r")
    wilkinson = np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield np.linalg.cholesky(wilkinson + 5 * np.eye(21)).T


def test_singular_values_and_directions():
    """Random, graded, rank-deficient, repeated and clustered spectra."""
    for r in spectra():
        want = np.linalg.svd(r, compute_uv=False)
        top = max(want[0], 1e-300)
        a, b, v = qd.bidiagonal(r)
        assert np.abs(v.T @ v - np.eye(len(v))).max() < 1e-13
        assert np.abs(np.sqrt(qd.dqds(a, b)) - want).max() <= 1e-14 * top * len(want)
        values, vectors, total = qd.leading_directions(r, 4)
        k = int((values > 0).sum())
        assert k == min(4, int((want > 1e-12 * top).sum() if want[0] else 0)) and abs(total - (want**2).sum()) <= 1e-12 * top**2 * len(want)
        x = vectors[:, :k]
        assert k == 0 or np.abs(x.T @ x - np.eye(k)).max() < 1e-12
        assert k == 0 or np.abs(r.T @ (r @ x) - x * values[:k]).max() < 1e-12 * top**2


def test_small_singular_values_keep_their_digits():
    """dqds is accurate relative to every value, which an eigensolver of B'B is not."""
    a, b = 10.0 ** -np.arange(0, 12), 10.0 ** -np.arange(0, 11) * 0.3
    values = np.sqrt(qd.dqds(a, b))
    assert abs(np.prod(values / a) - 1) < 1e-12  # their product is the determinant, the product of the diagonal
    assert values[-1] < 1e-11


# --- operator 13 ---

def brute_kmeans(rows, k, rounds, dim, scale=256, salt="2"):
    kept = [(i, [math.floor(scale * float(c)) for c in e]) for i, e in rows if e is not None and len(e) == dim and all(c is not None and math.isfinite(c) for c in e)]
    sha = lambda i: hashlib.sha256(f"{salt}:{i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, sha(r[0]), r[1]))[:k]]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for r in range(rounds + 1):
        won = [min((dist(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
        if r < rounds:
            for j in range(len(centroids)):
                own = [x for (_, x), (_, w) in zip(kept, won) if w == j]
                if own:
                    centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    fits = lambda v: v if v < 2**63 else None
    inertia = [sum(d for d, w in won if w == j) for j in range(len(centroids))]
    return [(i, j, fits(d), fits(inertia[j]), fits(sum(inertia)), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
            for (i, _), (d, j) in zip(kept, won)]


@pytest.mark.parametrize("n, dim, k, rounds", [(400, 8, 12, 5), (5, 8, 12, 3), (60, 1, 7, 5), (200, 3, 1, 2)])
def test_clusters(spark, n, dim, k, rounds):
    rng = np.random.default_rng(n)
    rows = [(i, [float(v) for v in rng.integers(-6, 7, dim) / 4]) for i in range(n)] + odd(dim) + [(950, [1.0] * (dim + 1))]  # many ties
    got = [tuple(r) for r in bk.bisector_kmeans(frame(spark, rows).repartition(5), k, rounds, dim).collect()]
    H.same_rows(got, brute_kmeans(rows, k, rounds, dim))


def test_clusters_with_large_components(spark):
    rows = [(i, [float(2 ** (3 * i)), float(-(2**i)), 3.0]) for i in range(14)] + vectors(30, 3)
    got = [tuple(r) for r in bk.bisector_kmeans(frame(spark, rows), 5, 3, 3).collect()]
    want = brute_kmeans(rows, 5, 3, 3)
    H.same_rows(got, want)
    assert any(r[2] is None for r in want) or max(r[2] for r in want) > 2**60


def test_clusters_of_nothing(spark):
    assert bk.bisector_kmeans(frame(spark, [])).count() == 0
    assert bk.bisector_kmeans(frame(spark, [(1, [1.0, 2.0]), (2, None)])).count() == 0


def test_tournament_equals_all_distances():
    rng = np.random.default_rng(4)
    c, x = rng.integers(-5, 6, (30, 4)), rng.integers(-5, 6, (3000, 4))
    won, d = bk.Tournament(c.tolist()).assign(x)
    all_d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (won == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all()


def test_clusters_equal_sql(spark):
    got = queries.op13(spark, H.SF)
    want = H.sf_duck(queries.kmeans_sql())
    H.same_rows([tuple(r) for r in got.select(*want.columns).collect()], [tuple(r) for r in want.itertuples(index=False)])
