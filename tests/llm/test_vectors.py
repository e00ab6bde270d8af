"""Near-duplicate vectors and graph search against brute force."""

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.llm import graph_ann, itq_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(seed=1, n=300, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(n // 2, n):  # near and exact copies of earlier vectors, some scaled
        x[i] = x[rng.integers(0, n // 2)] * rng.choice([1, 1, 2.5]) + rng.normal(size=dim) * rng.choice([0, 0, 0.02, 0.1, 0.25])
    out = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3)) for i in range(n)]
    out = [(i, e, out[i // 2][2] if i % 5 == 0 else c) for i, e, c in out]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dim, [nan] * dim, [inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    out += [(1000 + i, e, 1) for i, e in enumerate(odd)]
    out += [(2000, out[3][1], None), (2001, out[3][1], None), (2002, [1.0, 2.0], 0), (2003, [2.0, 4.0], 0), (2004, [3.0], 0)]
    out += [(3000 + i, out[4][1], out[4][2]) for i in range(40)] + [(3000, out[4][1], out[4][2])]
    return out


def fine(e):
    return e is not None and len(e) > 0 and all(v is not None and np.isfinite(v) for v in e) and any(v != 0 for v in e)


def brute_links(data, threshold=0.93):
    u, links = H.Union(range(len(data))), [0] * len(data)
    for i, (a, x, c) in enumerate(data):
        for j, (b, y, d) in enumerate(data[:i]):
            if c is None or c != d or not fine(x) or not fine(y) or len(x) != len(y):
                continue
            p, q = np.array(x, float), np.array(y, float)
            if p @ q / np.sqrt((p @ p) * (q @ q)) >= threshold:
                links[i] += 1
                links[j] += 1
                u.join(i, j)
    least = {}
    for i, (a, _, _) in enumerate(data):
        r = u.find(i)
        least[r] = min(least.get(r, a), a)
    return [(a, links[i], least[u.find(i)], a == least[u.find(i)]) for i, (a, _, _) in enumerate(data)]


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 8)])
def test_near_duplicates(spark, seed, block):
    data = rows(seed)
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as rep", "2 as root", "3 as links")
    got = [tuple(r) for r in itq_dedup.near_duplicates(df, block=block).collect()]
    want = brute_links(data)
    total, found = sum(w[1] for w in want), sum(g[1] for g in got)
    assert len(got) == len(want) and found <= total and found >= 0.98 * total
    if found == total:
        H.same_rows(got, want)


def test_no_usable_vector(spark):
    assert itq_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = itq_dedup.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_bits_are_balanced_and_keep_angles():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 32)) @ np.diag(np.linspace(0.2, 2, 32))
    model = itq_dedup.learn_codes({32: x}, 64)
    code = itq_dedup._codes(itq_dedup.unit(x), model, 64)
    assert np.abs(code.mean(0) - 0.5).max() < 0.1
    near = itq_dedup._codes(itq_dedup.unit(x + 0.05 * rng.normal(size=x.shape)), model, 64)
    assert (near != code).mean() < 0.1 < (code[:1000] != code[1000:]).mean()
    for n in (1, 10**4, 10**7, 10**10):
        bits, radius = itq_dedup.table_plan(n, 0.93)
        assert 8 <= bits <= 24 and radius <= 4


@pytest.mark.parametrize("offset", [0.0, 0.8])
@pytest.mark.parametrize("n", [200, 100_000, 1_000_000])
def test_pairs_at_the_threshold_meet_with_a_common_offset(offset, n):
    rng = np.random.default_rng(5)
    x = np.sqrt(1 - offset) * itq_dedup.unit(rng.normal(size=(8000, 64)))
    x[:, 0] += np.sqrt(offset)
    model = itq_dedup.learn_codes({64: x[:4000]})
    bits, radius = itq_dedup.measured_plan(n, 0.93, {64: x[:4000]}, model)[64]
    a = itq_dedup.unit(x[4000:])
    d = rng.normal(size=a.shape)
    d = itq_dedup.unit(d - (d * a).sum(1, keepdims=True) * a)
    flips = itq_dedup._codes(a, model, 128) != itq_dedup._codes(0.93 * a + np.sqrt(1 - 0.93**2) * d, model, 128)
    tables = 128 // bits
    assert (flips[:, : tables * bits].reshape(-1, tables, bits).sum(2).min(1) <= radius).mean() > 0.97


def brute_nearest(data, k):
    good = [(i, np.array(e, float)) for i, e, _ in data if i is not None and fine(e)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            s = sorted((-float(x @ y), i) for i, y in good if i != q and len(x) == len(y))
            out[q] = list(dict.fromkeys((i, -v) for v, i in s))[:k]
    return out


def test_nearest_neighbours(spark):
    data = rows(5, 600)
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as score", "2 as shard", "3 as ids")
    got = {}
    for r in graph_ann.nearest_neighbours(df, df.where("vec_id % 20 = 0"), shards=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    want = brute_nearest(data, 20)
    assert set(got) == {q for q in want if want[q]}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    assert hits >= 0.97 * sum(len(w) for w in want.values())
    for q, found in got.items():
        score = dict(want[q])
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == min(20, len(want[q]))
        assert all(i != q and abs(s - score.get(i, s)) < 1e-9 for i, s in found)


def test_shards_grow_with_the_table(spark):
    """As many shards for any size, until one would be too large; every shard has a task of its own."""
    def shards(n, **how):
        rng = np.random.default_rng(n)
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(n, 4)))], SCHEMA)
        unique = df.groupBy("embedding").agg(F.collect_list("vec_id").alias("ids"))
        dealt = graph_ann.dealt(unique, **how).withColumn("task", F.spark_partition_id())
        placed = graph_ann.dealt_to_tasks(dealt.drop("task")).withColumn("task", F.spark_partition_id())
        got = placed.groupBy("shard").agg(F.countDistinct("task").alias("tasks"), F.min("task").alias("task")).collect()
        assert all(r.tasks == 1 for r in got) and len({r.task for r in got}) == len(got)
        return len(got)

    assert [shards(n, shards=3) for n in (200, 600, 1000, 3000)] == [1, 3, 3, 3]
    assert shards(3000, shards=3, cells=2400) == 5


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert graph_ann.nearest_neighbours(empty, empty).count() == 0
    one = spark.createDataFrame([(20, [1.0, 0.0], 0)], SCHEMA)
    assert graph_ann.nearest_neighbours(one, one).count() == 0


def test_graph_recall_and_degree():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24))
    lifted = graph_ann.lifted(x)
    edges, entry = graph_ann.build_graph(lifted)
    assert (edges != np.arange(1500)[:, None]).all() and graph_ann.reached(edges, entry).all()
    assert (edges[:, : graph_ann.DEGREE] >= 0).sum() >= 0.95 * (edges >= 0).sum()
    q = rng.normal(size=(50, 24))
    found, _ = graph_ann.beam_search(lifted, edges, entry, graph_ann.lifted(q, 0), graph_ann.SEARCH_BEAM)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(truth, found)]) > 0.97


def test_search_equals_sql(spark):
    """One shard of a few hundred vectors is searched completely."""
    import os

    from heatloom.llm import queries

    if not os.path.isdir(H.SF):
        pytest.skip("no test tables")
    got = queries.op5(spark, H.SF).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    want = H.sf_duck(queries.NEAREST_SQL).sort_values(["query_id", "rank"]).reset_index(drop=True)
    assert (got[["query_id", "rank", "vec_id"]] == want[["query_id", "rank", "vec_id"]]).all().all()
    np.testing.assert_allclose(got.score, want.score, rtol=1e-12)
