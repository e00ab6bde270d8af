"""Approximate nearest neighbours on robust-pruned directed graphs, one graph per shard.

The distinct vectors of a dimension are dealt into a few shards, which grow with the
table up to what a task may hold; only beyond that are there more of them.  A walk
costs about the logarithm of a shard, so that is what a query costs more on a larger
table.  In every shard a directed graph is grown: a greedy search from the entry point proposes neighbours
of a new vector, relaxed distance pruning keeps diverse ones, and the edges are made
mutual and pruned again.  Queries are searched in every shard with a beam; the best
of all shards are merged.  The graphs are written to the shared folder, so a lost
executor repeats single shards.

Inner products are searched as distances: with one more component that brings all
vectors of a shard to the same length, the nearest one has the largest product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from heatloom.llm.itq_dedup import runs_of
from heatloom.llm.vectors import matrix, usable
from heatloom.operators.rundir import n_tasks, stage

#: Shards of a dimension, components (vectors x dimension) of a shard at most, on average, and vectors that are worth a shard.
SHARDS, SHARD_CELLS, LEAST_SHARD = 6, 1 << 22, 256
#: Edges of a vector; beam of the build and of the search; relaxation of the pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 40, 96, 192, 1.2
#: Vectors put into the graph, or searched, at a time.
STEP = 256
#: Queries that search one copy of a shard; more get further copies. Where shards do not fill the tasks, fewer, but this many at least.
QUERY_GROUP, LEAST_GROUP = 20_000, 256


def lifted(x: np.ndarray, length: float | None = None) -> np.ndarray:
    """Vectors with one more component that makes all of them equally long; queries (length 0) get a zero."""
    square = (x * x).sum(axis=1)
    more = np.zeros(len(x)) if length == 0 else np.sqrt(np.maximum(square.max() - square, 0.0))
    return np.concatenate([x, more[:, None]], axis=1).astype(np.float32)


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int, expand: int = 4):
    """The ``beam`` nearest vectors that a best-first walk along the edges meets: (ids, squared distances), -1 where fewer.

    x and edges: all vectors and their out-edges (-1: none).  All queries walk at the
    same time and expand their ``expand`` nearest unexpanded vectors in each step,
    until the whole beam is expanded.
    """
    n = len(q)
    norm = (x * x).sum(axis=1)
    qn = (q * q).sum(axis=1)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    ids[:, 0] = entry
    dist[:, 0] = norm[entry] + qn - 2 * (q @ x[entry])
    done = np.ones((n, beam), bool)
    done[:, 0] = False
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, entry] = True
    seen[:, -1] = True
    active = np.arange(n)
    while len(active):
        open_dist = np.where(done[active], np.inf, dist[active])
        pick = np.argpartition(open_dist, expand - 1, axis=1)[:, :expand]
        real = np.take_along_axis(open_dist, pick, 1) < np.inf
        alive = real.any(axis=1)
        active, pick, real = active[alive], pick[alive], real[alive]
        if not len(active):
            break
        rows = active[:, None]
        done[rows, pick] = True
        nodes = np.where(real, ids[rows, pick], -1)
        near = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(active), -1)
        near.sort(axis=1)
        fresh = ~seen[rows, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        near = np.where(fresh, near, -1)
        seen[rows, near] = True
        r, c = np.nonzero(fresh)
        d = np.full(near.shape, np.inf, np.float32)
        to = near[r, c]
        d[r, c] = norm[to] + qn[active[r]] - 2 * np.einsum("ij,ij->i", q[active[r]], x[to])
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_dist = np.concatenate([dist[active], d], axis=1)
        all_done = np.concatenate([done[active], np.zeros(near.shape, bool) | (near < 0)], axis=1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        dist[active] = np.take_along_axis(all_dist, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
    return ids, dist


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Out-edges of the vectors ``own`` from candidates (-1: none): the nearest first, without those that a kept one covers.

    A candidate goes when ``relax`` times its distance to a kept one is no more than
    its distance to the vector itself.
    """
    p = x[own]
    v = x[cand]
    d = np.sqrt(np.maximum(((v - p[:, None, :]) ** 2).sum(axis=2), 0))
    d[(cand < 0) | (cand == own[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    alive = d < np.inf
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    out = np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    norm = (v * v).sum(axis=2)
    for k in range(degree):
        has = alive.any(axis=1)
        if not has.any():
            break
        at = alive.argmax(axis=1)
        out[has, k] = cand[rows, at][has]
        s = v[rows, at]
        to = np.sqrt(np.maximum(norm + (s * s).sum(axis=1)[:, None] - 2 * np.einsum("ijk,ik->ij", v, s), 0))
        alive &= relax * to > d
        alive[rows, at] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """(edges, entry point) of a graph over lifted vectors; inserted in the given order, in growing steps."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int64)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.concatenate([[entry], np.delete(np.arange(n), entry)])
    start, size = 1, 1
    while start < n:
        new = order[start : start + size]
        found, _ = beam_search(x, edges, entry, x[new], beam)
        edges[new] = robust_prune(x, new, found, degree, relax)
        source = np.repeat(new, degree)
        target = edges[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        for width in np.unique(1 << np.ceil(np.log2(count)).astype(int)):  # targets with alike many new edges together
            some = np.flatnonzero((count <= width) & (count * 2 > width))
            added = np.full((len(some), width), -1, np.int64)
            place = np.arange(width)[None, :] < count[some][:, None]
            added[place] = source[(first[some][:, None] + np.arange(width)[None, :])[place]]
            for k in range(0, len(some), STEP):
                t = hit[some[k : k + STEP]]
                edges[t] = robust_prune(x, t, np.concatenate([edges[t], added[k : k + STEP]], axis=1), degree, relax)
        start += len(new)
        size = min(STEP, size * 2)
    return connected(x, edges, entry, beam), entry


def reached(edges: np.ndarray, entry: int) -> np.ndarray:
    """Which vectors a walk along the edges reaches."""
    seen = np.zeros(len(edges), bool)
    seen[entry] = True
    front = np.array([entry])
    while len(front):
        to = np.unique(edges[front])
        front = to[(to >= 0) & ~seen[to]]
        seen[front] = True
    return seen


def connected(x: np.ndarray, edges: np.ndarray, entry: int, beam: int) -> np.ndarray:
    """The edges, with more of them to the vectors that pruning has left without a way to them.

    Every lost vector is proposed to the nearest vector that a search meets; of the
    proposals to one vector the first is taken, until none is lost.
    """
    while True:
        lost = np.flatnonzero(~reached(edges, entry))
        if not len(lost):
            return edges
        near = []
        for s in range(0, len(lost), STEP):
            ids, dist = beam_search(x, edges, entry, x[lost[s : s + STEP]], beam)
            near.append(np.take_along_axis(ids, dist.argmin(axis=1)[:, None], 1)[:, 0])
        near, first = np.unique(np.concatenate(near), return_index=True)
        more = np.full((len(x), 1), -1, np.int64)
        more[near, 0] = lost[first]
        edges = np.concatenate([edges, more], axis=1)


def dealt(unique: DataFrame, shards: int = SHARDS, cells: int = SHARD_CELLS) -> DataFrame:
    """Vectors (embedding, ids) with their dimension and shard."""
    count = F.count(F.lit(1))
    least = F.least(F.lit(shards), F.ceil(count / F.lit(float(LEAST_SHARD))))
    sizes = unique.groupBy(F.size("embedding").alias("_dim")).agg(count.alias("_n"), least.alias("_least")).withColumn(
        "shards", F.greatest("_least", F.ceil(F.col("_n") * F.col("_dim") / F.lit(float(cells)))))
    return unique.withColumn("dim", F.size("embedding")).join(F.broadcast(sizes), F.col("dim") == F.col("_dim")).withColumn(
        "first", F.col("ids")[0]).withColumn("shard", F.pmod(F.xxhash64("first"), F.col("shards")).cast("int"))


def dealt_to_tasks(rows: DataFrame, groups: int = 1) -> DataFrame:
    """Shards (and their query groups) to tasks by number, so that no task gets two while another has none."""
    n = n_tasks(rows)
    number = F.col("shard") * F.lit(groups) + (F.col("grp") if groups > 1 else F.lit(0))
    return rows.repartitionById(n, F.pmod(F.hash("dim").cast("long") + number, F.lit(n)).cast("int"))


def build_shards(vectors: DataFrame) -> DataFrame:
    """(dim, shard, embedding, ids) -> one row per vector with its place, out-edges and whether it is the entry point."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in runs_of(batches, ["dim", "shard"]):
            x = lifted(matrix(b.column("embedding")))
            edges, entry = build_graph(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("dim"), b.column("shard"), pa.array(np.arange(len(x))), pa.array(np.arange(len(x)) == entry),
                 b.column("embedding"), b.column("ids"), pa.array(list(edges), pa.list_(pa.int64()))],
                names=["dim", "shard", "place", "entry", "embedding", "ids", "edges"])

    return dealt_to_tasks(vectors).sortWithinPartitions("dim", "shard", "first").select(
        "dim", "shard", "embedding", "ids").mapInArrow(
        run, f"dim int, shard int, place long, entry boolean, embedding {kind}, ids array<long>, edges array<long>")


def search_shards(graphs: DataFrame, queries: DataFrame, k: int, beam: int, group: int = QUERY_GROUP) -> DataFrame:
    """(query_id, score, ids): the best k + 1 distinct vectors of every shard for every query (query_id, embedding).

    A shard and the queries of its dimension meet in one task per group of queries,
    as two kinds of rows of one sorted stream: first the graph, then query after query.
    """
    shards = graphs.select(F.col("dim").alias("_dim"), F.col("shard")).distinct()
    n_asked, n_shards = max(queries.count(), 1), max(shards.count(), 1)
    n_groups = max(-(-n_asked // group), min(n_tasks(graphs) // n_shards, n_asked // LEAST_GROUP), 1)
    kind = graphs.schema["embedding"].dataType.simpleString()
    nothing = F.lit(None)
    q = queries.select(F.size("embedding").alias("dim"), "embedding", "query_id", F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).cast("int").alias("grp"))
    asked = q.join(shards, F.col("dim") == F.col("_dim")).select(
        "dim", "shard", "grp", F.lit(1).alias("kind"), F.col("query_id").cast("long").alias("place"), F.lit(False).alias("entry"), "embedding",
        nothing.cast("array<long>").alias("ids"), nothing.cast("array<long>").alias("edges"))
    nodes = graphs.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).select(
        "dim", "shard", "grp", F.lit(0).alias("kind"), "place", "entry", "embedding", "ids", "edges")
    rows = nodes.unionAll(asked.select(*nodes.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for key, b in runs_of(_small(batches), ["dim", "shard", "grp", "kind", "piece"]):
            if key[3] == 0:
                raw = matrix(b.column("embedding"))
                edges = np.ascontiguousarray(b.column("edges").flatten().to_numpy()).reshape(len(raw), -1)
                graph = (key[:3], raw, lifted(raw), edges, int(np.flatnonzero(b.column("entry").to_numpy(zero_copy_only=False))[0]), b.column("ids"))
                continue
            if graph is None or graph[0] != key[:3]:
                continue
            _, raw, x, edges, entry, ids = graph
            q = matrix(b.column("embedding"))
            asked = b.column("place").to_numpy()
            for s in range(0, len(q), STEP):
                part = q[s : s + STEP]
                found, _ = beam_search(x, edges, entry, lifted(part, 0), min(beam, max(len(x), 4)))
                score = np.where(found >= 0, np.einsum("ijk,ik->ij", raw[found], part), -np.inf)
                best = np.argsort(-score, axis=1, kind="stable")
                best_score = np.take_along_axis(score, best, 1)
                # all that tie with place k + 1 stay, so that ties go by id
                edge = best_score[:, min(k, best.shape[1] - 1)][:, None]
                take = (best_score >= edge) & (best_score > -np.inf)
                r, c = np.nonzero(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked[s : s + STEP][r]), pa.array(best_score[r, c]), ids.take(pa.array(found[r, best[r, c]]))],
                    names=["query_id", "score", "ids"])

    def _small(batches):
        """Graph rows stay one run; query rows are cut into runs of one batch each."""
        for i, b in enumerate(batches):
            kind_ = b.column("kind").to_numpy()
            yield b.append_column("piece", pa.array(np.where(kind_ == 0, 0, i).astype(np.int64)))

    keys = ["dim", "shard", "grp"]
    return dealt_to_tasks(rows, n_groups).sortWithinPartitions(*keys, "kind", "place").mapInArrow(
        run, "query_id long, score double, ids array<long>")


def nearest_neighbours(
    embeddings: DataFrame, queries: DataFrame, k: int = 20, shards: int = SHARDS, cells: int = SHARD_CELLS, beam: int = SEARCH_BEAM,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of (vec_id, embedding) with the largest inner product for each query row.

    The vectors of a dimension are dealt into ``shards`` graphs; more where one would
    hold over ``cells`` components, fewer where they would hold under LEAST_SHARD vectors.
    ``queries`` are rows of the same form.  A row with the query's own vec_id is no
    candidate.  Scores are exact inner products in double precision; ties go to the
    smaller vec_id.  Vectors that are NULL, empty, zero or hold NULL or non-finite
    components, and rows without vec_id, take no part; only vectors of the query's
    dimension are compared.  Copies of a vector are one vertex of the graph, with
    the k + 1 smallest of their ids, more than which no query can return.
    """
    fine = usable() & F.col("vec_id").isNotNull()
    rows = embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    few = Window.partitionBy("embedding").orderBy("vec_id")
    unique = stage(
        rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    graphs = stage(build_shards(dealt(unique, shards, cells)), "graphs")
    asked = queries.where(fine).select(F.col("vec_id").cast("long").alias("query_id"), "embedding")
    found = search_shards(graphs, asked, k, beam)
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
