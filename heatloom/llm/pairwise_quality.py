"""Bradley-Terry quality scores, learned from preference pairs.

A document of quality 1 is preferred to one of quality 0.  The chance that i is
preferred to j is sigmoid(w . (x_i - x_j)); w minimises the logistic loss over such
pairs.  The score of a document is w . x, placed so that the score quantile that
separates the known share of rejected documents falls on the decision threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heatloom.llm.common import filter_texts, fold, id_text, logit, sigmoid, slices, training_labels
from heatloom.operators.rundir import cut_lineage, n_tasks, stage

#: Rows of the rarer class in a group in which pairs are drawn, and of the other class, about.
GROUP_RARE, GROUP_ROWS = 500, 4000
#: Documents of the other class that each document meets.
RIVALS = 8
#: Score at which a document is accepted.
THRESHOLD = 0.3
PUNCTUATION = [c for c in range(33, 127) if not (chr(c).isalnum())]


def features(text: str) -> np.ndarray:
    """Shares of characters and repetition measures of a whole text."""
    raw = text.encode()
    n = max(len(raw), 1)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = raw.split()
    m = len(words)
    kinds = len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out = [np.sqrt(h[c]) for c in PUNCTUATION]
    upper, lower, digit = h[65:91].sum(), h[97:123].sum(), h[48:58].sum()
    letters = max(upper + lower + h[128:].sum(), 1.0 / n)
    bad = sum(h[ord(c)] for c in "#$%&*!|<>{}[]@^~=_\\") * n / max(m, 1)
    out += [
        np.sqrt(upper), upper / letters, lower, np.sqrt(digit), h[32], np.sqrt(h[10]), np.sqrt(h[:9].sum() + h[14:32].sum()),
        h[128:].sum(), np.log1p(m), np.log1p(len(raw)) - np.log1p(m), min(bad, 4.0),
        kinds / max(m, 1), np.log1p(m) - np.log1p(kinds), sum(map(eq, words, words[1:])) / max(m - 1, 1),
        len(set(lines)) / max(len(lines), 1), np.log1p(m / max(len(lines), 1)), float(m == 0), float(m < 5),
    ]
    return np.array(out, np.float64)


N_FEATURES = len(features(""))


def fit_pairs(x: np.ndarray, y: np.ndarray, rivals: int = RIVALS, decay: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights that minimise the logistic loss on the differences x_i - x_j of preference pairs, by Newton steps."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(17)
    i = np.repeat(good, rivals)
    j = bad[rng.integers(0, len(bad), len(i))]
    i, j = np.concatenate([i, good[rng.integers(0, len(good), len(bad) * rivals)]]), np.concatenate([j, np.repeat(bad, rivals)])
    d = x[i] - x[j]
    return newton(lambda w: pair_sums(d, w), x.shape[1], decay, steps)


def pair_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over preference pairs: their number, the gradient and the second derivatives, end to end."""
    p = sigmoid(-(d @ w))
    return np.concatenate([[len(d)], -(d.T @ p), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def newton(sums, k: int, decay: float = 1e-3, steps: int = 30) -> np.ndarray:
    w = np.zeros(k)
    for _ in range(steps):
        found = sums(w)
        n, grad, hess = found[0], found[1 : k + 1], found[k + 1 :].reshape(k, k)
        step = np.linalg.solve(hess / n + decay * np.eye(k), grad / n + decay * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def quantile_cut(score: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The score below which ``share`` of the weight lies, half way to the next score."""
    order = np.argsort(score, kind="stable")
    s, mass = score[order], np.cumsum(weight[order])
    k = int(np.searchsorted(mass, share * mass[-1] * (1 - 1e-12)))
    k = min(k, len(s) - 1)
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def summed(rows: DataFrame, sums) -> np.ndarray:
    """The sum of the vectors that ``sums`` yields for the batches of a task; the driver gets one vector a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for v in sums(batches):
            total = v if total is None else total + v
        yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], names=["v"])

    return sum(np.frombuffer(r["v"]) for r in rows.mapInArrow(run, "v binary").collect())


def matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, N_FEATURES)


def dealt_pairs(rows: DataFrame, n: dict[int, int]) -> DataFrame:
    """Rows (grp, own, y, x) in order of their group, in which pairs are drawn.

    Both classes are dealt to buckets by hash.  Where the frequent class fills a bucket it
    is cut into parts, and the rare rows of the bucket stand in each of them, ``own`` in one.
    """
    rare = int(n[1] < n[0])
    buckets = max(1, n[rare] // GROUP_RARE)
    parts = max(1, -(-n[1 - rare] // (buckets * GROUP_ROWS)))
    home = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(parts))
    at = F.explode(F.when(F.col("y") == rare, F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")).otherwise(F.array(home)))
    dealt = rows.select("_id", "y", "x", F.pmod(F.xxhash64("_id"), F.lit(buckets)).alias("_b"), home.alias("_h"), at.alias("_p"))
    dealt = dealt.select("_id", (F.col("_b") * parts + F.col("_p")).alias("grp"), (F.col("_h") == F.col("_p")).alias("own"), "y", "x")
    dealt = dealt.repartition(n_tasks(rows), "grp").sortWithinPartitions("grp", "_id").drop("_id")
    return cut_lineage(dealt)  # every step reads it in this order


def group_pairs(grp: int, own: np.ndarray, y: np.ndarray, z: np.ndarray, rare: int, rivals: int) -> np.ndarray:
    """Differences x_i - x_j of preferred and rejected rows: every row meets ``rivals`` rows of the other class."""
    rng = np.random.default_rng([17, grp])
    few, many = np.flatnonzero(y == rare), np.flatnonzero(y != rare)
    if not len(few) or not len(many):
        return np.zeros((0, z.shape[1]))
    mine = few[own[few]]
    a = np.concatenate([few[rng.integers(0, len(few), len(many) * rivals)], np.repeat(mine, rivals)])
    b = np.concatenate([np.repeat(many, rivals), many[rng.integers(0, len(many), len(mine) * rivals)]])
    return (z[a] - z[b]) * (1 if rare == 1 else -1)


def weighted_cut(scored: DataFrame, share: float, most: int = 5000) -> float:
    """``quantile_cut`` of (s, w), by histograms that narrow until few rows are left to be sorted."""
    lo, hi, whole = scored.agg(F.min("s"), F.max("s"), F.sum("w")).first()
    target, below = share * whole * (1 - 1e-12), 0.0
    while lo < hi:
        inside = scored.where(F.col("s").between(lo, hi))
        bins = inside.groupBy(F.least(F.floor((F.col("s") - lo) / (hi - lo) * 1000), F.lit(999)).alias("b")).agg(
            F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("b").collect()
        mass = below + np.cumsum([r["w"] for r in bins])
        k = min(int(np.searchsorted(mass, target)), len(bins) - 1)
        below, lo, hi = float(mass[k] - bins[k]["w"]), bins[k]["lo"], bins[k]["hi"]
        if bins[k]["n"] <= most:
            break
    found = scored.where(F.col("s").between(lo, hi))
    found = found.groupBy("s").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).orderBy("s").collect()
    k = min(int(np.searchsorted(below + np.cumsum([r["w"] for r in found]), target)), len(found) - 1)
    at = found[k]["s"]
    if found[k]["n"] > 1 and below + sum(r["w"] for r in found[:k]) + found[k]["w"] * (1 - 1 / found[k]["n"]) >= target:
        return float(at)  # the next row in order has the same score
    after = found[k + 1]["s"] if k + 1 < len(found) else scored.where(F.col("s") > hi).agg(F.min("s")).first()[0]
    return float(at if after is None else (at + after) / 2)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, rivals: int = RIVALS) -> dict | None:
    """Fit on all training labels; None where one class has no labelled document.

    Features of the documents meet the labels; mean, spread, Newton steps and the cut are
    sums over all of these rows.  Ids may have any type that casts to a string; NULL ids
    and NULL or contradicting labels never train, a NULL text counts as empty, and of
    repeated ids one text trains.
    """
    known = training_labels(labels, label).select(id_text("doc_id").alias("_id"), "y")
    per_class = lambda rows: {int(r["y"]): int(r["count"]) for r in rows.groupBy("y").count().collect()}
    counts = per_class(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [features(t.as_py() or "").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["_id", "x"])

    texts = docs.where(F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).select(id_text("doc_id").alias("_id"), "text")
    rows = stage(texts.mapInArrow(run, "_id string, x binary").join(known, "_id").groupBy("_id").agg(
        F.min("y").alias("y"), F.min("x").alias("x")), "quality-features")
    n = per_class(rows)
    if len(n) < 2:
        return None
    mean = summed(rows.select("x"), lambda bs: (matrix(b.column(0)).sum(0) for b in bs)) / sum(n.values())
    std = np.sqrt(summed(rows.select("x"), lambda bs: (((matrix(b.column(0)) - mean) ** 2).sum(0) for b in bs)) / sum(n.values()))
    std[std < 1e-9] = np.inf
    scaled = lambda col: np.clip((matrix(col) - mean) / std, -8, 8)
    pairs, rare = dealt_pairs(rows, n), int(n[1] < n[0])

    def sums(w: np.ndarray) -> np.ndarray:
        def of(batches):
            held = None
            for b in batches:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                grp = held.column("grp").to_numpy()
                cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist()]
                for lo, hi in zip(cuts, cuts[1:]):
                    yield one(held.slice(lo, hi - lo))
                held = held.slice(cuts[-1])
            if held is not None and held.num_rows:
                yield one(held)

        def one(t: pa.Table) -> np.ndarray:
            own, y = (t.column(c).to_numpy() for c in ("own", "y"))
            return pair_sums(group_pairs(int(t.column("grp")[0].as_py()), own, y, scaled(t.column("x")), rare, rivals), w)

        return summed(pairs, of)

    w = newton(sums, N_FEATURES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(scaled(b.column(1)) @ w), pa.array(np.where(y == 0, counts[0] / n[0], counts[1] / n[1]))], names=["s", "w"])

    cut = weighted_cut(stage(rows.select("y", "x").mapInArrow(score, "s double, w double"), "quality-training"), counts[0] / (counts[0] + counts[1]))
    return {"w": w, "mean": mean, "std": std, "cut": cut, "at": logit(threshold)}


def quality_scores(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    NULL text counts as empty; every text gets a score from 0 to 1.  Without a model
    (a class without labelled documents) all scores are 0.5.  held_out: the id's
    crc32 mod ``folds`` is 0, so its label was never used; a NULL id counts as empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in slices(batches):
            score = score_texts(b.column(1).to_pylist(), model)
            crc = [zlib.crc32((v.as_py() or "").encode()) % folds == 0 for v in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(crc, pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", id_text("doc_id").alias("_t")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def score_texts(texts: list, model: dict | None) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    x = np.array([features(t or "") for t in texts])
    return sigmoid(np.clip((x - model["mean"]) / model["std"], -8, 8) @ model["w"] - model["cut"] + model["at"])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their columns; all of them where nothing can be learned.

    NULL texts count as empty; repeated rows and NULL ids are judged by their text alone.
    """
    model = fit_quality(docs, labels, threshold=threshold)
    return filter_texts(docs, lambda texts: score_texts(texts, model) >= threshold)
