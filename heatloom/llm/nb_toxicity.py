"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the character 4- to 6-grams it holds (lower case, white
space as one blank character each, a blank before and behind the text), hashed.
For each, the log ratio of its smoothed document shares in toxic and clean text is
learned from the training labels; logistic regression on presence times ratio
gives the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heatloom.llm.common import chunks, filter_texts, id_text, labelled_sample, sigmoid, slices

#: Bound of the sample that is fitted on: rows of each class.
SAMPLE_PER_CLASS = 5000
#: n-grams with the most telling ratios that enter the regression, by default.
SELECTED = 20_000
GRAMS = (4, 5, 6)
BITS = 20
THRESHOLD = 0.5
#: Odd multipliers of the n-gram hash.
STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: hashed n-gram at every position, and the start of each text. Positions over a text's end hash to -1."""
    clean = [" " + t.lower() + " " for t in texts]
    c = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c[(c >= 9) & (c <= 13)] = 32
    size = np.array([len(t) for t in clean], np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    h, power = c + np.uint64(1), 1
    for n in range(2, max(GRAMS) + 1):
        power = power * STEP & 0xFFFFFFFFFFFFFFFF
        h = h[:-1] + (c[n - 1 :] + np.uint64(1)) * np.uint64(power)
        if n in GRAMS:
            key = (((h ^ (h >> np.uint64(29))) * np.uint64(MIX)) >> np.uint64(64 - BITS)).astype(np.int64)
            for k in range(1, n):
                over = ends - k
                key[over[(over >= 0) & (over < len(key))]] = -1
            yield key, starts


def presence(texts: list[str], select: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every selected feature that a text holds, each once; select: feature of a hash, or -1."""
    docs, feats = [], []
    for key, starts in grams(texts):
        f = select[key]  # hash -1 reads the last entry, which stands for "none"
        at = np.flatnonzero(f >= 0)
        docs.append(np.searchsorted(starts, at, "right") - 1)
        feats.append(f[at])
    both = np.unique(np.concatenate(docs) * np.int64(1 << 32) + np.concatenate(feats)) if docs else np.zeros(0, np.int64)
    return both >> 32, both & 0xFFFFFFFF


def _everything() -> np.ndarray:
    select = np.arange((1 << BITS) + 1)
    select[-1] = -1
    return select


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS,
    selected: int | None = SELECTED, least_docs: int = 2,
) -> dict | None:
    """Fit on a bounded sample of training labels; None where one class has no labelled document.

    The regression takes the ``selected`` n-grams with the most telling ratios among those
    of ``least_docs`` sampled documents or more; None and 1 take all of them.  Ids may
    have any type that casts to a string; NULL ids and NULL or contradicting labels never
    train, a NULL text counts as empty, and of repeated ids one text trains.
    """
    sample, counts = labelled_sample(labels, label, per_class)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(sample.select(id_text("doc_id").alias("_id"), "y")), id_text("doc_id") == F.col("_id"))
        .select("doc_id", "y", "text")
    )

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = _everything()
        n = np.zeros((2, 1 << BITS), np.int64)
        rows = np.zeros(2, np.int64)
        for b in slices(batches):
            y = np.array(b.column(1).to_pylist(), np.int64)
            rows += np.bincount(y, minlength=2)[:2]
            for first, part in chunks(b.column(2).to_pylist()):
                doc, feat = presence(part, every)
                for c in (0, 1):
                    n[c] += np.bincount(feat[y[first + doc] == c], minlength=1 << BITS)
        at = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(n[0][at], rows[0])), pa.array(np.append(n[1][at], rows[1]))],
            names=["f", "n0", "n1"])

    total = texts.mapInArrow(shares, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # at most 2 ** BITS + 1 rows are left
    got = total.where((F.col("f") == -1) | (F.col("n0") + F.col("n1") >= least_docs)).toArrow()
    f, n0, n1 = (got[c].to_numpy() for c in ("f", "n0", "n1"))
    at = np.flatnonzero(f == -1)
    if not len(at) or not n0[at[0]] or not n1[at[0]]:
        return None
    m0, m1 = int(n0[at[0]]), int(n1[at[0]])
    f, n0, n1 = (np.delete(a, at) for a in (f, n0, n1))
    ratio = np.log((n1 + 1.0) / (m1 + 2.0)) - np.log((n0 + 1.0) / (m0 + 2.0))
    telling = np.abs(ratio) * np.sqrt(n0 / m0 + n1 / m1)
    keep = np.lexsort((f, -telling))[:selected]
    select = np.full((1 << BITS) + 1, -1, np.int32)
    select[f[keep]] = np.arange(len(keep))
    ratio = ratio[keep]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            feats = [np.zeros(0, np.int64)] * b.num_rows
            for first, part in chunks(b.column(2).to_pylist()):
                doc, feat = presence(part, select)
                cut = np.searchsorted(doc, np.arange(len(part) + 1))
                for k in range(len(part)):
                    feats[first + k] = feat[cut[k] : cut[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x.astype(np.int32) for x in feats], pa.list_(pa.int32()))], names=["doc_id", "y", "x"])

    data = (
        texts.mapInArrow(held, f"doc_id {kind}, y int, x array<int>")
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").toArrow()
    )
    y = data["y"].to_numpy().astype(np.float64)
    lists = data["x"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    w, bias = _regress(np.repeat(np.arange(len(y)), lengths), lists.flatten().to_numpy(), ratio, y)
    prior = np.log(max(counts.get(1, 1), 1) / max(counts.get(0, 1), 1)) - np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    weight = np.append(w * ratio, 0.0)
    return {"select": select, "weight": weight, "bias": bias + prior}


def _regress(row: np.ndarray, col: np.ndarray, ratio: np.ndarray, y: np.ndarray, decay: float = 2e-4, steps: int = 300):
    """Logistic regression on presence times ratio, by Adam on the full sample."""
    v = ratio[col]
    w, bias = np.zeros(len(ratio)), 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=v * w[col], minlength=len(y)) + bias
        e = (sigmoid(z) - y) / len(y)
        g = np.bincount(col, weights=v * e[row], minlength=len(w)) + decay * w
        gb = e.sum()
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        rate = 0.03 * min(1.0, 3.0 * (1 - t / (steps + 1)))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    return w, bias


def score_texts(texts: list, model: dict | None) -> np.ndarray:
    out = np.full(len(texts), 0.0)
    if model is None:
        return out
    for first, part in chunks(texts):
        doc, feat = presence(part, model["select"])
        z = np.bincount(doc, weights=model["weight"][feat], minlength=len(part))
        out[first : first + len(part)] = sigmoid(z + model["bias"])
    return out


def toxicity_scores(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    NULL text counts as empty; every text gets a score from 0 to 1.  Without a model
    (a class without labelled documents) all scores are 0.  held_out: the id's crc32
    mod ``folds`` is 0, so its label was never used; a NULL id counts as empty text.
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


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their columns; all of them where nothing can be learned.

    NULL texts count as empty; repeated rows and NULL ids are judged by their text alone.
    """
    model = fit_toxicity(docs, labels)
    return filter_texts(docs, lambda texts: score_texts(texts, model) < threshold)
