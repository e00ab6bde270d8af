"""Optimal length buckets: the bucket bounds that minimise padding, then token-budget batches.

A dynamic programme over the global length histogram chooses the bounds.  Inside a
bucket, documents are put into batches in hash order; their ranks come from counts
per (bucket, key range) plus a rank inside the range, so no task holds a bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from heatloom.llm.common import random_key
from heatloom.operators.rundir import stage

#: Lengths below 2**EXACT_BITS are exact in the histogram; longer ones are rounded up to EXACT_BITS binary digits.
EXACT_BITS = 12
#: Hex digits of the key that name a key range inside a bucket.
RANGE_DIGITS = 3


def rounded_length(length: Column) -> Column:
    """The length in the histogram; bounds its rows at 2,048 for each doubling of the length."""
    extra = F.greatest(F.length(F.bin(length)) - EXACT_BITS, F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), extra)
    return (F.ceil(length / step) * step).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of the ascending ``lengths`` with the least padding.

    f_k(j) = min over i < j of f_(k-1)(i) + padding of lengths i..j-1 filled up to
    the last of them.  The best i never falls as j grows, so each layer is solved by
    halving the range of j.  Of equal solutions the one with the smallest i wins.
    """
    m = len(lengths)
    if m == 0:
        return []
    buckets = min(buckets, m)
    n = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.float64)
    top = np.concatenate([[0], lengths]).astype(np.float64)
    f = top * n - s  # one bucket
    choices = []
    for k in range(2, buckets + 1):
        g, pick = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        todo = [(k, m, k - 1, m - 1)]
        while todo:
            lo, hi, from_i, to_i = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            last = min(to_i, j - 1)
            cost = f[from_i : last + 1] + top[j] * (n[j] - n[from_i : last + 1]) - (s[j] - s[from_i : last + 1])
            i = from_i + int(np.argmin(cost))
            g[j], pick[j] = cost[i - from_i], i
            todo += [(lo, j - 1, from_i, i), (j + 1, hi, i, to_i)]
        g[:k] = np.inf
        f = g
        choices.append(pick)
    bounds, j = [int(lengths[m - 1])], m
    for pick in reversed(choices):
        j = int(pick[j])
        bounds.append(int(lengths[j - 1]))
    return bounds[::-1]


def pack_documents(
    docs: DataFrame, length: Column, buckets: int = 8, token_budget: int = 65536, id_col: str = "doc_id",
) -> DataFrame:
    """Bucket, batch and place of every document.

    Returns id, n_tokens, pad_to (upper bound of the bucket), batch (within the
    bucket, from 0), slot (within the batch, from 0).  A batch holds as many
    documents as fit into ``token_budget`` when each is padded to the bound, one at
    least; only the last batch of a bucket is smaller.  Every input row gets a place,
    repeated rows and NULL ids too; a NULL length counts as 0; an empty table gives
    an empty result; other input columns are not read.
    """
    sized = stage(docs.select(F.col(id_col), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens")), "pack-lengths")
    hist = (
        sized.groupBy(rounded_length(F.col("n_tokens")).alias("len")).agg(F.count(F.lit(1)).alias("n")).orderBy("len").collect()
    )
    bounds = best_bounds(
        np.array([r["len"] for r in hist], np.int64), np.array([r["n"] for r in hist], np.int64), buckets)
    ends = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    placed = sized.withColumn("key", random_key(id_col)).select(
        id_col, "n_tokens", "key", F.substring("key", 1, RANGE_DIGITS).alias("part"),
        F.element_at(F.filter(ends, lambda e: e >= F.col("n_tokens")), 1).alias("pad_to"))
    counts = placed.groupBy("pad_to", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("pad_to", "part", (
        F.sum("n").over(Window.partitionBy("pad_to").orderBy("part")) - F.col("n")).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("pad_to", "part").orderBy("key", "n_tokens")) - 1 + F.col("offset")
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.col("pad_to"), F.lit(1))))
    return (
        placed.join(offsets, ["pad_to", "part"]).withColumn("rank", rank).withColumn("rows", rows)
        .select(id_col, "n_tokens", "pad_to", F.floor(F.col("rank") / F.col("rows")).alias("batch"),
                (F.col("rank") % F.col("rows")).alias("slot"))
    )
