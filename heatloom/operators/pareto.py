"""Non-dominated solutions and the choice of strategies among them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from heatloom import constants as C
from heatloom.functions.basic import total
from heatloom.operators.rundir import n_tasks, run_dir, stage

FIVE = ("f1", "f2", "f3", "f4", "f5")
#: Vectors of the first block (later ones have four times as many), and vectors sent to all tasks at most.
BLOCK_ROWS, SENT_VECTORS = 4_000, 250_000


def dominated_by(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which points some other point is no worse than everywhere and better than somewhere."""
    out = np.zeros(len(points), dtype=bool)
    for start in range(0, len(points), 256):
        p = points[start:start + 256, None, :]
        out[start:start + 256] = (
            (others[None] <= p).all(axis=2) & (others[None] < p).any(axis=2)
        ).any(axis=1)
    return out


def _local_front(pdf: pd.DataFrame, objectives: Sequence[str]) -> pd.DataFrame:
    values = pdf[list(objectives)].to_numpy(dtype=float)
    order = np.argsort(values.sum(axis=1), kind="stable")
    values, pdf = values[order], pdf.iloc[order]
    keep = np.ones(len(pdf), dtype=bool)
    # Good solutions come first, so small leading blocks remove most of the rest.
    for start in range(0, len(pdf), 512):
        block = np.flatnonzero(keep[start:start + 512]) + start
        rest = np.flatnonzero(keep[start:]) + start
        if len(block):
            keep[rest] = ~dominated_by(values[rest], values[block])
    return pdf[keep]


def _prune(schema: T.StructType, by: Sequence[str], objectives: Sequence[str]):
    """Drop solutions dominated within their own input batch.  What is left is checked globally."""
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not by:
                yield _local_front(pdf, objectives)[names]
                continue
            for _, part in pdf.groupby(list(by), sort=False, dropna=False):
                yield _local_front(part, objectives)[names]

    return run


def _objective(name: str) -> Column:
    """An objective as double; a missing one is an error, as it can neither win nor lose."""
    missing = F.raise_error(F.lit(f"objective {name} is missing")).cast("double")
    return F.when(F.col(name).isNull(), missing).otherwise(F.col(name).cast("double")).alias(name)


def pareto_front(
    solutions: DataFrame,
    objectives: Sequence[str] = FIVE,
    by: Sequence[str] = (),
    epsilon: Sequence[float] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Solutions no other solution of the group dominates (all objectives minimised).

    Equal vectors are collapsed and every batch is thinned by its own front.  A vector
    only loses to one with a smaller sum, so the survivors are ordered by their sums
    and taken in blocks: the front of the first block is final, and what is left is
    thinned by it where it lies, without a shuffle.  The result is exact; it is written
    once, as reports read it several times.  ``solutions`` is worked out twice.

    With ``epsilon`` objectives are compared on boxes of that width, and the
    solution with the smallest sum represents its box.  Objectives must not be
    missing; a row with a missing one fails the job.
    """
    if epsilon is not None:
        return _epsilon_front(solutions, objectives, by, epsilon, block_rows)
    rows = solutions
    vectors = rows.select(*by, *[_objective(o) for o in objectives])
    # One shuffle serves the removal of duplicates and spreads the comparisons.
    vectors = vectors.repartition(n_tasks(vectors), *by, *objectives).distinct()
    # Written, as cutting into ranges reads its input once for the cuts and once for the rows.
    thinned = stage(vectors.mapInPandas(_prune(vectors.schema, by, objectives), vectors.schema), "front-thinned")
    front = _front_in_blocks(thinned, objectives, by, block_rows)
    keys = [rows[b] == front[b] for b in by] + [rows[o].cast("double") == front[o] for o in objectives]
    return stage(rows.join(front, keys, "left_semi"), "front-rows")


def _front_in_blocks(vectors: DataFrame, objectives: Sequence[str], by: Sequence[str], block_rows: int) -> DataFrame:
    """The front of distinct vectors, block by block in the order of their sums.

    Vectors of equal sums are ordered by their parts, so that a dominating vector comes
    first even where sums are equal by rounding.
    """
    spark, schema, by = vectors.sparkSession, vectors.schema, list(by)
    order = [*by, "_s", *objectives]
    ordered = vectors.withColumn("_s", total([F.col(o) for o in objectives])).repartitionByRange(n_tasks(vectors), *order).sortWithinPartitions(*order)
    # ids rise with the order; steps of them are counted, and a block is a whole number of steps
    place, step = F.monotonically_increasing_id(), max(1, block_rows // 4)
    steps = F.shiftright(place, 33) * F.lit(1 << 31) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / step)
    rest = stage(ordered.drop("_s").withColumn("_b", steps.cast("long")), "front-ordered")
    folder, size, n = run_dir(spark, "front"), block_rows, 0
    while True:
        along = W.partitionBy(*by).orderBy("_b")
        counts = rest.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_c": F.sum("_n").over(along), "_k": F.row_number().over(along)})
        ends = counts.where((F.col("_c") <= size) | (F.col("_k") == 1)).groupBy(*by).agg(F.max("_b").alias("_end"))
        placed = rest.join(stage(ends, "front-ends"), by) if by else rest.withColumn("_end", F.lit(ends.first()[0]).cast("long"))
        first = F.col("_b") <= F.col("_end")
        block = placed.where(first).select(*schema.names)
        block.groupBy(*by).applyInPandas(lambda pdf: _local_front(pdf, objectives)[list(pdf.columns)], schema).write.parquet(f"{folder}/block={n}")
        best = spark.read.schema(schema).parquet(f"{folder}/block={n}")
        rest = placed.where(~first).select(*schema.names, "_b")
        if rest.isEmpty():
            break
        rest = stage(_thinned(rest, best, objectives, by), "front-rest")
        size, n = min(4 * block_rows, size * 4), n + 1
    return spark.read.schema(schema).parquet(*[f"{folder}/block={i}" for i in range(n + 1)])


def _thinned(rest: DataFrame, best: DataFrame, objectives: Sequence[str], by: list[str]) -> DataFrame:
    """The rows that no vector of the finished blocks dominates.

    The vectors travel with the task, at most SENT_VECTORS of them; the groups are taken
    in as many parts as that needs.
    """
    schema, objectives = rest.schema, list(objectives)
    if by:
        best = best.join(rest.select(*by).distinct(), by, "left_semi")
    parts = max(1, -(-best.count() // SENT_VECTORS)) if by else 1
    share = lambda df, i: df.where(F.pmod(F.xxhash64(*by), F.lit(parts)) == i) if parts > 1 else df
    out = None
    for i in range(parts):
        sent: dict[tuple, list] = {}
        for r in share(best, i).collect():
            sent.setdefault(tuple(r[b] for b in by), []).append([r[o] for o in objectives])
        tops = {k: np.array(v) for k, v in sent.items()}

        def run(batches: Iterator[pd.DataFrame], tops=tops) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                keep = np.ones(len(pdf), dtype=bool)
                values = pdf[objectives].to_numpy(dtype=float)
                groups = pdf.groupby(by, sort=False).indices.items() if by else [((), np.arange(len(pdf)))]
                for key, at in groups:
                    own = tops.get(key if isinstance(key, tuple) else (key,))
                    if own is not None:
                        keep[at] = ~dominated_by(values[at], own)
                yield pdf[keep]

        part = share(rest, i).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _epsilon_front(
    solutions: DataFrame, objectives: Sequence[str], by: Sequence[str], epsilon: Sequence[float], block_rows: int
) -> DataFrame:
    boxed = solutions.withColumns({
        f"_box_{o}": F.floor(F.col(o) / float(e)).cast("double") for o, e in zip(objectives, epsilon)
    })
    boxes = [f"_box_{o}" for o in objectives]
    front = pareto_front(boxed, boxes, by, None, block_rows)
    score = total([F.col(o) / float(e) for o, e in zip(objectives, epsilon)])
    best = front.groupBy(*by, *boxes).agg(
        F.min_by(F.struct(*solutions.columns), F.struct(score.alias("s"), F.col("solution_id").alias("i"))).alias("_r")
    )
    return best.select("_r.*")


def _ranges(front: DataFrame, objectives: Sequence[str], by: Sequence[str]) -> DataFrame:
    return front.groupBy(*by).agg(
        *[F.min(o).alias(f"_lo_{o}") for o in objectives], *[F.max(o).alias(f"_hi_{o}") for o in objectives]
    )


def _scaled(o: str) -> Column:
    return (F.col(o) - F.col(f"_lo_{o}")) / (F.col(f"_hi_{o}") - F.col(f"_lo_{o}") + 1e-9)


def _with_ranges(front: DataFrame, objectives: Sequence[str], by: Sequence[str]) -> DataFrame:
    ranges = _ranges(front, objectives, by)
    if by:
        return front.join(ranges, list(by))
    # Without a group there is exactly one row of ranges: a scalar subquery.
    row = ranges.select(F.struct("*")).scalar()
    return front.withColumn("_r", row).select("*", *[F.col(f"_r.{c}").alias(c) for c in ranges.columns]).drop("_r")


def utopia_distance(front: DataFrame, objectives: Sequence[str] = FIVE, by: Sequence[str] = ()) -> DataFrame:
    """Add utopia_distance: length of the range-scaled objective vector."""
    joined = _with_ranges(front, objectives, by)
    dist = F.sqrt(total([_scaled(o) * _scaled(o) for o in objectives]))
    return joined.withColumn("utopia_distance", dist).drop(*[f"_{p}_{o}" for o in objectives for p in ("lo", "hi")])


def strategic_solutions(
    front: DataFrame, objectives: Sequence[str] = FIVE, by: Sequence[str] = (), key: str = "solution_id"
) -> DataFrame:
    """Best health, lowest cost and closest-to-utopia solution; ties by the lowest id."""
    scored = utopia_distance(front, objectives, by)
    row = F.struct(*[F.col(c) for c in (key, *objectives)])
    pick = lambda c: F.min_by(row, F.struct(F.col(c).alias("v"), F.col(key).alias("k")))
    best = scored.groupBy(*by).agg(
        pick(objectives[0]).alias("health_focused"), pick(objectives[1]).alias("budget_focused"),
        pick("utopia_distance").alias("balanced"),
    )
    names = ("health_focused", "budget_focused", "balanced")
    rows = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("r")) for n in names])
    return best.select(*by, F.inline(rows)).select(*by, "strategy", "r.*")


def pareto_table(
    front: DataFrame, objectives: Sequence[str] = FIVE, names: Sequence[str] | None = None,
    x: str | None = None, n_variables: int = 0, key: str = "solution_id",
) -> DataFrame:
    """Report of a front: named objectives, decision columns and strategy flags."""
    if names is None:
        names = {5: C.LONG_OBJECTIVES, 3: C.SHORT_OBJECTIVES}.get(len(objectives)) or [
            f"f{i + 1}" for i in range(len(objectives))]
    picks = strategic_solutions(front, objectives, (), key).groupBy().agg(
        *[F.max(F.when(F.col("strategy") == s, F.col(key))).alias(f"_{s}")
          for s in ("health_focused", "budget_focused", "balanced")]
    )
    row = picks.select(F.struct("*")).scalar()
    joined = front.withColumn("_p", row).select("*", *[F.col(f"_p.{c}").alias(c) for c in picks.columns])
    extra = [((1.0 - F.col(objectives[0])) * 100.0).alias("mortality_reduction_pct")] if "f1_mortality_fraction" in names else []
    decisions = [F.get(F.col(x), F.lit(i)).alias(f"x_{i:04d}") for i in range(n_variables)] if x else []
    flags = [(F.col(key) == F.col(f"_{s}")).alias(f"is_{s}") for s in ("health_focused", "budget_focused", "balanced")]
    return joined.select(key, *[F.col(o).alias(n) for o, n in zip(objectives, names)], *extra, *decisions, *flags)


def union_seeds(fronts: Sequence[DataFrame], seeds: Sequence[int], objectives: Sequence[str] = FIVE) -> DataFrame:
    """Fronts of several seeds in one table, then the front of them all."""
    out = None
    for seed, f in zip(seeds, fronts):
        part = f.withColumn("seed", F.lit(int(seed)))
        out = part if out is None else out.unionByName(part)
    return pareto_front(out, objectives)


def das_dennis(n_objectives: int, partitions: int) -> list[tuple[float, ...]]:
    """Evenly spread directions whose parts are multiples of 1/partitions and sum to 1."""
    bars = itertools.combinations(range(partitions + n_objectives - 1), n_objectives - 1)
    out = []
    for b in bars:
        edges = (-1, *b, partitions + n_objectives - 1)
        out.append(tuple((hi - lo - 1) / partitions for lo, hi in zip(edges, edges[1:])))
    return out


def reference_direction_select(
    front: DataFrame, objectives: Sequence[str] = FIVE, partitions: int | None = None, key: str = "solution_id"
) -> DataFrame:
    """One solution per reference direction: the one closest to its line.

    The directions are a literal array searched inside the projection (210 for
    five objectives, 45 for three), so only one aggregate is left.
    """
    partitions = partitions or {5: 6, 3: 8}.get(len(objectives), 6)
    dirs = das_dennis(len(objectives), partitions)
    scaled = _with_ranges(front, objectives, ()).withColumn("_v", F.array(*[_scaled(o) for o in objectives]))
    # Unit vectors: the squared distance to the line is |v|^2 - (v . u)^2.
    def unit(d: tuple[float, ...]) -> str:
        length = math.sqrt(sum(x * x for x in d))
        return "array(" + ", ".join(f"{c / length!r}D" for c in d) + ")"

    units = F.expr("array(" + ", ".join(f"struct({i} as i, {unit(d)} as u)" for i, d in enumerate(dirs)) + ")")
    norm2 = total([F.get("_v", F.lit(i)) * F.get("_v", F.lit(i)) for i in range(len(objectives))])

    def gap(d: Column) -> Column:
        dot = total([F.get("_v", F.lit(i)) * F.get(d["u"], F.lit(i)) for i in range(len(objectives))])
        # Rounded, so that directions at the same distance tie and the first one wins.
        return F.struct(F.round(F.col("_n2") - dot * dot, 9).alias("d"), d["i"].alias("i"))

    near = scaled.withColumn("_n2", norm2).withColumn("_best", F.array_min(F.transform(units, gap)))
    row = F.struct(*[F.col(c) for c in (key, *objectives)])
    best = near.groupBy(F.col("_best.i").alias("direction")).agg(
        F.min_by(row, F.struct(F.col("_best.d").alias("d"), F.col(key).alias("k"))).alias("r")
    )
    return best.select("direction", "r.*")
