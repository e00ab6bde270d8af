"""Monte Carlo and weight sensitivity of the vulnerability index."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from heatloom import constants as C
from heatloom.functions.basic import clamp, correlation, rescale
from heatloom.functions.draws import Draws
from heatloom.functions.random import normal
from heatloom.operators.groups import DEFAULT_BY, GroupProfile, ensure_profile
from heatloom.operators.index import hvi, hvi_formula, subindex, with_subindices
from heatloom.operators.normalize import robust_normalize, scaled_columns
from heatloom.operators.ordering import BUFFER_VALUES, average_ranks
from heatloom.operators.rundir import n_tasks, stage
from heatloom.operators.weights import equal_weights_map


def perturb_indicators(
    cells: DataFrame, n: int = 500, seed: int = 42, key: Sequence[str] = ("cell_id",),
    columns: Sequence[str] = tuple(C.INDICATORS), method: str = "xxhash64", hashes: int = 1,
) -> DataFrame:
    """Every cell once per sample, with noise on each indicator.

    A draw depends on seed, sample, cell and indicator only, so results do not
    change with the partitioning, the columns or after a lost executor.  Cells are dealt to
    tasks before they are copied: few cells are few bytes, which would stay in one task.
    ``hashes``: hashes of a draw (see ``normal``).  Draws of md5 are made by numpy, which
    gets a cell once and gives its samples back.
    """
    dealt = cells.repartition(n_tasks(cells), *key)
    rows = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_id"))
    out = _noisy(rows, seed, key, columns, method, hashes)
    if method != "md5":
        return out
    drawn = [c for c in columns if c in C.BAND_NOISE and c in cells.columns]
    return dealt.select("*", _key_text(key).alias("_key")).mapInArrow(_sample_batches(n, seed, drawn, hashes), out.schema)


def _key_text(key: Sequence[str]) -> Column:
    """The key as it stands in the texts that ``normal`` hashes: a ``|`` before each part, no NULLs."""
    return F.concat_ws("|", F.lit(""), *[F.col(k).cast("string") for k in key])


#: Rows that a batch of samples has, about.
BATCH_SAMPLES = 100_000


def _sample_batches(n: int, seed: int, drawn: Sequence[str], hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, step = np.arange(n), max(1, BATCH_SAMPLES // max(n, 1))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                draws = Draws(seed, [k.encode() for k in b.column("_key").to_pylist()], samples)
                at = pa.array(np.repeat(np.arange(b.num_rows), n))
                out = {}
                for c in b.schema.names[:-1]:
                    if c in drawn:
                        values, missing = _values(b.column(c))
                        noisy = _with_noise(c, values[:, None], draws.normal(c, hashes))
                        out[c] = pa.array(noisy.ravel(), mask=np.repeat(missing, n))
                    else:
                        out[c] = b.column(c).take(at)
                out["sample_id"] = pa.array(np.tile(samples, b.num_rows), pa.int32())
                yield pa.RecordBatch.from_pydict(out)

    return run


def _values(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column as doubles, and where it is NULL (those stand as 0)."""
    doubles = column.cast(pa.float64())
    return doubles.fill_null(0.0).to_numpy(zero_copy_only=False), doubles.is_null().to_numpy(zero_copy_only=False)


def _with_noise(c: str, value: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``_noisy`` on arrays; works in place of the draws."""
    kind, size = C.BAND_NOISE[c]
    if kind == "gaussian":
        z *= size
        return np.add(z, value, out=z)
    z *= math.sqrt(math.log(1.0 + size * size))
    return np.multiply(np.exp(z, out=z), value, out=z)


def _noisy(rows: DataFrame, seed: int, key: Sequence[str], columns: Sequence[str], method: str, hashes: int = 1) -> DataFrame:
    """Rows of cells and samples with their noise."""

    def noisy(c: str) -> Column:
        if c not in C.BAND_NOISE:
            return F.col(c)
        kind, size = C.BAND_NOISE[c]
        z = normal(seed, "sample_id", *key, F.lit(c), method=method, hashes=hashes)
        if kind == "gaussian":
            return F.col(c) + size * z
        return F.col(c) * F.exp(math.sqrt(math.log(1.0 + size * size)) * z)

    return rows.withColumns({c: noisy(c) for c in columns if c in rows.columns})


#: Rows of samples that a task makes, about, where an area does not have more.
TASK_SAMPLES = 1_000_000


def mc_distribution(
    cells: DataFrame, n: int = 500, seed: int = 42, by: Sequence[str] = DEFAULT_BY, method: str = "xxhash64",
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Distribution of each cell's index over perturbed indicators.

    The index runs with (by, sample) as its group.  The cells of an area go to one task
    before they are copied, and percentiles, scaling and range are windows there, so every
    draw is made once and the samples are never shuffled.  Where areas are fewer than
    tasks, an area is dealt by sample, and only the index of each row is shuffled.  Areas
    too large for that are written once and go through ``hvi``.  A cell then has n values,
    which bounds its percentile buffer.  Draws of md5 are made by numpy, and so is all that
    follows from them within an area: rows of samples are not made then.
    """
    columns = [c for c in C.INDICATORS if c in cells.columns]
    areas = ensure_profile(cells, by, profile)
    base = cells.select(*by, "cell_id", *columns)
    key, tasks = (*by, "cell_id"), n_tasks(base)
    if areas.max_rows * len(columns) <= BUFFER_VALUES and method == "md5":
        return _distribution_by_arrays(base, n, seed, by, columns, areas)
    if areas.max_rows * len(columns) <= BUFFER_VALUES:
        parts = max(1, min(n, -(-tasks // max(areas.n_groups, 1))))
        needed = tasks if areas.n_groups * areas.max_rows * n <= tasks * TASK_SAMPLES else -(-base.count() * n // TASK_SAMPLES)
        home = list(by)
        if parts > 1:
            base = base.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            home.append("_part")
        base = base.repartition(max(tasks, needed), *home)
        first = F.col("_part") if parts > 1 else F.lit(0)
        rows = base.select("*", F.explode(F.sequence(first, F.lit(n - 1), F.lit(parts))).alias("sample_id"))
        scored = _scored_in_windows(_noisy(rows, seed, key, columns, method), columns, [*home, "sample_id"])
    else:
        samples = perturb_indicators(base, n, seed, key, method=method)
        scored = hvi(stage(samples, "samples"), by=[*by, "sample_id"], profile=areas.scaled(groups=n))
    p = F.percentile("hvi", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = scored.groupBy(*by, "cell_id").agg(
        p.alias("_p"), F.avg("hvi").alias("mean"), F.stddev_pop("hvi").alias("std"), F.count("hvi").alias("n_valid")
    )
    return out.select(
        *by, "cell_id", F.col("_p")[0].alias("p10"), F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p90"),
        "mean", "std", (F.col("_p")[2] - F.col("_p")[0]).alias("confidence_width"), "n_valid",
    )


#: Columns of the distribution of a cell, in the order of the result.
DISTRIBUTION = ("p10", "p50", "p90", "mean", "std", "confidence_width")


def _distribution_by_arrays(
    base: DataFrame, n: int, seed: int, by: Sequence[str], columns: Sequence[str], areas: GroupProfile,
) -> DataFrame:
    """``mc_distribution`` with a table of cells x samples for each area.

    Areas fewer than tasks, and areas whose table would not be small, are dealt by
    sample; a cell's values then meet again as one array for each part.
    """
    tasks, dealt = n_tasks(base), base.withColumn("_key", _key_text([*by, "cell_id"]))
    parts = max(1, min(n, max(-(-tasks // max(areas.n_groups, 1)), -(-areas.max_rows * n // TASK_SAMPLES))))
    # tasks for the rows of samples that the areas have at most; where that bound is loose, they are counted
    needed = tasks if areas.n_groups * areas.max_rows * n <= tasks * TASK_SAMPLES else -(-base.count() * n // TASK_SAMPLES)
    home = list(by)
    if parts > 1:
        dealt = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        home.append("_part")
    dealt = dealt.repartition(max(tasks, needed), *home).groupBy(*home)
    fields = [base.schema[c] for c in dict.fromkeys([*by, "cell_id"])]
    results = [T.StructField(c, T.DoubleType()) for c in DISTRIBUTION] + [T.StructField("n_valid", T.LongType())]

    def scores(area: pa.Table) -> np.ndarray:
        part = area.column("_part")[0].as_py() if parts > 1 else 0
        return _area_scores(area, seed, columns, np.arange(part, n, parts))

    if parts == 1:
        def summed(area: pa.Table) -> pa.Table:
            # rows of one cell follow each other; normally it has one
            _, first, row_cell, rows = np.unique(area.column("_key").to_numpy(), return_index=True, return_inverse=True, return_counts=True)
            values = scores(area)[np.argsort(row_cell, kind="stable")]
            found = _distribution(values.ravel(), np.isnan(values).ravel(), rows * values.shape[1])
            return pa.table({f.name: area.column(f.name).take(pa.array(first)) for f in fields} | found)

        return dealt.applyInArrow(summed, T.StructType(fields + results))

    def listed(area: pa.Table) -> pa.Table:
        values = scores(area)
        ends = pa.array(np.arange(area.num_rows + 1) * values.shape[1], pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(values.ravel(), mask=np.isnan(values).ravel()))
        return pa.table({f.name: area.column(f.name) for f in fields} | {"_values": lists})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, TASK_SAMPLES // n)
            for b in (whole.slice(lo, step) for lo in range(0, whole.num_rows, step)):
                flat, missing = _values(b.column("_values").flatten())
                lengths = np.diff(b.column("_values").offsets.to_numpy())
                yield pa.RecordBatch.from_pydict({f.name: b.column(f.name) for f in fields} | _distribution(flat, missing, lengths))

    lists = dealt.applyInArrow(listed, T.StructType([*fields, T.StructField("_values", T.ArrayType(T.DoubleType()))]))
    names = [f.name for f in fields]
    met = lists.groupBy(*names).agg(F.flatten(F.collect_list("_values")).alias("_values"))
    return met.mapInArrow(joined, T.StructType(fields + results))


def _area_scores(area: pa.Table, seed: int, columns: Sequence[str], samples: np.ndarray) -> np.ndarray:
    """The index of an area, cells x samples, NaN where a cell has none; the steps of ``_scored_in_windows``.

    The hazard is no part of the index, so its indicators are not drawn.
    """
    draws = Draws(seed, [k.encode() for k in area.column("_key").to_pylist()], samples)
    shape, maps = (area.num_rows, len(samples)), equal_weights_map(columns)
    parts, held = {}, np.ones(area.num_rows, bool)
    for s, column in C.SUB_INDEX_COLUMN.items():
        if column not in ("e", "s", "ac"):
            continue
        summed, used = np.zeros(shape), np.zeros(area.num_rows)
        for c, weight in maps[s].items():
            values, missing = _values(area.column(c))
            found = np.flatnonzero(~missing)
            if not len(found):
                continue
            noisy = _with_noise(c, values[:, None], draws.normal(c)) if c in C.BAND_NOISE else np.broadcast_to(values[:, None], shape)
            noisy = noisy if len(found) == len(values) else noisy[found]
            lo, hi = _percentiles(noisy, C.CLIP_PERCENTILES)
            with np.errstate(divide="ignore", invalid="ignore"):
                scaled = np.where(hi - lo < C.FLAT_SPAN, 0.5, (np.fmin(np.maximum(noisy, lo), hi) - lo) / (hi - lo))
            if C.INDICATOR_DIRECTIONS.get(c, "positive") == "negative":
                scaled = 1.0 - scaled
            scaled *= weight
            if len(found) == len(values):
                summed += scaled
            else:
                summed[found] += scaled
            used[found] += weight
        known = used > 1e-12
        held &= known
        parts[column] = np.divide(summed, np.where(known, used, 1.0)[:, None], out=summed)
    out = np.full(shape, np.nan)
    if held.any():
        raw = (parts["e"] * parts["s"] / np.maximum(parts["ac"], C.AC_FLOOR))[held]
        lo, hi = raw.min(axis=0), raw.max(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[held] = np.where(hi - lo < C.FLAT_SPAN, 0.5, (raw - lo) / (hi - lo))
    return out


def _percentiles(values: np.ndarray, probs: Sequence[float]) -> list[np.ndarray]:
    """Exact percentiles of every column, interpolated as ``F.percentile`` does."""
    places = [(len(values) - 1) * p for p in probs]
    ranks = sorted({f(x) for x in places for f in (math.floor, math.ceil)})
    ordered = np.partition(values, ranks, axis=0)
    out = []
    for x in places:
        lo, hi = math.floor(x), math.ceil(x)
        out.append(ordered[lo] if lo == hi else (hi - x) * ordered[lo] + (x - lo) * ordered[hi])
    return out


def _distribution(flat: np.ndarray, missing: np.ndarray, lengths: np.ndarray) -> dict[str, pa.Array]:
    """Result columns of cells from their values, which follow each other in ``flat``."""
    owner = np.repeat(np.arange(len(lengths)), lengths)[~missing]
    counts, values = np.bincount(owner, minlength=len(lengths)), flat[~missing]
    starts, found = np.cumsum(counts) - counts, np.zeros((len(DISTRIBUTION), len(lengths)))
    for size in np.unique(counts[counts > 0]):
        at = np.flatnonzero(counts == size)
        rows = values[starts[at][:, None] + np.arange(size)]
        p10, p50, p90 = _percentiles(np.ascontiguousarray(rows.T), (0.1, 0.5, 0.9))
        found[:, at] = p10, p50, p90, rows.mean(axis=1), rows.std(axis=1), p90 - p10
    return {c: pa.array(v, mask=counts == 0) for c, v in zip(DISTRIBUTION, found)} | {"n_valid": pa.array(counts, pa.int64())}


def _scored_in_windows(samples: DataFrame, columns: Sequence[str], group: Sequence[str]) -> DataFrame:
    """The index of every row, all statistics as windows over its group."""
    w = W.partitionBy(*group)
    probs = F.array(*[F.lit(float(p)) for p in C.CLIP_PERCENTILES])
    with_stats = samples.withColumns({f"{c}_p": F.percentile(F.col(c).cast("double"), probs).over(w) for c in columns})
    out = with_subindices(with_stats.withColumns(scaled_columns(columns, C.INDICATOR_DIRECTIONS)))
    out = out.withColumn("_raw", hvi_formula(F.col("e"), F.col("s"), F.col("ac"))).select(*group, "cell_id", "_raw")
    lo, hi = F.min("_raw").over(w), F.max("_raw").over(w)
    return out.withColumns({"_lo": lo, "_hi": hi}).select(*group, "cell_id", rescale(F.col("_raw"), F.col("_lo"), F.col("_hi"), C.FLAT_SPAN).alias("hvi"))


def weight_variants(shift: float = C.WEIGHT_SHIFT) -> list[tuple[str, str, str, dict[str, float]]]:
    """(sub_index, indicator, direction, weights): every weight moved up and down, then renormalised."""
    out = []
    for s, base in C.SUB_INDEX_WEIGHTS.items():
        for name in base:
            for direction, sign in (("+", 1.0), ("-", -1.0)):
                w = dict(base)
                w[name] = max(C.MIN_SHIFTED_WEIGHT, base[name] + sign * shift)
                whole = sum(w.values())
                out.append((s, name, direction, {k: v / whole for k, v in w.items()}))
    return out


def weight_variant_cross(
    cells: DataFrame, by: Sequence[str] = DEFAULT_BY, shift: float = C.WEIGHT_SHIFT,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Nominal index and the index under every shifted weight, one row per cell and variant.

    Only one sub-index differs per variant, so all variants are expressions over
    the same normalised row.  Rescaling is left out: it does not change ranks.
    """
    variants = F.array(*[
        F.struct(F.lit(s).alias("sub_index"), F.lit(name).alias("indicator"), F.lit(direction).alias("direction"), F.col(f"_v{i}").alias("hvi"))
        for i, (s, name, direction, _) in enumerate(weight_variants(shift))])
    return _wide_variants(cells, by, shift, profile).select(*by, "cell_id", "hvi_nominal", F.inline(variants))


def _wide_variants(cells: DataFrame, by: Sequence[str], shift: float, profile: GroupProfile | None) -> DataFrame:
    """(by, cell_id, hvi_nominal, _v0, _v1, ...): the index under every shifted weight as a column.

    A sub-index is a sum over a sum of weights, so a shifted weight only adds to both
    sums of its sub-index, which are worked out once; scaling all weights of a sub-index
    changes nothing.
    """
    profile = ensure_profile(cells, by, profile)
    base = cells.select(*by, "cell_id", *C.INDICATORS)
    normed = robust_normalize(base, C.INDICATORS, by, profile=profile)
    nominal = {C.SUB_INDEX_COLUMN[s]: subindex(w) for s, w in equal_weights_map().items()}
    sums = {}
    for s, weights in C.SUB_INDEX_WEIGHTS.items():
        sums[f"_n_{s}"] = F.expr(" + ".join(f"coalesce(`{c}` * {float(w)!r}D, 0.0D)" for c, w in weights.items()))
        sums[f"_u_{s}"] = F.expr(" + ".join(f"if(`{c}` is null, 0.0D, {float(w)!r}D)" for c, w in weights.items()))
    out = normed.withColumns({**nominal, **sums}).withColumn("hvi_nominal", hvi_formula(F.col("e"), F.col("s"), F.col("ac")))
    # Written once: otherwise every variant would carry the formulas of its parts.
    parts = [c for s, w in C.SUB_INDEX_WEIGHTS.items() if C.SUB_INDEX_COLUMN[s] in ("e", "s", "ac") for c in w]
    out = stage(out.select(*by, "cell_id", "hvi_nominal", "e", "s", "ac", *sums, *parts), "variant-parts")
    shifted = {}
    for i, (s, name, _, w) in enumerate(weight_variants(shift)):
        column = C.SUB_INDEX_COLUMN[s]
        if column not in ("e", "s", "ac"):
            shifted[f"_v{i}"] = F.col("hvi_nominal")
            continue
        more = max(C.MIN_SHIFTED_WEIGHT, C.SUB_INDEX_WEIGHTS[s][name] + (shift if w[name] > C.SUB_INDEX_WEIGHTS[s][name] else -shift)) - C.SUB_INDEX_WEIGHTS[s][name]
        part = F.expr(f"case when _u_{s} + if(`{name}` is null, 0.0D, {more!r}D) > 1e-12D then "
                      f"(_n_{s} + coalesce(`{name}` * {more!r}D, 0.0D)) / (_u_{s} + if(`{name}` is null, 0.0D, {more!r}D)) end")
        parts = {c: part if c == column else F.col(c) for c in ("e", "s", "ac")}
        shifted[f"_v{i}"] = hvi_formula(parts["e"], parts["s"], parts["ac"])
    return out.select(*by, "cell_id", "hvi_nominal", *[v.alias(k) for k, v in shifted.items()])


def weight_sensitivity(
    cells: DataFrame, by: Sequence[str] = DEFAULT_BY, shift: float = C.WEIGHT_SHIFT,
    profile: GroupProfile | None = None, min_cells: int = 10,
) -> DataFrame:
    """Spearman correlation of the shifted with the nominal index, 28 rows per group.

    The nominal index is ranked once, and variants of a sub-index that is no part of the
    index not at all: they are the nominal index.
    """
    profile = ensure_profile(cells, by, profile)
    variants = weight_variants(shift)
    moving = [i for i, v in enumerate(variants) if C.SUB_INDEX_COLUMN[v[0]] in ("e", "s", "ac")]
    wide = _wide_variants(cells, by, shift, profile)
    # weights stay positive, so a cell has all variants or none
    long = wide.where(F.col("hvi_nominal").isNotNull()).unpivot([*by, "cell_id"], ["hvi_nominal", *[f"_v{i}" for i in moving]], "_variant", "_value")
    ranked = average_ranks(long, "_value", [*by, "_variant"], profile.scaled(groups=len(moving) + 1), "_rank")
    ranks = ranked.groupBy(*by, "cell_id").agg(
        *[F.max(F.when(F.col("_variant") == c, F.col("_rank"))).alias(c) for c in ("hvi_nominal", *[f"_v{i}" for i in moving])])
    agree = {f"_v{i}": correlation(f"_v{i}" if i in moving else "hvi_nominal", "hvi_nominal").alias(f"_r{i}") for i in range(len(variants))}
    out = ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *agree.values())
    rows = F.array(*[
        F.struct(F.lit(s).alias("sub_index"), F.lit(name).alias("indicator"), F.lit(direction).alias("direction"),
                 F.when(F.col("_n") > min_cells, clamp(F.col(f"_r{i}"), -1.0, 1.0)).alias("spearman_r")) for i, (s, name, direction, _) in enumerate(variants)])
    return out.select(*by, F.inline(rows))


def sensitivity_by_indicator(sensitivity: DataFrame, by: Sequence[str] = DEFAULT_BY, threshold: float = 0.90) -> DataFrame:
    """Mean correlation per indicator and whether it falls below the threshold."""
    out = sensitivity.groupBy(*by, "indicator").agg(F.avg("spearman_r").alias("mean_r"))
    return out.withColumn("unstable", F.col("mean_r") < threshold)


def morris_screen(sensitivity: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """Elementary effects per indicator: mu_star, sigma and rank (14 rows per group)."""
    change = F.coalesce(1.0 - F.col("spearman_r"), F.lit(0.0))
    out = sensitivity.groupBy(*by, "sub_index", "indicator").agg(
        F.avg(F.abs(change)).alias("mu_star"), F.stddev_pop(change).alias("sigma")
    )
    return out.withColumn("rank", indicator_rank(by))


def indicator_rank(by: Sequence[str] = DEFAULT_BY, value: str = "mu_star") -> Column:
    """Descending rank; equal values share the mean of their ranks, cut to an integer."""
    w = W.partitionBy(*by).orderBy(F.col(value).desc())
    ties = w.rangeBetween(W.currentRow, W.currentRow)
    return F.floor(F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0).cast("int")


def morris_sorted(screened: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    return screened.orderBy(*by, F.col("mu_star").desc(), "indicator")


def spearman_matrix(
    normed: DataFrame, columns: Sequence[str] = tuple(C.INDICATORS), by: Sequence[str] = DEFAULT_BY,
    profile: GroupProfile | None = None, min_pairs: int = 5,
) -> DataFrame:
    """Rank correlation of all indicator pairs over the cells that have both.

    The rank of a value in a pair counts the cells that hold the other column too.  One
    pass over each column's order gives its rank among all its cells and among the
    cells of every column with gaps, so gaps add counters, not passes.
    """
    columns = list(columns)
    profile = ensure_profile(normed, by, profile)
    nulls = normed.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first()
    held = {c: f"has_{i}" for i, c in enumerate(columns) if nulls[c] > 0}
    rows = normed.select(*by, "cell_id", *columns, *[F.col(c).isNotNull().alias(h) for c, h in held.items()])
    long = rows.unpivot([*by, "cell_id", *held.values()], [F.col(c).cast("double").alias(c) for c in columns], "indicator", "value")
    ranks = average_ranks(long.where(F.col("value").isNotNull()), "value", [*by, "indicator"], profile.scaled(groups=len(columns)), among=list(held.values()))
    found = F.struct("rank", *[f"rank_{h}" for h in held.values()])
    wide = ranks.groupBy(*by, "cell_id").agg(*[F.max(F.when(F.col("indicator") == c, found)).alias(f"_r{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    rank_in = lambda i, j: F.col(f"_r{i}")[f"rank_{held[columns[j]]}" if columns[j] in held else "rank"]
    both = wide.select(*by, F.posexplode(F.array(*[F.struct(rank_in(i, j).alias("x"), rank_in(j, i).alias("y")) for i, j in pairs])).alias("_p", "_v"))
    both = both.select(*by, "_p", F.col("_v.x").alias("_x"), F.col("_v.y").alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    out = both.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("n"), correlation("_x", "_y").alias("_rho"))
    name = lambda k: F.get(F.array(*[F.lit(columns[p[k]]) for p in pairs]), F.col("_p"))
    return out.select(*by, "n", name(0).alias("indicator_a"), name(1).alias("indicator_b"), F.when(F.col("n") > min_pairs, F.col("_rho")).alias("rho"))
