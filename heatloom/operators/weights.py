"""Indicator weights per group and sub-index.

Every scheme returns the rows (by..., sub_index, indicator, w).  The input holds
normalised indicator columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from heatloom import constants as C
from heatloom.functions.basic import correlation, total
from heatloom.operators.groups import DEFAULT_BY, GroupProfile, ensure_profile, join_stats
from heatloom.operators.ordering import average_ranks, unpivot

Weights = Mapping[str, Mapping[str, float]]
METHODS = ("equal", "pca", "entropy", "critic", "manual")
TINY = 1e-12


def sub_indices(columns: Sequence[str]) -> dict[str, list[str]]:
    """Indicators of each sub-index that the table holds."""
    return {s: [c for c in w if c in columns] for s, w in C.SUB_INDEX_WEIGHTS.items()}


def equal_weights_map(columns: Sequence[str] = tuple(C.INDICATORS)) -> dict[str, dict[str, float]]:
    return {s: {c: 1.0 / len(cs) for c in cs} for s, cs in sub_indices(columns).items() if cs}


def check_manual(weights: Weights, tolerance: float = 1e-6) -> dict[str, dict[str, float]]:
    """Validate user weights: known indicators, each sub-index summing to 1."""
    for s, group in weights.items():
        unknown = set(group) - set(C.SUB_INDEX_WEIGHTS.get(s, {}))
        if s not in C.SUB_INDEX_WEIGHTS or unknown:
            raise ValueError(f"unknown sub-index or indicators in {s!r}: {sorted(unknown)}")
        if abs(sum(group.values()) - 1.0) > tolerance:
            raise ValueError(f"weights of {s!r} sum to {sum(group.values()):.8f}, not 1")
    return {s: dict(g) for s, g in weights.items()}


def constant_weights(df: DataFrame, weights: Weights, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """The same weights for every group of the table."""
    rows = F.array(*[
        F.struct(F.lit(s).alias("sub_index"), F.lit(i).alias("indicator"), F.lit(float(w)).alias("w"))
        for s, group in weights.items() for i, w in group.items()
    ])
    return df.select(*by).distinct().select(*by, F.inline(rows))


def _weights_from_scores(df: DataFrame, by: Sequence[str], groups: dict[str, list[str]],
                         score: dict[str, Column], valid: dict[str, Column] | None = None) -> DataFrame:
    """Share of each indicator in the scores of its sub-index; equal shares if they vanish."""
    rows = []
    for s, cs in groups.items():
        whole = total([score[c] for c in cs])
        good = whole >= TINY
        if valid is not None:
            good = good & valid[s]
        for c in cs:
            w = F.when(good, score[c] / whole).otherwise(F.lit(1.0 / len(cs)))
            rows.append(F.struct(F.lit(s).alias("sub_index"), F.lit(c).alias("indicator"), w.alias("w")))
    return df.select(*by, F.inline(F.array(*rows)))


def weights_entropy(
    df: DataFrame, by: Sequence[str] = DEFAULT_BY, profile: GroupProfile | None = None
) -> DataFrame:
    """Weights from the Shannon redundancy of each indicator.

    Shares are p / sum(p) with p the min-max scaled value (at least 1e-10), so
    the entropy follows from sum(p) and sum(p ln p) in one aggregate.
    """
    profile = ensure_profile(df, by, profile)
    groups = sub_indices(df.columns)
    columns = [c for cs in groups.values() for c in cs]
    spans = df.groupBy(*by).agg(
        *[F.expr(f"struct(min(`{c}`) as lo, max(`{c}`) as hi)").alias(f"_s_{c}") for c in columns]
    )
    joined = join_stats(df.select(*by, *columns), spans, by, profile)

    def share(c: str) -> Column:
        lo, span = f"`_s_{c}`.lo", f"(`_s_{c}`.hi - `_s_{c}`.lo)"
        return F.expr(f"if({span} >= {TINY!r}D, greatest((`{c}` - {lo}) / {span}, if(`{c}` is null, null, 1e-10D)), null)")

    shares = joined.select(*by, *[share(c).alias(c) for c in columns])
    sums = shares.groupBy(*by).agg(*[
        F.expr(f"struct(count(`{c}`) as n, sum(`{c}`) as sp, sum(`{c}` * ln(`{c}`)) as spl)").alias(c) for c in columns
    ])
    redundancy = {c: F.expr(
        f"if(`{c}`.n < 2, 0.0D, 1.0D - greatest(0.0D, least(1.0D, "
        f"-(`{c}`.spl / `{c}`.sp - ln(`{c}`.sp)) / ln(cast(`{c}`.n as double)))))"
    ).alias(c) for c in columns}
    wide = sums.select(*by, *redundancy.values())
    return _weights_from_scores(wide, by, groups, {c: F.col(c) for c in columns})


def weights_critic(
    df: DataFrame, by: Sequence[str] = DEFAULT_BY, profile: GroupProfile | None = None
) -> DataFrame:
    """Contrast times conflict: sigma_j * sum_k (1 - rho_jk) with Spearman rho over complete rows.

    Needs ``cell_id``.  Falls back to equal weights where a correlation is
    undefined.  All sub-indices share one ranking and one aggregate: a cell
    contributes the indicators of those sub-indices it has completely.
    """
    profile = ensure_profile(df, by, profile)
    groups = {s: cs for s, cs in sub_indices(df.columns).items() if cs}
    columns = [c for cs in groups.values() for c in cs]
    complete = {}
    for cs in groups.values():
        ok = total([F.col(c).isNull().cast("int") for c in cs]) == 0
        complete.update({c: F.when(ok, F.col(c)).alias(c) for c in cs})
    long = unpivot(df.select(*by, "cell_id", *[complete[c] for c in columns]), [*by, "cell_id"], columns)
    ranked = average_ranks(long, "value", [*by, "indicator"], profile.scaled(groups=len(columns)))
    wide = ranked.groupBy(*by, "cell_id").pivot("indicator", columns).agg(
        F.first("rank").alias("r"), F.first("value").alias("v")
    )
    pairs = [(a, b) for cs in groups.values() for i, a in enumerate(cs) for b in cs[i + 1:]]
    stats = wide.groupBy(*by).agg(
        *[F.count(f"{cs[0]}_v").alias(f"n_{s}") for s, cs in groups.items()],
        *[F.stddev_pop(f"{c}_v").alias(f"sd_{c}") for c in columns],
        *[correlation(f"{a}_r", f"{b}_r").alias(f"rho_{a}_{b}") for a, b in pairs],
    )
    # Groups without complete rows keep a row, with undefined statistics.
    stats = df.select(*by).distinct().join(stats, list(by), "left")

    def rho(a: str, b: str) -> Column:
        return F.col(f"rho_{a}_{b}") if (a, b) in pairs else F.col(f"rho_{b}_{a}")

    score, valid = {}, {}
    for s, cs in groups.items():
        if len(cs) < 2:
            score[cs[0]], valid[s] = F.lit(1.0), F.lit(True)
            continue
        score.update({c: F.col(f"sd_{c}") * total([1.0 - rho(c, k) for k in cs if k != c]) for c in cs})
        whole = total([score[c] for c in cs])
        valid[s] = F.coalesce((F.col(f"n_{s}") >= 3) & whole.isNotNull() & ~F.isnan(whole), F.lit(False))
    return _weights_from_scores(stats, by, groups, score, valid)


def weights_pca(df: DataFrame, by: Sequence[str] = DEFAULT_BY) -> DataFrame:
    """Squared loadings of the first principal component over complete rows.

    The covariance matrix is aggregated in Spark; only one small matrix per
    group and sub-index reaches Python for its leading eigenvector.
    """
    groups = {s: cs for s, cs in sub_indices(df.columns).items() if cs}
    aggs, rows = [], []
    for s, cs in groups.items():  # one pass: the upper triangles of all matrices are one aggregate
        ok = total([F.col(c).isNull().cast("int") for c in cs]) == 0
        aggs.append(F.sum(ok.cast("long")).alias(f"n_{s}"))
        aggs += [F.covar_samp(F.when(ok, F.col(a)), F.when(ok, F.col(b))).alias(f"{s}_{i}_{k}")
                 for i, a in enumerate(cs) for k, b in enumerate(cs) if i <= k]
        cov = F.array(*[F.col(f"{s}_{min(i, k)}_{max(i, k)}") for i in range(len(cs)) for k in range(len(cs))])
        rows.append(F.struct(F.lit(s).alias("sub_index"), F.col(f"n_{s}").alias("n"),
                             F.array(*[F.lit(c) for c in cs]).alias("indicators"), cov.alias("cov")))
    matrices = df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))

    def leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["w"] = [_squared_loadings(n, c, len(i)) for n, c, i in
                        zip(pdf["n"], pdf["cov"], pdf["indicators"])]
            yield pdf[[*by, "sub_index", "indicators", "w"]]

    fields = [matrices.schema[c] for c in (*by, "sub_index", "indicators")]
    schema = T.StructType([*fields, T.StructField("w", T.ArrayType(T.DoubleType()))])
    solved = matrices.mapInPandas(leading, schema)
    pairs = F.arrays_zip(F.col("indicators").alias("indicator"), F.col("w"))
    return solved.select(*by, "sub_index", F.inline(pairs)).toDF(*by, "sub_index", "indicator", "w")


def _squared_loadings(n: int, cov: Sequence[float], k: int) -> list[float]:
    equal = [1.0 / k] * k
    if n < k + 1 or cov is None:
        return equal
    m = np.array([math.nan if v is None else v for v in cov], dtype=float).reshape(k, k)
    if not np.isfinite(m).all():
        return equal
    loadings = np.linalg.eigh(m)[1][:, -1] ** 2
    return (loadings / loadings.sum()).tolist() if loadings.sum() >= TINY else equal


def compute_weights(
    df: DataFrame,
    method: str = "equal",
    by: Sequence[str] = DEFAULT_BY,
    user_weights: Weights | None = None,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Weights of one scheme for normalised indicators."""
    if method == "equal":
        return constant_weights(df, equal_weights_map(df.columns), by)
    if method == "manual":
        return constant_weights(df, check_manual(user_weights or C.SUB_INDEX_WEIGHTS), by)
    if method == "entropy":
        return weights_entropy(df, by, profile)
    if method == "critic":
        return weights_critic(df, by, profile)
    if method == "pca":
        return weights_pca(df, by)
    raise ValueError(f"unknown weighting method {method!r}; choose from {METHODS}")
