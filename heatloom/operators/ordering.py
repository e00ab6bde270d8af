"""Ordered operators per group: row numbers, running totals, ranks, percentiles.

Groups that fit into a task use a plain window or aggregate.  Larger groups are
cut into ordered buckets: a bounded quantile sketch proposes the bucket edges,
exact row counts per bucket give each bucket its offset, and windows run inside
the buckets only.  The results are exact either way; the sketch only decides
where the cuts lie.

A value that repeats often makes several edges coincide.  Rows equal to an edge
go to a bucket of their own, and that bucket is cut again along the tie-break
column, so one frequent value cannot fill a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from heatloom.operators.groups import DEFAULT_BY, GroupProfile, ensure_profile, join_stats
from heatloom.operators.quantiles import ranked_values

SKETCH_ACCURACY = 20_000


#: Types whose values are doubles without loss, so that rows on one edge are equal.
EXACT = ("double", "float", "int", "smallint", "tinyint")


def _edges(value: Column, n: int) -> Column:
    probs = [i / n for i in range(1, n)]
    return F.array_sort(F.array_distinct(F.percentile_approx(value, probs, SKETCH_ACCURACY)))


def _with_positions(df: DataFrame, by: Sequence[str], tie: str, profile: GroupProfile) -> DataFrame:
    """Add ``_pos``, a number that never falls as ``tie`` grows, for ties of any type.

    Text counts by the six bytes behind the prefix that all texts of the group share.
    """
    kind = df.schema[tie].dataType.simpleString()
    if kind not in ("string", "binary"):
        number = F.unix_date(tie) if kind == "date" else F.col(tie)
        return df.withColumn("_pos", number.cast("double"))
    raw = F.hex(F.col(tie).cast("binary"))
    ends = df.groupBy(*by).agg(F.min(raw).alias("_lo"), F.max(raw).alias("_hi"))
    alike = F.filter(F.sequence(F.lit(0), F.length("_lo")), lambda i: F.left("_lo", i) == F.left("_hi", i))
    ends = ends.select(*by, F.array_max(alike).alias("_same"))
    digits = F.rpad(F.substring(raw, F.col("_same") - F.col("_same") % 2 + 1, F.lit(12)), 12, "0")
    return join_stats(df, ends, by, profile).withColumn("_pos", F.conv(digits, 16, 10).cast("double")).drop("_same")


def _with_buckets(
    df: DataFrame, by: Sequence[str], value: str, tie: str | None, profile: GroupProfile,
    descending: bool = False, nulls_last: bool = False,
) -> DataFrame:
    """Add the ordered bucket keys ``_b`` and ``_t``.

    Rows without a value have a bucket of their own, at the end or before all others;
    it is cut along the tie-break column like the bucket of a frequent value.
    """
    n = profile.n_buckets
    aggs = [_edges(F.col(value).cast("double"), n).alias("_edges")]
    if tie is not None:
        df = _with_positions(df, by, tie, profile)
        aggs.append(_edges(F.col("_pos"), n).alias("_tie_edges"))
    out = join_stats(df, df.groupBy(*by).agg(*aggs), by, profile, "inner")
    v = F.col(value).cast("double")
    edges = F.coalesce("_edges", F.array().cast("array<double>"))
    below = F.size(F.filter(edges, lambda e: e < v))
    on_edge = F.coalesce(F.array_contains(edges, v), F.lit(False))
    bucket = below * 2 + on_edge.cast("int")
    bucket = F.when(F.col(value).isNull(), F.lit(2**30 if nulls_last else -(2**30))).otherwise(-bucket if descending else bucket)
    out = out.withColumn("_b", bucket)
    if tie is None:
        return out.withColumn("_t", F.lit(0)).drop("_edges")
    same = F.col(value).isNull()
    if df.schema[value].dataType.simpleString() in EXACT:
        same = same | on_edge
    ties = F.coalesce("_tie_edges", F.array().cast("array<double>"))
    t = F.when(F.col("_pos").isNull(), F.lit(-1)).otherwise(F.size(F.filter(ties, lambda e: e < F.col("_pos"))))
    return out.withColumn("_t", F.when(same, t).otherwise(0)).drop("_edges", "_tie_edges", "_pos")


def _with_offsets(
    df: DataFrame, by: Sequence[str], profile: GroupProfile, totals: dict[str, Column]
) -> DataFrame:
    """Join to every row the totals of all earlier buckets of its group."""
    keys = [*by, "_b", "_t"]
    per_bucket = df.groupBy(*keys).agg(*[c.alias(name) for name, c in totals.items()])
    w = W.partitionBy(*by).orderBy("_b", "_t").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, *[F.coalesce(F.sum(name).over(w), F.lit(0)).alias(name) for name in totals]
    )
    return join_stats(df, offsets, keys, profile.scaled(groups=2 * profile.n_buckets), "inner")


def row_numbers(
    df: DataFrame,
    value: str,
    tie: str,
    by: Sequence[str] = DEFAULT_BY,
    profile: GroupProfile | None = None,
    descending: bool = False,
    name: str = "rn",
) -> DataFrame:
    """Number the rows of each group from 1 by ``value``, ties by ascending ``tie``.

    Missing values come last.
    """
    profile = ensure_profile(df, by, profile)
    if profile.direct:
        order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
        return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(order, F.col(tie))))
    cut = _with_buckets(df, by, value, tie, profile, descending, nulls_last=True)
    cut = _with_offsets(cut, by, profile, {"_before": F.count(F.lit(1))})
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    w = W.partitionBy(*by, "_b", "_t").orderBy(order, F.col(tie))
    return cut.withColumn(name, (F.row_number().over(w) + F.col("_before")).cast("int")).drop("_b", "_t", "_before")


def running_totals(
    df: DataFrame,
    value: str,
    tie: str,
    amount: str,
    by: Sequence[str] = DEFAULT_BY,
    profile: GroupProfile | None = None,
    name: str = "running",
    number: str | None = None,
) -> DataFrame:
    """Running sum of ``amount`` in ascending (value, tie) order within each group.

    With ``number`` the position of the row is added as well.
    """
    profile = ensure_profile(df, by, profile)
    if profile.direct:
        w = W.partitionBy(*by).orderBy(F.col(value), F.col(tie))
        frame = w.rowsBetween(W.unboundedPreceding, W.currentRow)
        out = df.withColumn(name, F.sum(amount).over(frame))
        return out if number is None else out.withColumn(number, F.row_number().over(w))
    cut = _with_buckets(df, by, value, tie, profile)
    cut = _with_offsets(
        cut, by, profile, {"_amount_before": F.sum(amount), "_before": F.count(F.lit(1)), "_seen": F.count(amount)}
    )
    w = W.partitionBy(*by, "_b", "_t").orderBy(F.col(value), F.col(tie))
    frame = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    so_far = F.sum(amount).over(frame)
    # missing amounts: a total is missing only while no amount has been seen
    out = cut.withColumn(name, F.when(
        so_far.isNotNull() | F.col("_seen").cast("boolean"), F.coalesce(so_far, F.lit(0)) + F.col("_amount_before")))
    if number is not None:
        out = out.withColumn(number, (F.row_number().over(w) + F.col("_before")).cast("int"))
    return out.drop("_b", "_t", "_amount_before", "_before", "_seen")


def average_ranks(
    df: DataFrame,
    value: str,
    by: Sequence[str] = DEFAULT_BY,
    profile: GroupProfile | None = None,
    name: str = "rank",
    among: Sequence[str] = (),
) -> DataFrame:
    """Rank from 1; equal values share the mean of their ranks, and missing values are equal and lowest.

    For every boolean column in ``among`` the rank among the rows where it holds is added
    as ``<name>_<column>``, NULL in other rows; all come from one pass over the order.
    """
    profile = ensure_profile(df, by, profile)
    ones = {name: F.lit(1), **{f"{name}_{c}": F.when(F.col(c), 1).otherwise(0) for c in among}}
    holds = {name: F.lit(True), **{f"{name}_{c}": F.col(c) for c in among}}
    if profile.direct:
        group = W.partitionBy(*by).orderBy(value)
        upto, ties = group.rangeBetween(W.unboundedPreceding, W.currentRow), group.rangeBetween(W.currentRow, W.currentRow)
        return df.withColumns({
            n: F.when(holds[n], F.sum(one).over(upto) - (F.sum(one).over(ties) - 1) / 2.0).cast("double") for n, one in ones.items()})
    # Ties are collapsed first, so no bucket grows with the frequency of a value.
    counts = df.groupBy(*by, value).agg(*[F.sum(one).alias(f"_n_{n}") for n, one in ones.items()])
    cut = _with_buckets(counts, by, value, None, profile)
    cut = _with_offsets(cut, by, profile, {f"_before_{n}": F.sum(f"_n_{n}") for n in ones})
    w = W.partitionBy(*by, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    rank = lambda n: F.sum(f"_n_{n}").over(w) + F.col(f"_before_{n}") - (F.col(f"_n_{n}") - 1) / 2.0
    ranked = cut.select(*[F.col(c).alias(f"_{c}") for c in [*by, value]], *[rank(n).cast("double").alias(n) for n in ones])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, value]]
    out = df.join(ranked, same, "inner").drop(*[f"_{c}" for c in [*by, value]])
    return out.withColumns({n: F.when(holds[n], F.col(n)) for n in ones if n != name}) if among else out


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form (ids, indicator, value) without the missing values."""
    long = df.unpivot(
        list(ids), [F.col(c).cast("double").alias(c) for c in columns], "indicator", "value"
    )
    return long.where(F.col("value").isNotNull())


#: Values that one group may hold in the buffers of one aggregate, over all columns.
BUFFER_VALUES = 1_000_000


def percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = DEFAULT_BY,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Exact linear-interpolated percentiles, one array column ``<c>_p`` per column and group.

    Groups whose values all fit into a buffer are sorted in one aggregate; for larger
    ones the values are found by narrowing, with buffers that do not grow with a group.
    """
    profile = ensure_profile(df, by, profile)
    if profile.max_rows * len(columns) <= min(profile.direct_rows, BUFFER_VALUES):
        probs_lit = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*by).agg(
            *[F.percentile(F.col(c).cast("double"), probs_lit).alias(f"{c}_p") for c in columns]
        )
    long = unpivot(df.select(*by, *columns), by, columns)
    found = ranked_values(long, [*by, "indicator"], probs, profile.scaled(groups=len(columns)))
    wide = found.groupBy(*by).agg(
        *[F.max(F.when(F.col("indicator") == c, F.col("p"))).alias(f"{c}_p") for c in columns]
    )
    # A group without any valid value still gets a row.
    return df.select(*by).distinct().join(wide, list(by), "left")


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str], profile: GroupProfile | None = None) -> DataFrame:
    """Exact medians per group."""
    p = percentiles(df, columns, [0.5], by, profile)
    return p.select(*by, *[F.col(f"{c}_p")[0].alias(c) for c in columns])
