"""Exact order statistics of groups of any size, with buffers of bounded size.

A value of a wanted rank is found by narrowing: a bounded sketch proposes points near
the rank, exact counts tell on which side of them it lies, and only the values between
two neighbouring points are looked at again.  Each round leaves about one value in three
hundred; when few are left they are sorted.  A frequent value is a point itself or
leaves no more than its share, so ties do not stop the narrowing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from heatloom.functions.basic import lerp
from heatloom.operators.groups import GroupProfile
from heatloom.operators.rundir import stage

#: Points proposed in a round, accuracy of the sketch, and values that are sorted in one buffer.
GRID, ACCURACY, SORTED_VALUES = 1_000, 10_000, 5_000


def _inside() -> Column:
    """Between the bounds of the target, which are not part of it; a missing bound is no bound."""
    v = F.col("value")
    return F.coalesce(v > F.col("_lo"), F.lit(True)) & F.coalesce(v < F.col("_hi"), F.lit(True))


def _with_targets(long: DataFrame, targets: DataFrame, keys: Sequence[str], profile: GroupProfile, n_targets: int) -> DataFrame:
    side = targets.select(*keys, "_t", "_k", "_lo", "_hi", "_below", "_in")
    few = profile.n_groups * n_targets <= profile.broadcast_groups
    return long.join(F.broadcast(side) if few else side, list(keys)).where(_inside())


def _narrowed(long: DataFrame, targets: DataFrame, keys: list[str], profile: GroupProfile, n_targets: int) -> DataFrame:
    """The targets after one round: found, or with closer bounds."""
    named = [*keys, "_t"]
    probs = [i / GRID for i in range(1, GRID)]
    grid = _with_targets(long, targets, keys, profile, n_targets).groupBy(*named).agg(
        F.percentile_approx("value", probs, ACCURACY).alias("_grid"))
    place = (F.col("_k") - F.col("_below")) / F.col("_in") * GRID
    point = lambda i: F.get("_grid", i.cast("int"))  # noqa: E731  NULL outside
    proposed = stage(targets.join(grid, named).withColumns({"_a": point(F.floor(place) - 4), "_b": point(F.ceil(place) + 2)}).drop("_grid"), "quantile-points")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    v, a, b = F.col("value"), F.col("_a"), F.col("_b")
    rows = _with_targets(long, targets, keys, profile, n_targets).drop("_k", "_lo", "_hi", "_below", "_in")
    points = proposed.select(*named, "_a", "_b")
    few = profile.n_groups * n_targets <= profile.broadcast_groups
    counted = rows.join(F.broadcast(points) if few else points, named).groupBy(*named).agg(
        count(v < a).alias("_lt_a"), count(v == a).alias("_eq_a"), count(v < b).alias("_lt_b"), count(v == b).alias("_eq_b"))
    rank = F.col("_k") - F.col("_below")
    upto_a, upto_b = F.col("_lt_a") + F.col("_eq_a"), F.col("_lt_b") + F.col("_eq_b")
    # where the rank lies: before a, at a, between, at b, behind b
    zone = (
        F.when(a.isNotNull() & (rank < F.col("_lt_a")), 0).when(a.isNotNull() & (rank < upto_a), 1)
        .when(b.isNull() | (rank < F.col("_lt_b")), 2).when(rank < upto_b, 3).otherwise(4))
    after = proposed.join(counted, named).withColumn("_z", zone)
    z = F.col("_z")
    return after.select(
        *named, "_k",
        F.when(z == 0, F.col("_lo")).when(z == 2, F.coalesce(a, F.col("_lo"))).when(z == 4, b).alias("_lo"),
        F.when(z == 0, a).when(z == 2, F.coalesce(b, F.col("_hi"))).when(z == 4, F.col("_hi")).alias("_hi"),
        (F.col("_below") + F.when(z == 0, 0).when(z <= 2, upto_a).otherwise(upto_b)).alias("_below"),
        F.when(z == 0, F.col("_lt_a")).when(z == 2, F.when(b.isNull(), F.col("_in")).otherwise(F.col("_lt_b")) - upto_a)
        .when(z == 4, F.col("_in") - upto_b).otherwise(0).alias("_in"),
        F.when(z == 1, a).when(z == 3, b).alias("_value"))


def ranked_values(long: DataFrame, keys: Sequence[str], probs: Sequence[float], profile: GroupProfile, sorted_values: int = SORTED_VALUES) -> DataFrame:
    """(keys, p): linear-interpolated percentiles of ``value`` per group, missing values left out, NaN above all others."""
    keys = list(keys)
    long = long.where(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("value"))
    nan = F.isnan("value")
    sizes = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(nan, 1)).alias("_nan"))
    long = long.where(~nan)
    rank = lambda p, f: f(F.lit(float(p)) * (F.col("_n") - 1)).cast("long")
    wanted = F.array(*[F.struct(F.lit(2 * i + j).alias("t"), rank(p, f).alias("k")) for i, p in enumerate(probs) for j, f in enumerate((F.floor, F.ceil))])
    sizes = stage(sizes, "quantile-sizes")
    targets = sizes.select(*keys, "_n", "_nan", F.explode(wanted).alias("_w")).select(
        *keys, F.col("_w.t").alias("_t"), F.col("_w.k").alias("_k"), F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi"),
        F.lit(0).cast("long").alias("_below"), (F.col("_n") - F.col("_nan")).alias("_in"),
        F.when(F.col("_k") >= F.col("_n") - F.col("_nan"), float("nan")).alias("_value"))
    found, n = [], 2 * len(probs)
    while True:
        targets = stage(targets, "quantile-targets")
        found.append(targets.where(F.col("_value").isNotNull()).select(*keys, "_t", "_value"))
        targets = targets.where(F.col("_value").isNull())
        most = targets.agg(F.max("_in")).first()[0] or 0
        if most <= sorted_values:
            break
        targets = _narrowed(long, targets, keys, profile, n)
    if most:
        rest = _with_targets(long, targets, keys, profile, n).groupBy(*keys, "_t").agg(
            F.array_sort(F.collect_list("value")).alias("_v"), F.first("_k").alias("_k"), F.first("_below").alias("_below"))
        found.append(rest.select(*keys, "_t", F.get("_v", (F.col("_k") - F.col("_below")).cast("int")).alias("_value")))
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    by_target = whole.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_t", "_value"))).alias("_m"))
    at = lambda t: F.try_element_at("_m", F.lit(t))
    part = lambda p: F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1))
    between = lambda lo, hi, f: F.when(lo == hi, lo).otherwise(lerp(lo, hi, f))
    values = F.array(*[between(at(2 * i), at(2 * i + 1), part(p)) for i, p in enumerate(probs)])
    return by_target.join(sizes, keys).select(*keys, values.alias("p"))
