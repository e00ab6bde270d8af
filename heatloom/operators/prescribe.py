"""From zone quantities to cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from heatloom import constants as C
from heatloom.functions.labels import code_to_name, intervention_code
from heatloom.operators.feasibility import feasibility_columns
from heatloom.operators.groups import GroupProfile, ensure_profile
from heatloom.operators.neighbors import majority_filter_sticky
from heatloom.operators.ordering import row_numbers

PLAN_KEY = ("plan_id",)


def priority_topk(
    cells: DataFrame,
    decisions: DataFrame,
    by: Sequence[str] = (),
    keys: Sequence[str] | None = None,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Intervention code of every cell.

    ``cells`` has (by, zone_id, cell_id, hri) and the feasibility indicators.
    ``decisions`` has (by, zone_id, intervention_key, k, qty).  For each zone and
    intervention the int(qty) feasible cells with the highest risk are chosen,
    ties by cell id; where a cell is chosen several times the last k wins.  A
    cell that is not chosen has code 0.
    """
    place = [*by, "zone_id"]
    rules = {k: v for k, v in feasibility_columns(cells.columns).items() if keys is None or k in keys}
    wanted = decisions.where((F.col("qty") >= 1) & F.col("intervention_key").isin(list(rules)))
    # a zone's plan has one entry per intervention, so the array is short; cells of other zones are left out
    plans = wanted.groupBy(*place).agg(F.collect_list(F.struct("intervention_key", "k", F.col("qty").cast("long").alias("_n"))).alias("_plan"))
    may = F.array_compact(F.array(*[F.when(rule, F.lit(k)) for k, rule in rules.items()]))
    planned = cells.select(*place, "cell_id", "hri", may.alias("_may")).join(plans, place)
    candidates = planned.select(*place, "cell_id", "hri", F.inline(F.filter("_plan", lambda p: F.array_contains("_may", p["intervention_key"]))))
    group = [*place, "intervention_key"]
    if profile is None:
        profile = ensure_profile(cells, place, None).scaled(groups=len(C.INTERVENTION_CODES))
    ranked = row_numbers(candidates, "hri", "cell_id", group, profile, descending=True)
    chosen = ranked.where(F.col("rn") <= F.col("_n")).withColumn("_code", intervention_code(F.col("intervention_key")))
    codes = chosen.groupBy(*place, "cell_id").agg(F.max_by("_code", "k").alias("_code"))
    joined = cells.join(codes, [*place, "cell_id"], "left")
    return joined.withColumn("code", F.coalesce("_code", F.lit(0))).drop("_code")


def prescribe(
    cells: DataFrame, decisions: DataFrame, grid_by: Sequence[str], by: Sequence[str] = (),
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Top cells per zone and intervention, then smoothed over their grid neighbours.

    ``cells`` also has row and col; ``grid_by`` names the key of a grid.
    """
    raw = priority_topk(cells, decisions, by, keys)
    smooth = majority_filter_sticky(raw, "code", grid_by)
    return raw.drop("code").join(smooth, [*grid_by, "row", "col"])


def prescription_cells(prescription: DataFrame, keep: Sequence[str] = ("cell_id", "zone_id", "lon", "lat")) -> DataFrame:
    """Cell table with code, name and risk."""
    return prescription.select(
        *keep, F.col("code").alias("intervention_code"),
        code_to_name(F.col("code")).alias("intervention_name"), F.col("hri").alias("hri_value"),
    )


def prescription_stats(prescription: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells per intervention name, with zero counts.

    The counts of all codes come out of one aggregate, so no name is lost and no
    table of names is joined.
    """
    names = list(C.INTERVENTION_CODES.items())
    counts = prescription.groupBy(*by).agg(*[
        F.count(F.when(F.col("code") == code, 1)).alias(name) for name, code in names
    ])
    return counts.unpivot(list(by), [name for name, _ in names], "intervention_name", "n_cells")


def prescription_summary(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells and mean risk per intervention name."""
    return cells.groupBy(*by, "intervention_name").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("hri_value").alias("mean_hri")
    )


def moore_best_intervention(x: DataFrame, values: str = "x") -> DataFrame:
    """Best intervention per cell of a nine-cell plan.

    ``x`` has an array of quantities per cell and a flag is_primary.  The first
    largest quantity wins; its position counts through the interventions in code
    order.
    """
    names = F.array(*[F.lit(n) for n in C.INTERVENTION_CODES if n != "none"])
    best = F.array_position(F.col(values), F.array_max(values)).cast("int")
    return x.withColumns({
        "type": F.when(F.col("is_primary"), "primary").otherwise("neighbor"),
        "intervention": F.coalesce(F.get(names, best - 1), F.lit("none")),
        "quantity": F.array_max(values),
        "weight": F.when(F.col("is_primary"), 1.0).otherwise(0.65),
    })
