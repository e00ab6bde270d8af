"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys; within a source they are taken in key order until
the source's budget is used up, over as many epochs as the budget needs.  The
prefix sums are distributed: sizes are summed per (source, first digits of the
key), the running total over those few sums finds the one key range in which the
budget ends, and only the rows of that range are summed one by one.  So no task
holds a source, however large, and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from heatloom.llm.common import random_key, word_count
from heatloom.operators.rundir import stage

#: Hex digits of the key that name a key range; 4,096 ranges for each source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """Target of every source: (source, source_size) -> the same with target.

    Sources in code point order (NULL last) get the weights in turn.  ``share`` of
    all sizes is dealt by weight; no target is above ``epochs`` times the source's
    size, and what is cut off is dealt again by weight.  With sources ordered by
    cap per weight, the common level is the largest of the levels that result when
    the first sources are held at their caps.  One row per source passes here.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("_cap_per_weight", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    return (
        sizes.withColumn("_w", F.element_at(w, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
        .withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("_cap_per_weight", F.col("_cap") / F.col("_w"))
        .withColumn("_level", (
            F.sum("source_size").over(everything) * F.lit(float(share))
            - F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        ) / F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("target", F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("_w")))
        .select("source", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0,
    size: Column | None = None,
) -> DataFrame:
    """All documents with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_taken``.

    ``docs`` needs doc_id, source and text (or ``size``, a non-negative column); its
    other columns are kept, and input columns named mix_* are replaced.
    ``mix_taken`` is the part of the mix that a document gives, repeats counted: its
    size times the whole epochs, plus what the last, partial epoch takes. The
    document at the cut gives a part of itself, so every source's sum is its target,
    rounded down.  NULL texts have size 0, a NULL source is a source of its own,
    repeated rows count each, an empty table stays empty.
    """
    size = word_count(F.col("text")) if size is None else size
    names = [c for c in docs.columns if not c.startswith("mix_")]
    keyed = docs.select(
        *names, size.alias("mix_size"), random_key("doc_id").alias("mix_key"),
    ).withColumn("mix_range", F.substring("mix_key", 1, RANGE_DIGITS))
    ranges = stage(
        keyed.groupBy("source", "mix_range").agg(F.sum("mix_size").alias("range_size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, epochs)
    budget = targets.withColumn("_budget", F.floor("target")).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(F.lit(0))
    ).withColumn("rest", F.col("_budget") - F.col("whole") * F.col("source_size"))
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("mix_range")) - F.col("range_size")
    ends = ranges.withColumn("cut_before", before).withColumnRenamed("source", "_s")
    cut = stage(
        budget.join(
            ends, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cut_before") <= F.col("rest"))
            & (F.col("rest") < F.col("cut_before") + F.col("range_size")), "left",
        ).select(
            F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"),
            F.col("target").alias("mix_target"), F.col("whole").alias("mix_whole"), F.col("rest").alias("mix_rest"),
            F.coalesce("mix_range", F.lit("")).alias("mix_cut"), F.coalesce("cut_before", F.lit(0)).alias("mix_before"),
        ), "mix-cut")
    joined = keyed.join(cut, F.col("source").eqNullSafe(F.col("mix_source")))
    base = F.col("mix_size") * F.col("mix_whole")
    sure = joined.where("mix_range <> mix_cut").withColumn(
        "mix_taken", base + F.when(F.col("mix_range") < F.col("mix_cut"), F.col("mix_size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("mix_key", "mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("mix_rest") - F.col("mix_before") - (F.sum("mix_size").over(order) - F.col("mix_size"))
    at_cut = joined.where("mix_range = mix_cut").withColumn(
        "mix_taken", base + F.greatest(F.lit(0), F.least(F.col("mix_size"), left)))
    cols = [*names, "mix_size", "mix_source_size", "mix_target", "mix_taken"]
    return sure.select(*cols).unionAll(at_cut.select(*cols))


def repeat_taken(mixed: DataFrame) -> DataFrame:
    """The rows of a mix: every document as often as it is taken, the last copy cut to the words taken.

    Documents of which nothing is taken, and those without words, go.  Texts keep
    their white space up to the cut; ``n_chars``, where there is one, follows the text.
    """
    names = [c for c in mixed.columns if not c.startswith("mix_")]
    copies = F.ceil(F.col("mix_taken") / F.col("mix_size")).cast("int")
    out = mixed.where("mix_size > 0 and mix_taken > 0").withColumn(
        "mix_copy", F.explode(F.sequence(F.lit(1), copies))
    ).withColumn("mix_words", F.col("mix_taken") - (F.col("mix_copy") - 1) * F.col("mix_size"))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("mix_words").cast("int")), "")
    out = out.withColumn("text", F.when(F.col("mix_words") < F.col("mix_size"), cut).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(
            F.col("mix_words") < F.col("mix_size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names)
