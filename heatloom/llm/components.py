"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from heatloom.operators.rundir import stage


def _least_neighbours(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links in both directions, and the least of each node and its neighbours."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
    return both, least


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): root is the least node reachable; nodes without links are not listed.

    Alternates the large-star and the small-star step until the links are stars,
    which takes a number of rounds logarithmic in the longest path. Every round is
    written to the shared folder, so a lost executor costs one round. Both steps
    join on the node, where adaptive execution splits a hot one; no neighbourhood is
    ever collected.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both, least = _least_neighbours(edges)
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "large-star")
        # small star: each node hands its smaller neighbours, and itself, to the least of them
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        joined = large.join(least, F.col("a") == F.col("node"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
        new = stage(small.where("a <> b").distinct(), "small-star")
        # stars: every node has one link, and no root hangs on another node
        roots = new.select(F.col("b").alias("root")).distinct()
        n, kinds, chained = new.agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("k")).first() + (
            new.join(roots, F.col("a") == F.col("root"), "left_semi").count(),)
        edges = new
        if n == kinds and chained == 0:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
