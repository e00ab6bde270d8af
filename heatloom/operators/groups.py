"""Group size checks and joins of per-group statistics.

A statistic is computed with one aggregate per group and joined back to the
rows.  Whether its side may be broadcast, and whether a group may be handled
inside one task, depends on how many groups there are and how large the largest
one is, so both numbers are measured once and passed along.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

DEFAULT_BY = ("aoi_id",)
DIRECT_GROUP_ROWS = 2_000_000
BROADCAST_GROUPS = 200_000


@dataclass(frozen=True)
class GroupProfile:
    """Number of groups and rows of the largest group of a table.

    ``direct_rows`` is the largest group that may be sorted or buffered inside
    one task.  Larger groups are cut into ordered buckets of about that size.
    """

    n_groups: int
    max_rows: int
    direct_rows: int = DIRECT_GROUP_ROWS
    broadcast_groups: int = BROADCAST_GROUPS

    @property
    def direct(self) -> bool:
        return self.max_rows <= self.direct_rows

    @property
    def broadcastable(self) -> bool:
        return self.n_groups <= self.broadcast_groups

    @property
    def n_buckets(self) -> int:
        if self.direct:
            return 1
        return -(-self.max_rows * 2 // self.direct_rows)

    def scaled(self, groups: int = 1, rows: int = 1) -> "GroupProfile":
        """The profile after each group was copied or its rows were multiplied."""
        return replace(self, n_groups=self.n_groups * groups, max_rows=self.max_rows * rows)


def group_profile(df: DataFrame, by: Sequence[str] = DEFAULT_BY, **limits: int) -> GroupProfile:
    """Count groups and the rows of the largest one.  One job, two numbers returned."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("rows")).first()
    return GroupProfile(int(row["groups"]), int(row["rows"] or 0), **limits)


def ensure_profile(df: DataFrame, by: Sequence[str], profile: GroupProfile | None) -> GroupProfile:
    return profile if profile is not None else group_profile(df, by)


def join_stats(
    df: DataFrame, stats: DataFrame, by: Sequence[str], profile: GroupProfile, how: str = "left"
) -> DataFrame:
    """Join one row of statistics per group back to the rows of the group.

    The statistics are broadcast only while the measured number of groups is
    within the bound; beyond it a shuffled join is used, whose hot keys adaptive
    execution splits.
    """
    side = F.broadcast(stats) if profile.broadcastable else stats
    return df.join(side, list(by), how)
