"""End-to-end jobs: from cells to risk, and from plans to prescriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from heatloom import constants as C
from heatloom.operators import index, risk
from heatloom.operators.groups import DEFAULT_BY, GroupProfile, ensure_profile
from heatloom.operators.rundir import stage
from heatloom.operators.summaries import assert_valid, validate_bands
from heatloom.operators.weights import Weights


def risk_index(
    cells: DataFrame,
    method: str = "equal",
    by: Sequence[str] = DEFAULT_BY,
    user_weights: Weights | None = None,
    beta: Column | float | str = C.BETA_BY_ZONE["A"],
    cdr: Column | float | str = C.CDR_DEFAULT,
    event_days: float = C.EVENT_DAYS,
    lam: float = C.LAMBDA_HVI,
    keep: Sequence[str] = ("cell_id", "lon", "lat"),
    validate: bool = False,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Vulnerability index, risk index and expected deaths of every cell.

    The groups are measured once for all steps.  The vulnerability index is
    written before the risk steps, which read only the columns they need.
    """
    profile = ensure_profile(cells, by, profile)
    if validate:
        assert_valid(validate_bands(cells, by, profile))
    carried = list(dict.fromkeys([*keep, "lst", "population"]))
    indexed = stage(index.hvi(cells, method, by, user_weights, profile, keep=carried), "index")
    return risk.hri_pipeline(indexed, by, beta, cdr, event_days, lam, profile=profile)
