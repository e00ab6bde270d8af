"""All registered queries."""

from __future__ import annotations

from heatloom.plans import (  # noqa: F401
    catalog_downscale, catalog_forecast, catalog_index, catalog_planning, catalog_scenes, catalog_spatial,
)
from heatloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
