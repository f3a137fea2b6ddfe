"""Every registered query of the curve domain with its oracle SQL."""

from __future__ import annotations

from ridgeline.plans import curve_queries, design_queries, model_queries, source_queries, table_queries  # noqa: F401
from ridgeline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
