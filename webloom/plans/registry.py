"""All registered queries of the core and their equivalent SQL."""

from __future__ import annotations

from webloom.plans import frontiers, rollups, searches, streams, urls  # noqa: F401  (they register themselves)
from webloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
