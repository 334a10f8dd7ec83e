"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from .plans import coverage, geometry, network, observations, review, routes, selection, sets, streams, trips
from .plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "operating_summary"
MODULES = (trips, sets, coverage, network, geometry, streams, review, selection, routes)
__all__ = ["FLAGSHIP", "MODULES", "ORACLE_SQL", "QUERIES"]
