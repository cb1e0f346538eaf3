"""Every query by name, with its SQL twin where there is one."""

from __future__ import annotations

from . import aggregates, analysis, composites, controls, expressions, files, matching_joins, network, road_maps, streams, temporal, topology  # noqa: F401  each module enters its queries
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "gap_events"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
