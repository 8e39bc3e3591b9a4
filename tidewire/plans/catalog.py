"""All core queries by name, and the SQL that states the same result."""

from __future__ import annotations

from . import aggregates, claims, discovery, graph, joins, projections, selection, textual, times  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
