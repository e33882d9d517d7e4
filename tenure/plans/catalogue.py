"""All queries of the library proper."""

from __future__ import annotations

from . import aggregates, equations, estimates, filters, io, joins, scalar, statistics, windows  # noqa: F401  register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
