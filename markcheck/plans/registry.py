"""Named queries over the standard tables, with their DuckDB equivalents."""

from __future__ import annotations

from markcheck.plans import extraction, positions, reports

_MODULES = (extraction, positions, reports)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
