"""All queries of the core library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import catalog, differences, live, retrieval, upkeep

_PLANS = (differences, catalog, retrieval, upkeep, live)
QUERIES: dict = {name: f for p in _PLANS for name, f in p.QUERIES.items()}
SQL: dict[str, str] = {name: s for p in _PLANS for name, s in p.SQL.items()}
