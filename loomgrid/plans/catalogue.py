"""Every named query of the relational operators, with its DuckDB counterpart."""

from __future__ import annotations

from loomgrid.plans import catalog, dag, events, health, metrics, scoring, search, web  # noqa: F401  (each registers its queries)
from loomgrid.plans.registry import IDS, QUERIES, SQL

__all__ = ["IDS", "QUERIES", "SQL"]
