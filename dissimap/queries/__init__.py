"""Queries over the test tables and the same in SQL: each module has QUERIES and SQL by name."""

from __future__ import annotations

from dissimap.queries import graphs, map_statistics, relational, skew, solvers, steps
from dissimap.queries.solvers import flagship

MODULES = [skew, relational, solvers, map_statistics, graphs, steps]

__all__ = ["all_queries", "all_sql", "flagship"]


def all_queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
