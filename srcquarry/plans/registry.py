"""All queries of the core, with the SQL they are checked against."""

from __future__ import annotations

from . import index_queries, snapshot_queries

_MODULES = [snapshot_queries, index_queries]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
