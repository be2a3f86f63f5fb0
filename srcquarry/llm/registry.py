"""All queries of this subpackage, with the SQL they are checked against."""

from __future__ import annotations

from . import doc_pair_queries, mixing_queries, origin_queries, packing_queries, reading_queries, secret_queries, split_queries, validity_queries

_MODULES = [doc_pair_queries, secret_queries, split_queries, validity_queries, origin_queries, packing_queries, mixing_queries, reading_queries]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
