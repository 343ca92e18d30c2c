"""Names of the registered queries."""

from __future__ import annotations

from . import document_queries, drawing_queries, scale_queries, selection_queries, sheet_queries, stream_queries

_MODULES = (document_queries, drawing_queries, sheet_queries, scale_queries, selection_queries, stream_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
