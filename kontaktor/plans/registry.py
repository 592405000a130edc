"""Every query by name, and the SQL that a second engine runs for it."""

from __future__ import annotations

from . import fetch_queries, pages_queries, search_queries, text_queries

MODULES = (pages_queries, fetch_queries, search_queries, text_queries)


def queries() -> dict:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
