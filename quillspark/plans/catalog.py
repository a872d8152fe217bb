"""Registry of the queries and of their DuckDB counterparts."""

from __future__ import annotations

from . import book_queries, extra_queries, log_queries, repair_queries, shelf_queries, state_queries, text_queries, web_queries

MODULES = (text_queries, log_queries, web_queries, extra_queries, state_queries, book_queries, repair_queries, shelf_queries)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
