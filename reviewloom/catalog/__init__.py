"""The registered queries and their oracle statements."""

from __future__ import annotations


def _modules():
    from reviewloom.catalog import run_queries, summary_queries, text_queries, vector_queries

    return [text_queries, vector_queries, summary_queries, run_queries]


def queries() -> dict:
    return {name: run for module in _modules() for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLE.items()}
