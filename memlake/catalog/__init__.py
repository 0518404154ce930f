"""Registered queries over the shared test tables, each with equal SQL where SQL can say it."""

from memlake.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
