"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from memlake.catalog import fixtures
from memlake.session import plain_unions

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_AREAS = ("extract", "landmark", "recalling", "chunking", "upserts", "lifecycle", "sessions", "reading", "summaries",
          "streams", "weekly", "daily")


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; `views` names the derived views its SQL reads."""
    def add(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            plain_unions(spark)  # the session may be another's than `build_session`'s
            return function(spark, sf)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = fixtures.with_views(sql, *views)
        return function

    return add


def _load() -> None:
    for area in _AREAS:
        import_module(f"memlake.catalog.{area}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
