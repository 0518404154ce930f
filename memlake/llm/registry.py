"""Registration of this subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from memlake.session import small_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            small_batches(spark)
            return function(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return add
