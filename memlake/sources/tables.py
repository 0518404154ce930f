"""Partitioned tables: read, replace partitions, delete rows. Each is a store of its own (`snapshots`)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.sources.snapshots import Change, Store

TABLE = "rows"


def exists(spark: SparkSession, path: str) -> bool:
    return Store(spark, path).has(TABLE)


def read(spark: SparkSession, path: str, only: dict[str, Iterable] | None = None) -> DataFrame:
    """The table's current version; `only` (partition column to values) leaves out partitions unread."""
    return Store(spark, path).read(TABLE, only)


def with_month(df: DataFrame, day: str = "memory_date") -> DataFrame:
    return df.withColumn("memory_month", F.date_format(day, "yyyy-MM"))


def write_layer(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace the partitions that occur in `df`; all others stay.

    Readers see the old rows until all new ones are written. `df` may be computed
    from the table itself.
    """
    Store(df.sparkSession, path).publish({TABLE: Change(df, tuple(partition_by))})


def delete_rows(spark: SparkSession, path: str, doomed: DataFrame, keys: list[str]) -> int:
    """Delete rows by key, null keys included. Only partitions that hold such rows are rewritten; returns how many are gone."""
    return Store(spark, path).drop_rows(TABLE, doomed, keys)


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove what only versions before the last `keep` use."""
    return Store(spark, path).expire(keep)
