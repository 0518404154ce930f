"""Streams: session registration, day transcripts with late turns, live counts.

A batch writes its own rows only, as partitions (month, batch) of the table, and
the batch's number is published in the same moment, so that a batch that runs
again after a crash changes nothing. The readers below merge the batches of a
month; `compact` folds them into one. The table is the state: a row of any age
counts, and what a batch costs is the size of the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from memlake.functions import timeaxis
from memlake.plans.extract import order_turns, with_days
from memlake.session import materialize
from memlake.settings import DEFAULTS, Settings
from memlake.sources import tables
from memlake.sources.snapshots import Change, Store

DAY = ["agent_id", "memory_date"]
BY = ("memory_month", "batch")
#: The batch number of rows that `compact` has folded.
BASE = -1
COUNTS = ("total_turns", "user_turns", "assistant_turns")


def _append(path: str, rows: DataFrame, number: int, marks: dict | None = None) -> None:
    """Add the rows of a batch, once."""
    store = Store(rows.sparkSession, path)
    if (store.mark("batch") if store.mark("batch") is not None else -1) >= number:
        return
    rows = tables.with_month(rows).withColumn("batch", F.lit(number).cast("bigint"))
    store.publish({tables.TABLE: Change(rows, BY)}, {**(marks or {}), "batch": number})


def compact(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], most: int = 16) -> list[str]:
    """Fold months with more than `most` batches into one; returns those months.

    `merge` is the merge of the table's reader: `merge_sessions`, `merge_turns` or
    `merge_day_stats`.
    """
    from memlake.sources.snapshots import part_values

    store = Store(spark, path)
    months: dict[str, list[str]] = {}
    for name in store.parts(tables.TABLE):
        months.setdefault(part_values(name)["memory_month"], []).append(name)
    crowded = {m: names for m, names in months.items() if len(names) > most}
    if crowded:
        columns = store.read(tables.TABLE).columns
        rows = merge(store.read(tables.TABLE, {"memory_month": crowded}).drop("memory_month", "batch"))
        rows = tables.with_month(rows).withColumn("batch", F.lit(BASE).cast("bigint")).select(columns)
        store.publish({tables.TABLE: Change(rows, BY, emptied=tuple(n for names in crowded.values() for n in names))})
    return sorted(crowded)


# --- sessions ---------------------------------------------------------------------------------

def stream_session_registry(messages: DataFrame, path: str, settings: Settings = DEFAULTS) -> DataStreamWriter:
    """Keep the session registry table at `path` current from a message stream; read it with `read_sessions`."""
    dated = messages.withColumn("memory_date", timeaxis.logical_day(F.col("ts"), settings))

    def fold(batch: DataFrame, number: int) -> None:
        _append(path, batch.groupBy(*DAY, "session_id").agg(F.min("ts").alias("first_seen")), number)

    return dated.writeStream.outputMode("append").foreachBatch(fold)


def merge_sessions(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DAY, "session_id").agg(F.min("first_seen").alias("first_seen"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions per day with their earliest sighting."""
    return merge_sessions(tables.read(spark, path))


# --- turns ------------------------------------------------------------------------------------

def stream_turns_to_days(turns: DataFrame, path: str, settings: Settings = DEFAULTS, late_path: str | None = None,
                         delay: str = "1 day") -> DataStreamWriter:
    """Fold turns into their day, late ones too; read the days with `read_turns`.

    No row is dropped for its age: turns that are more than `delay` older than
    the newest stored one are also appended to the table at `late_path`, from
    which `late_turns.fold_late_turns` brings written days up to date.
    """
    dated = with_days(turns, settings)

    def fold(batch: DataFrame, number: int) -> None:
        batch = materialize(batch.dropDuplicates(["agent_id", "session_id", "message_id"]))
        store = Store(batch.sparkSession, path)
        newest = store.mark("newest")
        # One number a batch goes to the driver, and is published with the batch.
        latest = batch.agg(F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first()[0]
        if late_path and newest is not None:
            bound = F.timestamp_micros(F.lit(newest)) - F.expr(f"interval {delay}")
            _append(late_path, batch.filter(F.col("ts") < bound), number)
        known = [t for t in (newest, latest) if t is not None]
        _append(path, batch, number, {"newest": max(known)} if known else None)

    return dated.writeStream.outputMode("append").foreachBatch(fold)


def merge_turns(rows: DataFrame) -> DataFrame:
    """Turns with repeated deliveries as one, that of the least message."""
    identity = [c for c in rows.columns if c not in ("message_id", "memory_month", "batch")]
    return rows.groupBy(*identity).agg(F.min("message_id").alias("message_id"))


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """All days' turns, each repeated delivery once, numbered within the day."""
    return order_turns(merge_turns(tables.read(spark, path)))


# --- counts -----------------------------------------------------------------------------------

def stream_day_stats(turns: DataFrame, path: str, settings: Settings = DEFAULTS) -> DataStreamWriter:
    """Keep counts per agent-day current at `path`, whatever the age of a turn; read them with `read_day_stats`."""
    dated = with_days(turns, settings)

    def fold(batch: DataFrame, number: int) -> None:
        _append(path, batch.groupBy(*DAY).agg(
            F.count(F.lit(1)).alias("total_turns"), F.count_if(F.col("role") == "user").alias("user_turns"),
            F.count_if(F.col("role") == "assistant").alias("assistant_turns")), number)

    return dated.writeStream.outputMode("append").foreachBatch(fold)


def merge_day_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DAY).agg(*[F.sum(c).alias(c) for c in COUNTS])


def read_day_stats(spark: SparkSession, path: str) -> DataFrame:
    """Counts per agent-day."""
    return merge_day_stats(tables.read(spark, path))
