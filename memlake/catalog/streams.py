"""Streaming queries: the shared tables as a stream, folded into tables and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from memlake.catalog import fixtures as fx
from memlake.catalog.registry import query
from memlake.session import checkpoint_dir
from memlake.streaming import intake


def _date():
    return F.col("memory_date").cast("string").alias("memory_date")



def _arrivals(turns):
    """The conversations in three parts, out of order: the newest first, then the oldest, long after any delay."""
    newest, oldest = turns.agg(F.max("conv_id"), F.min("conv_id")).first()
    third = ((newest or 0) - (oldest or 0)) / 3
    late, early = F.col("conv_id") < (oldest or 0) + third, F.col("conv_id") >= (oldest or 0) + 2 * third
    return [turns.filter(part) for part in (early, late, ~early & ~late)]


def _turns(rows):
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("conv_id") * 1021 + F.col("turn") * 3).cast("int"))
    return rows.select(
        F.concat(F.lit("agent_"), (F.col("conv_id") % 5).cast("string")).alias("agent_id"), F.col("conv_id").alias("session_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role",
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + minutes).alias("ts"), F.col("text").alias("content"))


def _run(spark, sf, writer_of):
    """Let the table arrive part by part, run the stream over each, and return the path of the table it wrote."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid4().hex}"
    table = fx.table(spark, sf, "conversations")
    for part in _arrivals(table):
        part.write.mode("append").parquet(f"{base}/arrived")
        stream = _turns(spark.readStream.schema(table.schema).parquet(f"{base}/arrived"))
        writer = writer_of(stream, f"{base}/table").option("checkpointLocation", f"{base}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    return f"{base}/table"


@query("stream_session_registry", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, session_id, CAST(epoch(min(ts)) AS BIGINT) AS first_seen FROM fx_day_turns GROUP BY ALL""", ("fx_day_turns",))
def stream_session_registry(spark, sf):
    table = intake.read_sessions(spark, _run(spark, sf, intake.stream_session_registry))
    return table.select("agent_id", _date(), "session_id", F.unix_timestamp("first_seen").alias("first_seen"))


@query("stream_turns_to_days", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, message_id, turn_index, content FROM fx_day_turns""", ("fx_day_turns",))
def stream_turns_to_days(spark, sf):
    path = _run(spark, sf, lambda turns, path: intake.stream_turns_to_days(turns, path, late_path=f"{path}-late"))
    return intake.read_turns(spark, path).select("agent_id", _date(), "message_id", "turn_index", "content")


@query("stream_day_stats", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, total_turns, user_turns, assistant_turns FROM fx_days""", ("fx_days",))
def stream_day_stats(spark, sf):
    path = _run(spark, sf, intake.stream_day_stats)
    intake.compact(spark, path, intake.merge_day_stats, most=1)
    return intake.read_day_stats(spark, path).withColumn("memory_date", _date())
