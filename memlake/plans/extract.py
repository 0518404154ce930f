"""From cleaned messages to ordered day transcripts, day counts and markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import timeaxis
from memlake.operators.merging import union_distinct
from memlake.operators.prefix import id_bucket, ordinal, time_bucket
from memlake.settings import DEFAULTS, Settings
from memlake.sources import message_log, message_tables

DAY = ["agent_id", "memory_date"]


def with_days(messages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return (messages.withColumn("memory_date", timeaxis.logical_day(F.col("ts"), settings))
            .withColumn("hhmm", timeaxis.local_hhmm(F.col("ts"), settings)))


def order_turns(turns: DataFrame, ties: tuple[str, ...] = ("message_id",)) -> DataFrame:
    """Number the turns of an agent-day by time, session and `ties`, from 0.

    Timestamps count to the second, as in the stored day transcripts.
    """
    second = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return ordinal(turns, DAY, [time_bucket("ts")], [second, F.col("session_id"), *[F.col(t) for t in ties]])


def day_stats(messages: DataFrame, tool_calls: DataFrame | None = None) -> DataFrame:
    """Turn and tool-call counts per agent-day.

    Give every in-window message of a message log, also those without text; for
    message tables give the kept turns only.
    """
    stats = messages.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("total_turns"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"))
    if tool_calls is None:
        return stats.withColumn("tools_called_count", F.lit(0).cast("bigint"))
    calls = tool_calls.groupBy(*DAY).agg(F.count(F.lit(1)).alias("tools_called_count"))
    return stats.join(calls, DAY, "left").fillna(0, ["tools_called_count"])


def tool_items(classified: DataFrame, order: list[str]) -> DataFrame:
    """Distinct files, commands and tools of an agent-day, one row each, numbered by first use.

    Rows instead of arrays: a day's commands have no bound. The first use is a
    partial aggregate; numbering then orders distinct items only.
    """
    used = classified.select(*DAY, *order, F.explode(F.array(
        F.struct(F.lit("tools_used").alias("kind"), F.col("tool_name").alias("item")),
        F.struct(F.col("kind").alias("kind"), F.col("item").alias("item")))).alias("_u")).select(
        *DAY, *order, "_u.*").filter("item is not null")
    first = used.groupBy(*DAY, "kind", "item").agg(F.min(F.struct(*order)).alias("first_use"))
    lead = F.col(f"first_use.{order[0]}")
    is_time = first.schema["first_use"].dataType[order[0]].dataType.typeName().startswith("timestamp")
    bucket = time_bucket(lead) if is_time else id_bucket(lead)
    return ordinal(first, [*DAY, "kind"], [bucket], [F.col("first_use"), F.col("item")], name="position")


def day_markers(turns_per_day: DataFrame, first_day: Column | None = None, last_day: Column | None = None,
                max_low_turns: int = 1) -> DataFrame:
    """Markers for days without conversation and days too thin to summarise.

    `turns_per_day` has `total_turns` and `user_turns`. Every agent's calendar
    spans its own first to last day unless bounds are given.
    """
    span = turns_per_day.groupBy("agent_id").agg(
        (F.min("memory_date") if first_day is None else F.first(first_day)).alias("_from"),
        (F.max("memory_date") if last_day is None else F.first(last_day)).alias("_to"))
    calendar = span.select("agent_id", F.explode(F.sequence("_from", "_to")).alias("memory_date"))
    marker = (F.when(F.coalesce("total_turns", F.lit(0)) == 0, "noconversation")
               .when(F.col("user_turns") <= max_low_turns, "nocontent"))
    return (calendar.join(turns_per_day.select(*DAY, "total_turns", "user_turns"), DAY, "left")
            .select(*DAY, marker.alias("marker")).filter("marker is not null"))


def merge_transcript(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Fold late turns into stored days; equal turns are kept once and days are renumbered.

    Both sides have the turn columns; `remap` (below) gives old to new numbers.
    """
    identity = [*DAY, "session_id", "ts", "hhmm", "role", "content", "message_type"]
    merged = union_distinct(existing, incoming, identity, "turn_index")
    renamed = merged.withColumnRenamed("turn_index", "old_index")
    return order_turns(renamed, ties=("origin", "old_index"))


def remap_anchors(merged: DataFrame, anchors: DataFrame) -> DataFrame:
    """Follow turn anchors (peaks, hints) of existing days to their new numbers after a merge."""
    moved = merged.filter("origin = 0").select(*DAY, F.col("old_index").alias("turn"), "turn_index")
    return anchors.join(moved, [*DAY, "turn"]).drop("turn").withColumnRenamed("turn_index", "turn")


def initial_status() -> Column:
    """Status of a day just written: only the creation time is set."""
    flags = []
    for flag in ("initialized", "filled", "archived", "trimmed", "restored"):
        begun = flag == "initialized"
        flags += [F.lit(begun).alias(flag),
                  (F.current_timestamp() if begun else F.lit(None).cast("timestamp")).alias(f"{flag}_at")]
    return F.struct(*flags)


def extract_log_days(messages: DataFrame, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """All day tables of a message log: turns, stats, tool items, L2 and L1 rows, markers."""
    ties = [c for c in ("file_block", "line_id", "message_id") if c in messages.columns]
    dated = with_days(messages, settings)
    calls = message_tables.classify_tool_call(message_log.log_tool_calls(dated), from_log=True)
    turns = order_turns(message_log.clean_messages(dated), ties=tuple(ties))
    return _day_tables(turns, day_stats(dated, calls), tool_items(calls, ["ts", *ties]))


def extract_table_days(messages: DataFrame, sessions: DataFrame, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """The same from message tables. `messages` may carry `tool_calls` and `agent_id`."""
    joined = message_tables.drop_compaction_replay(message_tables.join_messages(messages, sessions))
    turns = order_turns(with_days(message_tables.clean_messages(joined), settings))
    timed = messages.withColumn("ts", F.timestamp_seconds("timestamp")).withColumnRenamed("id", "message_id")
    calls = message_tables.classify_tool_call(message_tables.tool_calls(with_days(timed, settings)))
    return _day_tables(turns, day_stats(turns, calls), tool_items(calls, ["ts", "message_id", "call_pos"]))


def _day_tables(turns: DataFrame, stats: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    from memlake.plans.write import l1_skeleton

    l2_days = turns.select(*DAY).distinct().withColumn("status", initial_status())
    return {"turns": turns, "day_stats": stats, "tool_items": items, "l2_days": l2_days,
            "l1_days": l1_skeleton(stats), "day_markers": day_markers(stats)}
