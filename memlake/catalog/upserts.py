"""Upserts, merges and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.catalog import fixtures as fx
from memlake.catalog.lifecycle import stored_index
from memlake.catalog.registry import query
from memlake.operators import landmarks, merging
from memlake.plans import write


def _date():
    return F.col("memory_date").cast("string").alias("memory_date")



@query("l0_upsert", """
SELECT agent_id, time_key, CASE WHEN d % 2 = 1 AND d % 3 <> 0 THEN 'stored' ELSE summary END AS summary,
       CASE WHEN d % 2 = 1 THEN access_count ELSE 0 END AS access_count, time_key || '|0|surface|' || time_key AS ord_key FROM fx_l0""", ("fx_l0",))
def l0_upsert(spark, sf):
    """Every second day is stored; a run writes the others, and every third anew."""
    d = F.datediff("memory_date", F.lit("2023-12-01").cast("date"))
    fresh = write.index_rows(fx.l1_days(spark, sf).filter((d % 2 == 0) | (d % 3 == 0)))
    old = stored_index(spark, sf).withColumn("summary", F.lit("stored"))
    return merging.upsert_index(old, fresh).select("agent_id", "time_key", "summary", "access_count", "ord_key")


@query("index_order_after_rollup", """
SELECT agent_id, doc_id, CASE depth WHEN 'deep' THEN time_key || '|0|deep|' WHEN 'shallow' THEN time_key || '|1|shallow|' ELSE time_key || '|2|surface|' END || time_key AS ord_key
FROM fx_memories""", ("fx_memories",))
def index_order_after_rollup(spark, sf):
    rows = fx.memories(spark, sf).withColumn("window_date_start", F.lit(None).cast("string"))
    return merging.order_index(rows, "deep").select("agent_id", "doc_id", "ord_key")


_EMBED = "'摘要：' || regexp_replace(first_text, '^\\s+|\\s+$', '', 'g') || chr(10) || '标签：' || agent_id || ', ' || kind || chr(10) || '情绪：' || kind"


@query("embedding_upsert", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS time_key, {_EMBED} AS text_used,
       CASE WHEN d % 6 = 1 THEN '-1,-1' ELSE length({_EMBED}) || ',' || (length({_EMBED}) - length(replace({_EMBED}, 'e', ''))) END AS embedding
FROM fx_l1""", ("fx_l1",))
def embedding_upsert(spark, sf):
    """Stored vectors are current for some days and stale for the others; only stale ones are computed.

    The vector is the text's length and its number of `e`.
    """
    index = write.with_embed_text(fx.l0_index(spark, sf))
    current = F.datediff("time_key", F.lit("2023-12-01").cast("date")) % 6 == 1
    old = index.select("agent_id", "depth", "time_key",
                       F.when(current, F.col("text_used")).otherwise("stale").alias("text_used"),
                       F.array(F.lit(-1.0), F.lit(-1.0)).alias("embedding"))
    plain = lambda rows: rows.withColumn("embedding", F.array(
        F.length("text_used").cast("double"), (F.length("text_used") - F.length(F.replace("text_used", F.lit("e"), F.lit("")))).cast("double")))
    merged = merging.upsert_embeddings(old, index, plain)
    return merged.select("agent_id", "time_key", "text_used", F.array_join(F.col("embedding").cast("array<bigint>").cast("array<string>"), ",").alias("embedding"))


@query("upsert_counts", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, CASE WHEN new THEN fixes ELSE 100 END AS bug_fix
FROM (SELECT agent_id, memory_date, day(memory_date) % 2 = 0 AS new, count(*) FILTER (item_type = 'bug_fix') AS fixes FROM fx_day_items GROUP BY ALL)""", ("fx_day_items",))
def upsert_counts(spark, sf):
    counts = landmarks.count_items(fx.day_items(spark, sf))
    stale = counts.withColumn("key_items", F.create_map(F.lit("bug_fix"), F.lit(100).cast("bigint")))
    merged = merging.upsert(stale, counts.filter(F.dayofmonth("memory_date") % 2 == 0), ["agent_id", "memory_date"])
    return merged.select("agent_id", _date(), F.element_at("key_items", "bug_fix").alias("bug_fix"))


@query("merge_days", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, total_turns, user_turns,
       CASE WHEN user_turns > 1 THEN first_text END AS summary, user_turns > 1 AND d % 3 <> 0 AS archived
FROM fx_days""", ("fx_days",))
def merge_days(spark, sf):
    days = fx.days(spark, sf)
    fresh = write.l1_skeleton(days.select("agent_id", "memory_date", "total_turns", "user_turns"))
    known = fx.l1_days(spark, sf).withColumn("total_turns", F.lit(1).cast("bigint"))
    merged = merging.merge_days(known, fresh)
    return merged.select("agent_id", _date(), "total_turns", "user_turns", "summary", F.col("status.archived").alias("archived"))


@query("register_weeks", """
SELECT agent_id, strftime(memory_date, '%G-W%V') AS week FROM fx_days GROUP BY ALL""", ("fx_days",))
def register_weeks(spark, sf):
    from memlake.functions import timeaxis
    weeks = fx.days(spark, sf).select("agent_id", timeaxis.week_id(F.col("memory_date")).alias("week"), "d")
    return merging.register_weeks(weeks.filter("d % 2 = 0"), weeks)


@query("prune_index", "SELECT agent_id, time_key FROM fx_l0 WHERE d % 7 <> 0", ("fx_l0",))
def prune_index(spark, sf):
    doomed = fx.l2_days(spark, sf).filter("status.trimmed").select(
        "agent_id", F.lit("surface").alias("depth"), F.col("memory_date").cast("string").alias("time_key"))
    return merging.prune(fx.l0_index(spark, sf), doomed, ["agent_id", "depth", "time_key"]).select("agent_id", "time_key")
