"""Exact and recent recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.catalog import fixtures as fx
from memlake.catalog.registry import query
from memlake.functions.text import middle_trim
from memlake.operators import slices as sl
from memlake.plans import exact, recent

BUDGET = 10_000
TODAY = "2024-02-20"


def _slices(spark, sf):
    """One slice per source: its documents as alternating turns, strings as they are."""
    turns = fx.long_turns(spark, sf).select(
        F.col("agent_id").alias("slice_id"), F.col("turn_index").alias("pos"), "role",
        F.col("length").alias("content_length"), (F.col("length") + F.length("role") + 3).cast("bigint").alias("line_length"))
    return turns


_LINES = """SELECT agent_id AS slice_id, turn_index AS pos, role, length, length + length(role) + 3 AS line FROM fx_long_turns"""


@query("drop_shortest", f"""
SELECT slice_id, pos FROM (SELECT *, sum(line) OVER (PARTITION BY slice_id) AS total,
  coalesce(sum(CASE WHEN role = 'assistant' THEN line END) OVER (PARTITION BY slice_id, role ORDER BY length, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM ({_LINES})) WHERE role <> 'assistant' OR total - gone <= {BUDGET}""", ("fx_long_turns",))
def drop_shortest(spark, sf):
    return sl.drop_shortest_assistant(_slices(spark, sf), BUDGET).select("slice_id", "pos")


@query("stride_downsample", f"""
, sums AS (SELECT slice_id, n, stride, sum(line) AS total FROM (
    SELECT *, unnest(range(2, n + 1)) AS stride FROM (SELECT *, count(*) OVER (PARTITION BY slice_id) AS n FROM ({_LINES})))
  WHERE pos % stride = 0 OR pos = n - 1 GROUP BY ALL)
SELECT l.slice_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY slice_id) AS n FROM ({_LINES})) l
LEFT JOIN (SELECT slice_id, min(stride) AS stride FROM sums WHERE total <= {BUDGET} GROUP BY slice_id) s USING (slice_id)
WHERE n <= 2 OR pos % coalesce(stride, n) = 0 OR pos = n - 1""", ("fx_long_turns",))
def stride_downsample(spark, sf):
    return sl.stride_downsample(_slices(spark, sf), BUDGET).select("slice_id", "pos")


@query("middle_trim", """
SELECT doc_id, CASE WHEN length(text) <= n THEN text WHEN n <= 8 THEN left(text, n)
  ELSE left(text, CAST(floor((n - 3) * 0.6) AS INT)) || '...' || right(text, n - 3 - CAST(floor((n - 3) * 0.6) AS INT)) END AS trimmed
FROM (SELECT *, CAST(4 + doc_id % 97 AS INT) AS n FROM documents)""")
def middle_trimmed(spark, sf):
    length = (4 + F.col("doc_id") % 97).cast("int")
    return fx.table(spark, sf, "documents").select("doc_id", middle_trim(F.col("text"), length).alias("trimmed"))


def exact_inputs(spark, sf):
    """A slice for every transcript day; live days are partly trimmed, the archive has days with d % 3 <> 0."""
    turns, l2 = fx.day_turns(spark, sf), fx.l2_days(spark, sf)
    days = fx.days(spark, sf)
    slices = days.select(
        F.concat_ws("@", "agent_id", F.col("memory_date").cast("string")).alias("slice_id"), "agent_id", "memory_date",
        F.lit("00:00").alias("from_hhmm"), F.when(F.col("d") % 2 == 0, "12:00").otherwise("23:59").alias("to_hhmm"),
        F.lit(TODAY).cast("date").alias("today"))
    stored = l2.filter("status.archived").select("agent_id", "memory_date")
    archived = turns.join(stored, ["agent_id", "memory_date"], "left_semi").withColumn("content", F.concat(F.lit("kept "), "content"))
    return slices, turns, l2, archived, stored


_COPY = f"""
SELECT agent_id, memory_date, d, CASE WHEN memory_date >= DATE '{TODAY}' - 14 THEN coalesce(CASE WHEN NOT trimmed THEN 'live' END, CASE WHEN archived THEN 'archive' END)
  ELSE coalesce(CASE WHEN archived THEN 'archive' END, CASE WHEN NOT trimmed THEN 'live' END) END AS copy
FROM fx_l2 JOIN fx_days USING (agent_id, memory_date)"""


@query("exact_copy", f"SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, copy FROM ({_COPY})", ("fx_l2",))
def exact_copy(spark, sf):
    slices, _, l2, _, stored = exact_inputs(spark, sf)
    return exact.choose_copy(slices, l2, stored).select("agent_id", F.col("memory_date").cast("string").alias("memory_date"), "copy")


_SAID = "regexp_replace(CASE copy WHEN 'archive' THEN 'kept ' || content ELSE content END, '^\\s+|\\s+$', '', 'g')"


@query("recall_exact", f"""
SELECT agent_id || '@' || CAST(memory_date AS VARCHAR) AS slice_id, coalesce(said, '该时间范围内无可用对话记录。') AS text
FROM fx_days LEFT JOIN (
  SELECT agent_id, memory_date, string_agg('[' || role || ' ' || hhmm || '] ' || {_SAID}, chr(10) ORDER BY turn_index) AS said
  FROM ({_COPY}) JOIN fx_day_turns USING (agent_id, memory_date)
  WHERE copy IS NOT NULL AND hhmm BETWEEN '00:00' AND CASE WHEN d % 2 = 0 THEN '12:00' ELSE '23:59' END
  GROUP BY agent_id, memory_date) USING (agent_id, memory_date)""", ("fx_l2", "fx_day_turns"))
def recall_exact(spark, sf):
    slices, turns, l2, archived, stored = exact_inputs(spark, sf)
    return exact.recall_exact(slices, turns, l2, archived, stored).select("slice_id", "text")


@query("recall_exact_long")
def recall_exact_long(spark, sf):
    """Slices far over budget: every source's documents as one day. The tests check them against brute force."""
    turns = fx.long_turns(spark, sf).drop("doc_id", "length")
    days = turns.select("agent_id", "memory_date").distinct()
    slices = days.select(F.col("agent_id").alias("slice_id"), "*", F.lit("00:00").alias("from_hhmm"), F.lit("23:59").alias("to_hhmm"),
                         F.lit("2024-01-02").cast("date").alias("today"))
    live = days.withColumn("status", F.struct(F.lit(False).alias("trimmed")))
    return exact.recall_exact(slices, turns, live, turns.limit(0), days.limit(0)).select("slice_id", "text")


def _agents(spark, sf):
    """Every agent looks back from its own last day."""
    return fx.days(spark, sf).groupBy("agent_id").agg(F.date_add(F.max("memory_date"), 1).alias("today"))


@query("recent_days", """
SELECT w.agent_id, CAST(w.day AS VARCHAR) AS memory_date, kind IS NULL AS missing, coalesce(regexp_replace(first_text, '^\\s+|\\s+$', '', 'g'), '') AS summary,
       coalesce(array_to_string(list_transform(topics, lambda x: kind || ': ' || regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10)), '') AS topics
FROM (SELECT agent_id, CAST(last_day + 1 - i AS DATE) AS day FROM (SELECT agent_id, max(memory_date) AS last_day, unnest([1, 2, 3, 4, 5]) AS i FROM fx_days GROUP BY agent_id)) w
LEFT JOIN fx_l1 l ON l.agent_id = w.agent_id AND l.memory_date = w.day""", ("fx_l1",))
def recent_days(spark, sf):
    view = recent.recent_days(_agents(spark, sf), fx.l1_days(spark, sf), 5)
    return view.select("agent_id", F.col("memory_date").cast("string").alias("memory_date"), "missing",
                       F.coalesce("summary", F.lit("")).alias("summary"),
                       F.coalesce(F.array_join("topics", "\n"), F.lit("")).alias("topics"))


@query("recall_recent_text", """
, v AS (SELECT w.agent_id, i, day, kind IS NOT NULL AS found, regexp_replace(first_text, '^\\s+|\\s+$', '', 'g') AS s
  FROM (SELECT agent_id, i, CAST(last_day + 1 - i AS DATE) AS day FROM (SELECT agent_id, max(memory_date) AS last_day, CAST(unnest(range(1, 31)) AS INT) AS i FROM fx_days GROUP BY agent_id)) w
  LEFT JOIN fx_l1 l ON l.agent_id = w.agent_id AND l.memory_date = w.day)
SELECT agent_id, count(*) FILTER (found) AS found_days, count(*) FILTER (NOT found) AS missing_days,
       concat_ws(chr(10), '### 最近记忆概览', string_agg('- ' || day || ': ' || s, chr(10) ORDER BY i) FILTER (found),
                 string_agg('[' || day || ']' || chr(10) || '摘要：' || s, chr(10) ORDER BY i) FILTER (found)) AS assembled_text
FROM v GROUP BY agent_id""", ("fx_l1",))
def recall_recent_text(spark, sf):
    """A month back: summaries only. With the default limit of characters nothing is cut here."""
    out = recent.recall_recent(_agents(spark, sf), fx.l1_days(spark, sf), 30)
    return out.select("agent_id", F.size("found_dates").cast("bigint").alias("found_days"),
                      F.size("missing_dates").cast("bigint").alias("missing_days"), "assembled_text")
