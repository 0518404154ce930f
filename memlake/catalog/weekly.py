"""Archive files, the weekly run and its backfill, on stores of the lifecycle tables."""

from __future__ import annotations

from datetime import date
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from memlake.catalog import fixtures as fx, lifecycle, upserts
from memlake.catalog.registry import query
from memlake.operators import landmarks
from memlake.plans import decay, preserve, weekly
from memlake.session import checkpoint_dir
from memlake.sources import archive_files
from memlake.sources.snapshots import Store

WEEK = lifecycle.WEEK
FIRST, LAST = date(2024, 1, 1), date(2024, 2, 25)  # eight weeks


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


_CONTENT = {
    "l1_days": lambda: ("memory_date", F.concat_ws("|", F.coalesce("status.archived", F.lit(False)).cast("string"), "summary", F.array_join("decisions", "|"))),
    "l2_days": lambda: ("memory_date", F.concat_ws("|", *[F.coalesce(f"status.{f}", F.lit(False)).cast("string") for f in ("archived", "trimmed")])),
    "turns": lambda: (F.concat_ws(" ", F.col("memory_date").cast("string"), F.col("turn_index").cast("string")), F.col("content")),
    "day_markers": lambda: (F.concat_ws(" ", F.col("memory_date").cast("string"), "marker"), F.lit("")),
    "l0_index": lambda: (F.concat_ws(" ", "depth", "time_key"), F.col("summary")),
    "l0_embeddings": lambda: (F.concat_ws(" ", "depth", "time_key"), F.col("text_used")),
    "rollups": lambda: (F.concat_ws(" ", "depth", "time_key"), F.concat_ws("\n", "summary", "mood", *[c for c in lifecycle._lists()])),
    "shallow_weeks": lambda: ("week", F.lit("")),
}


def _rows(tables: dict[str, DataFrame]) -> DataFrame:
    """The tables' rows as table, agent, item and content."""
    parts = []
    for name, rows in tables.items():
        item, content = _CONTENT[name]()
        item = F.col(item).cast("string") if isinstance(item, str) else item
        parts.append(rows.select(F.lit(name).alias("table_name"), "agent_id", item.alias("item"), content.alias("content")))
    return reduce(DataFrame.unionByName, parts)


_L1_TEXT = "first_text || CASE WHEN len(decisions) > 0 THEN '|' || array_to_string(decisions, '|') ELSE '|' END"


@query("archive_restore_files", f"""
SELECT 'l1_days' AS table_name, agent_id, CAST(memory_date AS VARCHAR) AS item, archived || '|' || {_L1_TEXT} AS content FROM fx_l1 WHERE {lifecycle._WEEK_DAY}
UNION ALL SELECT 'l2_days', agent_id, CAST(memory_date AS VARCHAR), archived || '|' || trimmed FROM fx_l2 WHERE {lifecycle._WEEK_DAY}
UNION ALL SELECT 'turns', agent_id, memory_date || ' ' || turn_index, content FROM fx_day_turns WHERE {lifecycle._WEEK_DAY}
UNION ALL SELECT 'day_markers', agent_id, memory_date || ' ' || marker, '' FROM fx_markers WHERE {lifecycle._WEEK_DAY}
UNION ALL SELECT 'l0_index', agent_id, 'surface ' || time_key, summary FROM fx_l0 WHERE {lifecycle._WEEK_DAY}
UNION ALL SELECT 'l0_embeddings', agent_id, 'surface ' || memory_date, {upserts._EMBED} FROM fx_l1 WHERE {lifecycle._WEEK_DAY}
UNION ALL SELECT 'manifest', agent_id, week_id, CAST(count(*) FILTER (NOT starts_with(kind, 'l0_')) AS VARCHAR) FROM ({lifecycle._MEMBERS}) GROUP BY agent_id, week_id""",
       ("fx_l0", "fx_l2", "fx_markers", "fx_day_turns"))
def archive_restore_files(spark, sf):
    """All weeks are archived to files, half of them in a second run; then the files of one week are read back, next to the manifest."""
    store = lifecycle_store(spark, sf)
    path, tables = _folder(spark, "archive"), {t: store.read(t).drop("memory_month", "period") for t in weekly.ARCHIVED}
    weeks = sorted(r.week_id for r in preserve.archive_weeks({"l2_days": tables["l2_days"]})["l2_days"].select("week_id").distinct().collect())
    for part in (weeks[::2], weeks):
        archive_files.write_archive(tables, path, part)
    manifest = archive_files.manifest(spark, path).select(
        F.lit("manifest").alias("table_name"), "agent_id", F.col("week_id").alias("item"), F.col("file_count").cast("string").alias("content"))
    if not any(week == WEEK for week in weeks):
        return manifest
    back = archive_files.read_archive(spark, path, week=WEEK)
    return _rows(preserve.restore({}, back, "mirrored")).unionByName(manifest)


# --- weekly runs ----------------------------------------------------------------------------------

def lifecycle_store(spark, sf) -> Store:
    """A store with the lifecycle tables, no rollups yet; days with d % 6 = 1 are landmarks."""
    tables = lifecycle.store(spark, sf)
    agents = tables["l2_days"].select("agent_id").distinct()
    store = Store(spark, _folder(spark, "store"))
    weekly.create_store(store, {
        **tables, "agents": agents, "landmark_counts": landmarks.count_documents(tables["l1_days"]),
        "rollups": decay.shallow_rollup(agents, tables["l1_days"], WEEK).limit(0),
        "shallow_weeks": agents.limit(0).select("agent_id", F.lit("").alias("week"))})
    return store


def _verdicts(counts, week, settings):
    d = F.datediff("memory_date", F.lit("2023-12-01").cast("date"))
    return counts.select("agent_id", "memory_date", (d % 6 == 1).alias("landmark"))


_TABLES = ("l1_days", "l2_days", "turns", "day_markers", "l0_index", "l0_embeddings", "rollups", "shallow_weeks")
_EMPTY = decay.EMPTY_WEEK_SUMMARY


def _after(first: str, last: str, windows: int) -> str:
    """All tables after the runs of the weeks between two days, windows of which are rolled up; the other weeks wait."""
    inside = f"memory_date BETWEEN DATE '{first}' AND DATE '{last}'"
    text = lambda column, none, limit: fx.sql_latest(
        f"SELECT agent_id, period AS week, coalesce({column}, '{none}') AS s, monday AS at_ FROM spans LEFT JOIN fx_week_texts USING (agent_id, week) WHERE depth = 'deep'", limit)
    return f""", facts AS (
  SELECT l2.agent_id, l2.memory_date, l2.archived OR {inside} AS archived, trimmed AS was_trimmed, {inside} AND NOT (d % 6 = 1 AND l1.kind IS NOT NULL) AS gone,
         l1.kind IS NOT NULL AS has_l1, memory_date <= DATE '{last}' AND (l2.archived OR {inside}) AND NOT trimmed
           AND (l1.kind IS NOT NULL OR coalesce(marker = 'nocontent', false)) AS trims
  FROM fx_l2 l2 JOIN (SELECT agent_id, memory_date, d FROM fx_days) USING (agent_id, memory_date)
  LEFT JOIN (SELECT agent_id, memory_date, kind FROM fx_l1) l1 USING (agent_id, memory_date) LEFT JOIN fx_markers USING (agent_id, memory_date)),
spans AS (SELECT agent_id, strftime(monday, '%G-W%V') AS week, monday,
                 CASE WHEN n < {4 * windows} THEN 'deep' ELSE 'shallow' END AS depth,
                 CASE WHEN n < {4 * windows} THEN (DATE '{first}' + CAST(n // 4 * 28 AS INT)) || '+28d' ELSE strftime(monday, '%G-W%V') END AS period
          FROM (SELECT DISTINCT agent_id FROM fx_days), (SELECT n, CAST(DATE '{first}' + CAST(n * 7 AS INT) AS DATE) AS monday
                FROM (SELECT unnest(range((DATE '{last}' - DATE '{first}' + 1) // 7)) AS n))),
kept AS (SELECT agent_id, period AS week, field, v, o FROM (
  SELECT *, row_number() OVER (PARTITION BY agent_id, period, field ORDER BY o DESC) AS back
  FROM (SELECT agent_id, period, field, v, max(o) AS o FROM fx_week_kept JOIN spans USING (agent_id, week) GROUP BY ALL)) JOIN fx_limits USING (field) WHERE back <= most),
texts AS (SELECT s.agent_id, s.week, s.text AS summary, coalesce(m.text, '') AS mood FROM ({text('summary', _EMPTY, 240)}) s
          LEFT JOIN ({text('mood', '', 40)}) m USING (agent_id, week)
          UNION ALL SELECT agent_id, period, coalesce(summary, '{_EMPTY}'), coalesce(mood, '') FROM spans LEFT JOIN fx_week_texts USING (agent_id, week) WHERE depth = 'shallow'),
rolled AS (SELECT s.agent_id, s.depth, s.period, t.summary, t.mood, s.depth = 'deep' OR x.agent_id IS NOT NULL AS has_row, lists, tags
  FROM (SELECT DISTINCT agent_id, depth, period FROM spans) s JOIN texts t ON t.agent_id = s.agent_id AND t.week = s.period
  LEFT JOIN (SELECT agent_id, week, string_agg(coalesce(line, ''), chr(10) ORDER BY field_no) AS lists, max(line) FILTER (field = 'tags') AS tags
    FROM (SELECT agent_id, week, field, field_no, string_agg(v, chr(10) ORDER BY o) AS line FROM (
            SELECT DISTINCT agent_id, week FROM kept) JOIN (SELECT * FROM (VALUES {', '.join(f"('{n}', {i})" for i, n in enumerate(lifecycle._LINES))}) f(field, field_no)) ON true
          LEFT JOIN kept USING (agent_id, week, field) GROUP BY ALL) GROUP BY ALL) x ON x.agent_id = s.agent_id AND x.week = s.period),
left_l1 AS (SELECT l.*, f.archived AS flag FROM fx_l1 l JOIN facts f USING (agent_id, memory_date) WHERE NOT gone)
SELECT 'l1_days' AS table_name, agent_id, CAST(memory_date AS VARCHAR) AS item, flag || '|' || {_L1_TEXT} AS content FROM left_l1
UNION ALL SELECT 'l2_days', agent_id, CAST(memory_date AS VARCHAR), archived || '|' || (was_trimmed OR trims) FROM facts WHERE NOT gone
UNION ALL SELECT 'turns', t.agent_id, t.memory_date || ' ' || turn_index, content FROM fx_day_turns t JOIN facts f USING (agent_id, memory_date)
  LEFT JOIN (SELECT agent_id, memory_date, user_turns AS hint, list_transform(peaks, lambda x: x.turn) AS at_ FROM fx_l1) l USING (agent_id, memory_date)
  WHERE NOT gone AND (NOT trims OR (has_l1 AND (turn_index IN (0, hint) OR list_contains(at_, turn_index))))
UNION ALL SELECT 'day_markers', agent_id, memory_date || ' ' || marker, '' FROM fx_markers JOIN facts USING (agent_id, memory_date) WHERE NOT gone
UNION ALL SELECT 'l0_index', agent_id, 'surface ' || memory_date, first_text FROM left_l1
UNION ALL SELECT 'l0_index', agent_id, depth || ' ' || period, summary FROM rolled WHERE has_row
UNION ALL SELECT 'l0_embeddings', agent_id, 'surface ' || memory_date, {upserts._EMBED} FROM left_l1
UNION ALL SELECT 'l0_embeddings', agent_id, depth || ' ' || period, '摘要：' || {fx.sql_strip('summary')}
  || CASE WHEN tags IS NULL THEN '' ELSE chr(10) || '标签：' || replace(tags, chr(10), ', ') END
  || CASE WHEN mood = '' THEN '' ELSE chr(10) || '情绪：' || {fx.sql_strip('mood')} END FROM rolled WHERE has_row
UNION ALL SELECT 'rollups', agent_id, depth || ' ' || period, summary || chr(10) || mood || chr(10) || coalesce(lists, repeat(chr(10), {len(lifecycle._LINES) - 1})) FROM rolled
UNION ALL SELECT 'shallow_weeks', agent_id, week, '' FROM spans WHERE depth = 'shallow'"""


_VIEWS = ("fx_l1", "fx_l2", "fx_markers", "fx_day_turns", "fx_week_kept", "fx_week_texts")


@query("weekly_run", _after("2024-01-22", "2024-01-28", 0), _VIEWS)
def weekly_run(spark, sf):
    """One run with archive, trimming, rollup, vectors and cleanup; a second call changes nothing."""
    store, archive = lifecycle_store(spark, sf), _folder(spark, "archive")
    for _ in range(2):
        weekly.run_week(store, WEEK, archive, apply=True, verdicts=_verdicts)
    return _rows({t: store.read(t) for t in _TABLES})


@query("backfill_weeks", _after(FIRST.isoformat(), LAST.isoformat(), 2), _VIEWS)
def backfill_weeks(spark, sf):
    """Eight weeks, ended after three and taken up again; two windows of four weeks are rolled up on the way."""
    store, archive = lifecycle_store(spark, sf), _folder(spark, "archive")
    for last in (date(2024, 1, 21), LAST, LAST):
        weekly.backfill_weeks(store, FIRST, last, archive, apply=True, verdicts=_verdicts)
    return _rows({t: store.read(t) for t in _TABLES})
