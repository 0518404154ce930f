"""Archive, restore, decay, rollups, backfill."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from memlake.catalog import fixtures as fx
from memlake.catalog.registry import query
from memlake.functions import timeaxis
from memlake.operators import landmarks, merging
from memlake.plans import decay, jobs, preserve, write
from memlake.session import materialize


def _date():
    return F.col("memory_date").cast("string").alias("memory_date")

WEEK = "2024-W04"


def store(spark, sf):
    turns = materialize(fx.day_turns(spark, sf))  # numbered once, summarised once
    l1 = materialize(fx.l1_days(spark, sf, turns))
    index = fx.l0_index(spark, sf, l1)
    vectors = write.hashed_embedding(8)(write.with_embed_text(index)).select(
        "agent_id", "depth", "time_key", "text_used", "embedding")
    return {"l1_days": l1, "l2_days": fx.l2_days(spark, sf, turns), "turns": turns,
            "day_markers": fx.day_markers(spark, sf, turns), "l0_index": index, "l0_embeddings": vectors}


def _joined(kind: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(day) FILTER (kind = '{kind}')), ','), '') AS {kind}_dates"


_MEMBERS = """
SELECT agent_id, strftime(memory_date, '%G-W%V') AS week_id, kind, CAST(memory_date AS VARCHAR) AS day FROM (
  SELECT agent_id, memory_date, 'l1' AS kind FROM fx_l1 UNION ALL SELECT agent_id, memory_date, 'l2' FROM fx_l2
  UNION ALL SELECT agent_id, memory_date, marker FROM fx_markers UNION ALL SELECT agent_id, memory_date, 'l0_index' FROM fx_l0
  UNION ALL SELECT agent_id, memory_date, 'l0_embedding' FROM fx_l0)"""


@query("archive_manifest", f"""
SELECT agent_id, week_id, count(*) FILTER (NOT starts_with(kind, 'l0_')) AS file_count, {_joined('l1')}, {_joined('l2')},
       {_joined('nocontent')}, {_joined('noconversation')}, {_joined('l0_index')}, {_joined('l0_embedding')} FROM ({_MEMBERS}) GROUP BY agent_id, week_id""",
       ("fx_l0", "fx_l2", "fx_markers"))
def archive_manifest(spark, sf):
    listed = preserve.manifest(preserve.archive_weeks(store(spark, sf)))
    kinds = ("l1", "l2", "nocontent", "noconversation", "l0_index", "l0_embedding")
    return listed.select("agent_id", "week_id", "file_count",
                         *[F.array_join(f"{k}_dates", ",").alias(f"{k}_dates") for k in kinds])


@query("mark_archived", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, archived OR strftime(memory_date, '%G-W%V') = '{WEEK}' AS archived FROM fx_l2""", ("fx_l2",))
def mark_archived(spark, sf):
    _, marked = preserve.archive_and_mark(store(spark, sf), [WEEK])
    return marked["l2_days"].select("agent_id", _date(), F.col("status.archived").alias("archived"))


def _live_and_archive(spark, sf):
    """The archive has every day; the live store lacks days with d % 5 = 0 and has other texts."""
    full = store(spark, sf)
    archive = preserve.archive_weeks(full)
    gone = F.datediff("memory_date", F.lit("2023-12-01").cast("date")) % 5 == 0
    live = {name: df.filter(~gone) if "memory_date" in df.columns else df for name, df in full.items()}
    live["l1_days"] = live["l1_days"].withColumn("summary", F.lit("live"))
    return live, archive


def _restored(mode: str):
    def run(spark, sf):
        live, archive = _live_and_archive(spark, sf)
        selected = preserve.select_for_restore(archive, week=WEEK)
        return preserve.restore(live, selected, mode)["l1_days"].select(
            "agent_id", _date(), "summary", F.col("status.restored").alias("restored"))

    return run


_WEEK_DAY = f"strftime(memory_date, '%G-W%V') = '{WEEK}'"
query("restore_update", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, CASE WHEN d % 5 = 0 THEN first_text ELSE 'live' END AS summary, d % 5 = 0 AS restored
FROM fx_l1 WHERE d % 5 <> 0 OR {_WEEK_DAY}""", ("fx_l1",))(_restored("update"))
query("restore_overwrite", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, CASE WHEN {_WEEK_DAY} THEN first_text ELSE 'live' END AS summary, {_WEEK_DAY} AS restored
FROM fx_l1 WHERE d % 5 <> 0 OR {_WEEK_DAY}""", ("fx_l1",))(_restored("overwrite"))
query("restore_mirrored", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, first_text AS summary, false AS restored FROM fx_l1 WHERE {_WEEK_DAY}""", ("fx_l1",))(_restored("mirrored"))


@query("restore_report", f"""
SELECT agent_id, restored_files, file_conflicts, restored_index_rows,
       CASE WHEN restored_files + restored_index_rows = 0 THEN 'skipped' WHEN file_conflicts > 0 THEN 'partial' ELSE 'restored' END AS status
FROM (SELECT agent_id, count(*) FILTER (NOT starts_with(kind, 'l0_') AND gone) AS restored_files,
             count(*) FILTER (NOT starts_with(kind, 'l0_') AND NOT gone) AS file_conflicts, 0::BIGINT AS restored_index_rows
      FROM (SELECT *, date_diff('day', DATE '2023-12-01', CAST(day AS DATE)) % 5 = 0 AS gone FROM ({_MEMBERS})) WHERE week_id = '{WEEK}' GROUP BY agent_id)""",
       ("fx_l0", "fx_l2", "fx_markers"))
def restore_report(spark, sf):
    live, archive = _live_and_archive(spark, sf)
    return preserve.restore_report(live, preserve.select_for_restore(archive, week=WEEK), "update")


_PLAN = """
SELECT agent_id, memory_date, CASE WHEN skip_reason IS NULL THEN CASE WHEN has_l1 THEN 'trim_from_l1' ELSE 'clear_for_nocontent' END END AS mode, skip_reason
FROM (SELECT *, CASE WHEN NOT archived THEN 'status_not_archived' WHEN trimmed THEN 'already_trimmed'
                     WHEN NOT has_l1 AND NOT thin THEN 'missing_l1_and_nocontent' END AS skip_reason
      FROM (SELECT l2.*, l1.memory_date IS NOT NULL AS has_l1, m.memory_date IS NOT NULL AS thin
            FROM fx_l2 l2 LEFT JOIN fx_l1 l1 USING (agent_id, memory_date) LEFT JOIN (FROM fx_markers WHERE marker = 'nocontent') m USING (agent_id, memory_date)
            WHERE l2.memory_date <= DATE '2024-02-04'))"""
_TRIM_VIEWS = ("fx_l2", "fx_l1", "fx_markers")


def _trim_plan(spark, sf):
    boundary = timeaxis.trim_boundary(F.lit("2024-W08"))
    return decay.trim_plan(fx.l2_days(spark, sf), fx.l1_days(spark, sf), fx.day_markers(spark, sf), boundary)


@query("trim_plan", _PLAN.replace("SELECT agent_id, memory_date, CASE", "SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, CASE", 1), _TRIM_VIEWS)
def trim_plan(spark, sf):
    return _trim_plan(spark, sf).withColumn("memory_date", _date())


@query("trim_l2", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, turn_index, message_id
FROM fx_day_turns t LEFT JOIN ({_PLAN}) p USING (agent_id, memory_date) LEFT JOIN fx_l1 l USING (agent_id, memory_date)
WHERE p.mode IS NULL OR (p.mode = 'trim_from_l1' AND (turn_index IN (0, l.user_turns) OR list_contains(list_transform(l.peaks, lambda x: x.turn), turn_index)))""", _TRIM_VIEWS)
def trim_l2(spark, sf):
    turns, _, _ = decay.trim_l2(fx.day_turns(spark, sf), fx.l2_days(spark, sf), fx.l1_days(spark, sf),
                                fx.day_markers(spark, sf), "2024-W08")
    return turns.select("agent_id", _date(), "turn_index", "message_id")


# How the lists of a summary or rollup are compared: one line per entry.
_LINES = {"tags": lambda x: x, "decisions": lambda x: x, "todos": lambda x: x,
          "topics": lambda x: F.concat_ws(": ", x["name"], x["detail"]), "key_items": lambda x: F.concat_ws(": ", x["type"], x["desc"]),
          "emotional_peaks": lambda x: F.concat_ws(" ", x["date"].cast("string"), x["emotion"], x["intensity"].cast("string"), x["context"])}


def _lists():
    return [F.array_join(F.transform(name, line), "\n").alias(name) for name, line in _LINES.items()]


def _pivot(kept: str) -> str:
    columns = ", ".join(f"coalesce(string_agg(v, chr(10) ORDER BY o) FILTER (field = '{name}'), '') AS {name}" for name in _LINES)
    return f"SELECT agent_id, week, {columns}, CAST(sum(CASE WHEN back = 1 THEN greatest(n - most, 0) ELSE 0 END) AS BIGINT) AS beyond FROM ({kept}) GROUP BY ALL"


_PERIOD_LISTS = ", ".join(f"coalesce(string_agg(v, chr(10) ORDER BY o) FILTER (field = '{name}'), '') AS {name}" for name in _LINES)


@query("week_view", f"""
SELECT l.agent_id, strftime(memory_date, '%G-W%V') AS week, CAST(memory_date AS VARCHAR) AS memory_date, first_text AS summary, kind AS mood,
       {', '.join(f"coalesce(i.{name}, '') AS {name}" for name in _LINES)}
FROM fx_l1 l LEFT JOIN (SELECT agent_id, o // 100000 AS d, {_PERIOD_LISTS} FROM fx_week_items GROUP BY ALL) i USING (agent_id, d)""",
       ("fx_l1", "fx_week_items"))
def week_view(spark, sf):
    view = decay.week_view(fx.l1_days(spark, sf))
    return view.select("agent_id", "week", F.explode("periods").alias("p")).select("agent_id", "week", "p.*").select(
        "agent_id", "week", _date(), "summary", "mood", *_lists())


_ROLLUP = ", ".join(f"coalesce({name}, '') AS {name}" for name in _LINES)


@query("shallow_rollup", f"""
SELECT a.agent_id, '{WEEK}' AS time_key, '2024-01-22' AS window_date_start, '2024-01-28' AS window_date_end, w.week IS NULL AS no_l1_files,
       CASE WHEN w.week IS NULL THEN '本周无可用 surface L1 文件，不生成周级语义摘要。' ELSE t.summary END AS summary, coalesce(t.mood, '') AS mood,
       {_ROLLUP}, coalesce(beyond + cut, 0) AS dropped
FROM (SELECT DISTINCT agent_id FROM fx_days) a LEFT JOIN (FROM ({_pivot("FROM fx_week_kept")}) WHERE week = '{WEEK}') w USING (agent_id)
LEFT JOIN (FROM fx_week_texts WHERE week = '{WEEK}') t USING (agent_id)""", ("fx_week_kept", "fx_week_texts"))
def shallow_rollup(spark, sf):
    rolled = decay.shallow_rollup(fx.days(spark, sf), fx.l1_days(spark, sf), "2024-W07")
    return rolled.select("agent_id", "time_key", F.col("window_date_start").cast("string").alias("window_date_start"),
                         F.col("window_date_end").cast("string").alias("window_date_end"), "no_l1_files", "summary", "mood",
                         *_lists(), "dropped")


# Verdicts: days with d % 6 = 1 are landmarks, days with d % 6 = 5 have no verdict.
@query("shallow_delete_set", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, artefact FROM (
  SELECT agent_id, memory_date, d, unnest(['l1', 'l0']) AS artefact FROM fx_l1 WHERE archived
  UNION ALL SELECT agent_id, memory_date, d, 'l2' FROM fx_l2 JOIN fx_days USING (agent_id, memory_date) WHERE archived
  UNION ALL SELECT agent_id, memory_date, d, marker FROM fx_markers JOIN fx_days USING (agent_id, memory_date))
WHERE d % 6 <> 1 AND {_WEEK_DAY}""", _TRIM_VIEWS)
def shallow_delete_set(spark, sf):
    days = fx.days(spark, sf)
    verdicts = days.filter("d % 6 != 5").select("agent_id", "memory_date", (F.col("d") % 6 == 1).alias("landmark"))
    return decay.shallow_delete_set(days, fx.l1_days(spark, sf), fx.l2_days(spark, sf), fx.day_markers(spark, sf),
                                    verdicts, WEEK).select("agent_id", _date(), "artefact")


_GONE = f"archived AND {_WEEK_DAY}"


@query("apply_day_deletes", f"""
SELECT 'l1_days' AS table_name, agent_id, CAST(memory_date AS VARCHAR) AS item FROM fx_l1 WHERE NOT ({_GONE})
UNION ALL SELECT 'l2_days', agent_id, CAST(memory_date AS VARCHAR) FROM fx_l2 WHERE NOT ({_GONE})
UNION ALL SELECT 'turns', t.agent_id, t.memory_date || ' ' || turn_index FROM fx_day_turns t JOIN fx_l2 USING (agent_id, memory_date) WHERE NOT ({_GONE})
UNION ALL SELECT 'day_markers', agent_id, memory_date || ' ' || marker FROM fx_markers WHERE NOT ({_WEEK_DAY})
UNION ALL SELECT unnest(['l0_index', 'l0_embeddings']), agent_id, CAST(memory_date AS VARCHAR) FROM fx_l1 WHERE NOT ({_GONE})""",
       ("fx_l1", "fx_l2", "fx_markers", "fx_day_turns"))
def apply_day_deletes(spark, sf):
    everything, days = store(spark, sf), fx.days(spark, sf)
    none = days.limit(0).select("agent_id", "memory_date", F.lit(True).alias("landmark"))
    doomed = decay.shallow_delete_set(days, everything["l1_days"], everything["l2_days"], everything["day_markers"], none, WEEK)
    left = decay.apply_day_deletes(everything, doomed)
    more = {"turns": ["turn_index"], "day_markers": ["marker"]}
    parts = [left[t].select(F.lit(t).alias("table_name"), "agent_id", F.concat_ws(
        " ", F.col("time_key" if t.startswith("l0_") else "memory_date").cast("string"), *[F.col(c).cast("string") for c in more.get(t, [])]
        ).alias("item")) for t in left]
    return reduce(DataFrame.unionByName, parts)


_WEEKS = "SELECT agent_id, strftime(memory_date, '%G-W%V') AS week, CAST(date_trunc('week', memory_date) AS DATE) AS monday FROM fx_day_items GROUP BY ALL"
_OLDEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY monday) AS position, count(*) OVER (PARTITION BY agent_id) AS available FROM ({_WEEKS})) WHERE position <= 4 AND available >= 4"


def _weeks(spark, sf):
    return fx.day_items(spark, sf).select("agent_id", timeaxis.week_id(F.col("memory_date")).alias("week"))


@query("earliest_n_weeks", f"SELECT agent_id, week, position, available FROM ({_OLDEST})", ("fx_day_items",))
def earliest_n_weeks(spark, sf):
    return decay.earliest_weeks(_weeks(spark, sf), 4).select("agent_id", "week", F.col("position").cast("bigint").alias("position"), "available")


@query("deep_windows", f"""
SELECT agent_id, CAST(min(monday) AS VARCHAR) || '+' || (max(monday) + 6 - min(monday) + 1) || 'd' AS time_key,
       array_to_string(list_sort(list(week)), ',') AS source_weeks FROM ({_OLDEST}) GROUP BY agent_id""", ("fx_day_items",))
def deep_windows(spark, sf):
    return decay.deep_windows(decay.earliest_weeks(_weeks(spark, sf), 4)).select(
        "agent_id", "time_key", F.array_join("source_weeks", ",").alias("source_weeks"))


def _all_rollups(spark, sf):
    """A week rollup per agent and week of its summaries."""
    view = decay.week_view(fx.l1_days(spark, sf))
    merged = decay.merge_periods(F.col("periods"))
    start = timeaxis.week_monday(F.col("week"))
    return view.select("agent_id", F.lit("shallow").alias("depth"), F.col("week").alias("time_key"), start.alias("window_date_start"),
                       F.date_add(start, 6).alias("window_date_end"), F.array().cast("array<string>").alias("source_weeks"),
                       *[c.alias(n) for n, c in merged.items()], F.lit(False).alias("no_l1_files"))


_ROLLED = """SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY monday) AS position, count(*) OVER (PARTITION BY agent_id) AS available FROM (
  SELECT agent_id, strftime(memory_date, '%G-W%V') AS week, min(CAST(date_trunc('week', memory_date) AS DATE)) AS monday FROM fx_l1 GROUP BY ALL)"""


_OLD_WEEKS = f"SELECT agent_id, week, monday FROM ({_ROLLED}) WHERE position <= 4 AND available >= 4"
_DEEP_KEPT = f"""SELECT *, 'all' AS week FROM (
  SELECT *, row_number() OVER (PARTITION BY agent_id, field ORDER BY o DESC) AS back, count(*) OVER (PARTITION BY agent_id, field) AS n
  FROM (SELECT agent_id, field, v, max(o) AS o FROM fx_week_kept JOIN ({_OLD_WEEKS}) USING (agent_id, week) GROUP BY ALL))
JOIN fx_limits USING (field) WHERE back <= most"""


def _deep_text(column: str, limit: int) -> str:
    return fx.sql_latest(f"SELECT agent_id, 'all' AS week, {column} AS s, monday AS at_ FROM fx_week_texts JOIN ({_OLD_WEEKS}) USING (agent_id, week)", limit)


@query("deep_rollup", f"""
SELECT agent_id, CAST(min(monday) AS VARCHAR) || '+' || (max(monday) - min(monday) + 7) || 'd' AS time_key,
       array_to_string(list_sort(list(o.week)), ',') AS source_weeks, any_value(s.text) AS summary, any_value(m.text) AS mood,
       {', '.join(f"any_value({name}) AS {name}" for name in _LINES)}, any_value(beyond + s.cut + m.cut) AS dropped
FROM ({_OLD_WEEKS}) o JOIN ({_pivot(_DEEP_KEPT)}) USING (agent_id) JOIN ({_deep_text('summary', 240)}) s USING (agent_id)
JOIN ({_deep_text('mood', 40)}) m USING (agent_id) GROUP BY agent_id""", ("fx_week_kept", "fx_week_texts"))
def deep_rollup(spark, sf):
    rollups = _all_rollups(spark, sf)
    deep = decay.deep_rollup(rollups, rollups.select("agent_id", F.col("time_key").alias("week")))
    return deep.select("agent_id", "time_key", F.array_join("source_weeks", ",").alias("source_weeks"), "summary", "mood", *_lists(), "dropped")


@query("deep_cleanup", f"""
SELECT agent_id, week FROM ({_ROLLED}) WHERE NOT (position <= 4 AND available >= 4)""", ("fx_l1",))
def deep_cleanup(spark, sf):
    rollups = _all_rollups(spark, sf)
    registered = rollups.select("agent_id", F.col("time_key").alias("week"))
    doomed = decay.deep_delete_set(decay.deep_rollup(rollups, registered))
    return merging.prune(registered, doomed.withColumnRenamed("time_key", "week"), ["agent_id", "week"])


def stored_index(spark, sf):
    """The index before a run that is still to write every second day's row."""
    return fx.l0_index(spark, sf).filter(F.datediff(F.to_date("time_key"), F.lit("2023-12-01").cast("date")) % 2 == 1)


@query("backfill_targets", """
SELECT a.agent_id, CAST(day AS VARCHAR) AS memory_date
FROM (SELECT DISTINCT agent_id FROM fx_days) a, (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-29', INTERVAL 1 DAY)) AS DATE) AS day)
WHERE (a.agent_id, day) NOT IN (
  SELECT (l2.agent_id, l2.memory_date) FROM fx_l2 l2 LEFT JOIN fx_l1 l1 USING (agent_id, memory_date) LEFT JOIN (FROM fx_markers WHERE marker = 'nocontent') m USING (agent_id, memory_date)
  LEFT JOIN (FROM fx_l0 WHERE d % 2 = 1) i USING (agent_id, memory_date) WHERE m.marker IS NOT NULL OR (l1.kind IS NOT NULL AND i.time_key IS NOT NULL))""", ("fx_l2", "fx_l0", "fx_markers"))
def backfill_targets(spark, sf):
    return jobs.backfill_targets(fx.days(spark, sf), date(2024, 1, 1), date(2024, 2, 29), fx.l2_days(spark, sf), fx.l1_days(spark, sf),
                                 fx.day_markers(spark, sf), stored_index(spark, sf)).select("agent_id", _date())


@query("rerun_targets", """
SELECT DISTINCT 'agent_' || user_id AS agent_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS memory_date FROM events WHERE event_type = 'error' AND event_id % 3 <> 0""")
def rerun_targets(spark, sf):
    return jobs.rerun_targets(_failures(spark, sf)).withColumn("memory_date", _date())


def _failures(spark, sf):
    return fx.table(spark, sf, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("agent_"), F.col("user_id").cast("string")).alias("agent_id"), F.to_date("ts").alias("memory_date"),
        (F.col("event_id") % 3 == 0).alias("rerun_done"), F.lit(None).cast("timestamp").alias("rerun_at"),
        F.lit(None).cast("string").alias("rerun_run_name"))


@query("mark_rerun_done", """
SELECT agent_id, memory_date, count(*) AS failures, count(*) FILTER (rerun_run_name = 'again') AS rerun FROM (
  SELECT *, CASE WHEN bool_or(open) OVER (PARTITION BY agent_id, memory_date) THEN 'again' END AS rerun_run_name FROM (
    SELECT 'agent_' || user_id AS agent_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS memory_date, event_id % 3 <> 0 AS open FROM events WHERE event_type = 'error'))
GROUP BY ALL""")
def mark_rerun_done(spark, sf):
    failures = _failures(spark, sf)
    marked = jobs.mark_rerun_done(failures, jobs.rerun_targets(failures), "again")
    return marked.groupBy("agent_id", F.col("memory_date").cast("string").alias("memory_date")).agg(
        F.count(F.lit(1)).alias("failures"), F.count_if(F.col("rerun_run_name") == "again").alias("rerun"))


@query("rescore_range", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, CASE WHEN kind = 'bug_fix' THEN len(items) ELSE 0 END AS bug_fix
FROM fx_l1 WHERE memory_date >= DATE '2024-01-15'""", ("fx_l1",))
def rescore_range(spark, sf):
    empty = landmarks.count_documents(fx.l1_days(spark, sf)).limit(0)
    return jobs.rescore_range(empty, fx.l1_days(spark, sf), start=date(2024, 1, 15)).select(
        "agent_id", _date(), F.coalesce(F.element_at("key_items", "bug_fix"), F.lit(0).cast("bigint")).alias("bug_fix"))
