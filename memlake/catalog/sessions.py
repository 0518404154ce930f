"""Session registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.catalog import fixtures as fx
from memlake.catalog.registry import query
from memlake.functions import timeaxis
from memlake.operators.merging import upsert_sessions
from memlake.plans import sessions as sn
from memlake.sources import message_log

WEEK = "2024-W03"   # ends on 2024-01-21
_ROLLUP = """
SELECT agent_id, session_id, list_sort(list(memory_date)) AS days, min(first_seen) AS seen FROM fx_registry WHERE {where} GROUP BY ALL"""


def _text(days: str) -> str:
    return f"array_to_string(list_transform({days}, lambda x: CAST(x AS VARCHAR)), ',')"


def _dates():
    return F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates")


def _seconds(column: str):
    return F.unix_timestamp(column).alias(column)


def _current(spark, sf):
    """Per agent the session seen last."""
    return fx.registry(spark, sf).groupBy("agent_id").agg(F.max_by("session_id", F.struct("first_seen", "session_id")).alias("session_id"))


_CURRENT = "SELECT agent_id, arg_max(session_id, (first_seen, session_id)) AS session_id FROM fx_registry GROUP BY agent_id"


def _archive(spark, sf):
    """Sessions with even numbers, as an earlier run archived them."""
    early = fx.registry(spark, sf).filter(F.col("memory_date") <= F.lit("2024-01-10").cast("date"))
    return sn.session_rollup(early.filter(F.col("session_id").cast("int") % 2 == 0)).select(
        "agent_id", "session_id", "dates", "first_seen_min",
        F.array(F.concat("session_id", F.lit(".jsonl"))).alias("archived_files"), F.lit("2024-01-11").cast("timestamp").alias("archived_at"))


_ARCHIVE = _ROLLUP.format(where="memory_date <= DATE '2024-01-10' AND CAST(session_id AS INT) % 2 = 0")


@query("session_registry", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, session_id, CAST(floor(epoch(first_seen)) AS BIGINT) AS first_seen FROM fx_registry""", ("fx_registry",))
def session_registry(spark, sf):
    seen = fx.registry(spark, sf)
    later = seen.withColumn("first_seen", F.col("first_seen") + F.expr("interval 1 hour"))
    return upsert_sessions(seen.filter(F.col("memory_date") < F.lit("2024-01-15").cast("date")), seen.unionByName(later)).select(
        "agent_id", F.col("memory_date").cast("string").alias("memory_date"), "session_id", _seconds("first_seen"))


@query("session_rollup", f"""
SELECT agent_id, session_id, {_text('days')} AS dates, CAST(floor(epoch(seen)) AS BIGINT) AS first_seen_min
FROM ({_ROLLUP.format(where="memory_date <= DATE '2024-01-21'")})""", ("fx_registry",))
def session_rollup(spark, sf):
    return sn.session_rollup(fx.registry(spark, sf), timeaxis.week_sunday(F.lit(WEEK))).select(
        "agent_id", "session_id", _dates(), _seconds("first_seen_min"))


@query("session_preserve", f"""
SELECT agent_id, session_id, {_text("list_sort(list_distinct(coalesce(o.days, []) || coalesce(n.days, [])))")} AS dates,
       CAST(floor(epoch(least(o.seen, n.seen))) AS BIGINT) AS first_seen_min,
       CASE WHEN o.days IS NULL THEN '' ELSE session_id || '.jsonl' END AS archived_files, n.days IS NULL AS kept_time
FROM ({_ARCHIVE}) o FULL JOIN (SELECT r.* FROM ({_ROLLUP.format(where="memory_date <= DATE '2024-01-21'")}) r ANTI JOIN ({_CURRENT}) c USING (agent_id, session_id)) n USING (agent_id, session_id)""", ("fx_registry",))
def session_preserve(spark, sf):
    archived = sn.session_preserve(fx.registry(spark, sf), _archive(spark, sf), _current(spark, sf), WEEK)
    return archived.select("agent_id", "session_id", _dates(), _seconds("first_seen_min"),
                           F.array_join("archived_files", ",").alias("archived_files"),
                           (F.col("archived_at") == F.lit("2024-01-11").cast("timestamp")).alias("kept_time"))


# The decay run of 2024-W05 forgets what ended by 2024-01-21.
@query("session_decay", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, session_id FROM fx_registry r
WHERE NOT (memory_date <= DATE '2024-01-21' AND EXISTS (SELECT 1 FROM ({_ARCHIVE}) a WHERE a.agent_id = r.agent_id AND list_contains(a.days, r.memory_date)))""", ("fx_registry",))
def session_decay(spark, sf):
    kept, _ = sn.session_decay(fx.registry(spark, sf), _archive(spark, sf), "2024-W05", apply=True)
    return kept.select("agent_id", F.col("memory_date").cast("string").alias("memory_date"), "session_id")


@query("session_decay_days", f"""
SELECT DISTINCT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, CASE WHEN a.day IS NULL THEN 'missing_archive' END AS kept_because
FROM fx_registry r LEFT JOIN (SELECT DISTINCT agent_id AS agent, unnest(days) AS day FROM ({_ARCHIVE})) a ON agent = agent_id AND day = memory_date
WHERE memory_date <= DATE '2024-01-21'""", ("fx_registry",))
def session_decay_days(spark, sf):
    _, report = sn.session_decay(fx.registry(spark, sf), _archive(spark, sf), "2024-W05")
    return report.withColumn("memory_date", F.col("memory_date").cast("string"))


_SESSIONS = f"""
SELECT agent_id, session_id, CASE WHEN (agent_id, session_id) IN ({_CURRENT}) THEN 'current_session'
  WHEN (agent_id, session_id) NOT IN (SELECT agent_id, session_id FROM ({_ARCHIVE})) THEN 'missing_archive'
  WHEN max(memory_date) > DATE '2024-01-28' THEN 'seen_after_boundary' END AS kept_because
FROM fx_registry GROUP BY agent_id, session_id HAVING min(memory_date) <= DATE '2024-01-28'"""


def _decaying(spark, sf):
    return sn.decay_sessions(fx.registry(spark, sf), _archive(spark, sf), _current(spark, sf), F.lit("2024-01-28").cast("date"))


@query("session_decay_sessions", _SESSIONS, ("fx_registry",))
def session_decay_sessions(spark, sf):
    return _decaying(spark, sf)


@query("session_decay_files", f"""
SELECT agent_id, session_id, session_id || suffix AS file_name, CASE WHEN suffix <> '.jsonl' THEN 'missing_archive' END AS kept_because
FROM ({_SESSIONS}), (SELECT unnest(['.jsonl', '.jsonl.reset.1']) AS suffix) WHERE kept_because IS NULL""", ("fx_registry",))
def session_decay_files(spark, sf):
    sessions = fx.registry(spark, sf).select("agent_id", "session_id").distinct()
    suffixes = F.explode(F.array(F.lit(".jsonl"), F.lit(".jsonl.reset.1")))
    files = sessions.select("*", suffixes.alias("_s")).select("agent_id", "session_id", F.concat("session_id", "_s").alias("file_name"))
    return sn.decay_files(_decaying(spark, sf), files, files.filter(F.col("file_name").endswith(".jsonl")))


@query("sessions_for_day", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, session_id, 'live' AS copy FROM fx_registry WHERE day(memory_date) % 3 <> 0
UNION ALL SELECT agent_id, CAST(day AS VARCHAR), session_id, 'archive' FROM (SELECT agent_id, session_id, unnest(days) AS day FROM ({_ARCHIVE})) a
WHERE (agent_id, day) NOT IN (SELECT agent_id, memory_date FROM fx_registry WHERE day(memory_date) % 3 <> 0)""", ("fx_registry",))
def sessions_for_day(spark, sf):
    live = fx.registry(spark, sf).filter(F.dayofmonth("memory_date") % 3 != 0)
    return message_log.sessions_for_day(live, _archive(spark, sf)).select(
        "agent_id", F.col("memory_date").cast("string").alias("memory_date"), "session_id", "copy")


@query("session_alerts", f"""
SELECT c.agent_id, CAST(c.memory_date AS VARCHAR) AS memory_date, c.session_id
FROM (SELECT DISTINCT agent_id, memory_date, k.session_id FROM fx_registry JOIN ({_CURRENT}) k USING (agent_id)) c
ANTI JOIN fx_registry r USING (agent_id, memory_date, session_id)""", ("fx_registry",))
def session_alerts(spark, sf):
    """Days on which the agent's current session was not registered."""
    registry = fx.registry(spark, sf)
    current = registry.select("agent_id", "memory_date").distinct().join(_current(spark, sf), "agent_id")
    return message_log.unregistered_sessions(current, registry).withColumn("memory_date", F.col("memory_date").cast("string"))
