"""Cleaning, days, counts and message sources."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from memlake.catalog import fixtures as fx
from memlake.catalog.registry import query
from memlake.functions import text as tx, timeaxis
from memlake.functions.text import estimate_tokens
from memlake.operators.merging import union_distinct
from memlake.plans import extract
from memlake.session import checkpoint_dir
from memlake.sources import message_log, message_tables

# Fixed values, the redaction patterns in RE2's spelling: its \w and \b know ASCII only.
_W = r"\p{L}\p{M}\p{N}_"
_RE2 = {
    "key": (r"(?i)(sk-|pk-|api[-_]?key[\s=:]+)[^\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]{10,}"),
    "mobile": r"\b1[3-9]\d{9}\b",
    "email": rf"[{_W}][{_W}.+-]*@[{_W}.-]+\.[{_W}]{{2,}}",
    "digits": r"\b\d{9,10}\b",
    "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}


def _sql_redacted(text: str, upto: int | None = None) -> str:
    for pattern in list(_RE2.values())[:upto]:
        text = f"regexp_replace({text}, '{pattern}', '[REDACTED]', 'g')"
    return text


@query("redact_documents", f"SELECT doc_id, {_sql_redacted('text')} AS redacted FROM documents")
def redact_documents(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.redact(F.col("text")).alias("redacted"))


@query("redaction_report", "SELECT source, count(*) AS documents, " + ", ".join(
    f"CAST(sum(len(regexp_extract_all({_sql_redacted('text', i)}, '{p}'))) AS BIGINT) AS {name}_hits"
    for i, (name, p) in enumerate(_RE2.items())) + " FROM documents GROUP BY source")
def redaction_report(spark, sf):
    hits = tx.redaction_hits(F.col("text"))
    return fx.table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), *[F.sum(c).cast("bigint").alias(f"{n}_hits") for n, c in hits.items()])


@query("logical_day_turns", """
SELECT agent_id, message_id, CAST(memory_date AS VARCHAR) AS memory_date, hhmm FROM fx_day_turns""", ("fx_day_turns",))
def logical_day_turns(spark, sf):
    return extract.with_days(fx.turns(spark, sf)).select(
        "agent_id", "message_id", F.col("memory_date").cast("string").alias("memory_date"), "hhmm")


# Windows of an agent: a day and a half from every noon and midnight of January, each month, and two that are empty or upside down.
_SPANS = """
SELECT 'w' || n AS window_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 12 HOUR * n AS window_start, TIMESTAMP '2024-01-02 12:00:00' + INTERVAL 12 HOUR * n AS window_end
FROM (SELECT CAST(unnest(range(0, 62)) AS INT) AS n)
UNION ALL SELECT 'm' || n, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MONTH * n, TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 MONTH * n FROM (SELECT CAST(unnest(range(0, 12)) AS INT) AS n)
UNION ALL SELECT 'empty', TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-05 00:00:00' UNION ALL SELECT 'back', TIMESTAMP '2024-01-06 00:00:00', TIMESTAMP '2024-01-05 00:00:00'"""


@query("overlapping_windows", f"""
SELECT agent_id, window_id, count(*) AS messages, CAST(sum(event_id) AS BIGINT) AS ids FROM (
  SELECT CASE WHEN user_id % 3 < 2 THEN 'most' ELSE 'agent_' || user_id % 7 END AS agent_id, event_id, ts FROM events) e
JOIN (SELECT agent_id, s.* FROM (SELECT unnest(['most', 'agent_0', 'agent_1', 'agent_2', 'agent_3', 'agent_4']) AS agent_id), ({_SPANS}) s) w USING (agent_id)
WHERE ts >= window_start AND ts < window_end GROUP BY ALL""")
def overlapping_windows(spark, sf):
    """Messages in windows that overlap, last a month or are empty; one agent has most messages, two have no windows."""
    agent = F.when(F.col("user_id") % 3 < 2, "most").otherwise(F.concat(F.lit("agent_"), (F.col("user_id") % 7).cast("string")))
    messages = fx.table(spark, sf, "events").select(agent.alias("agent_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    stamp = lambda text: F.lit(text).cast("timestamp")
    half = spark.range(62).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("window_id"),
                                  (stamp("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), (F.col("id") * 12).cast("int"))).alias("window_start"),
                                  (stamp("2024-01-02 12:00:00") + F.make_dt_interval(F.lit(0), (F.col("id") * 12).cast("int"))).alias("window_end"))
    first = lambda n: F.add_months(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("timestamp")
    months = spark.range(12).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("window_id"), first(F.col("id")).alias("window_start"),
                                    first(F.col("id") + 1).alias("window_end"))
    none = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("window_id"), stamp(a).alias("window_start"), stamp(b).alias("window_end"))
                                 for n, a, b in (("empty", "2024-01-05", "2024-01-05"), ("back", "2024-01-06", "2024-01-05"))])).alias("w")).select("w.*")
    agents = F.explode(F.array(*[F.lit(a) for a in ("most", *[f"agent_{i}" for i in range(5)])])).alias("agent_id")
    windows = half.unionByName(months).unionByName(none).select("*", agents)
    found = timeaxis.assign_windows(messages, windows, keys=("agent_id",))
    return found.groupBy("agent_id", "window_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("event_id").alias("ids"))


@query("window_messages", """
SELECT CAST(memory_date AS VARCHAR) AS memory_date, agent_id, message_id
FROM (SELECT DISTINCT memory_date FROM fx_day_turns) w JOIN fx_turns t
  ON (ts AT TIME ZONE 'UTC') >= ((w.memory_date + INTERVAL 22 HOUR - INTERVAL 1 DAY) AT TIME ZONE 'Europe/London')
 AND (ts AT TIME ZONE 'UTC') < ((w.memory_date + INTERVAL 26 HOUR) AT TIME ZONE 'Europe/London')""", ("fx_day_turns",))
def window_messages(spark, sf):
    """Overlapping windows from 22:00 the evening before to 02:00 the morning after."""
    turns = extract.with_days(fx.turns(spark, sf))
    windows = timeaxis.day_windows(turns.select("memory_date").distinct(), start_offset=-1, start_hour=22,
                                   end_offset=1, end_hour=2)
    return timeaxis.assign_windows(turns.drop("memory_date"), windows).select(
        F.col("memory_date").cast("string").alias("memory_date"), "agent_id", "message_id")


@query("order_turns", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, message_id, turn_index FROM fx_day_turns""", ("fx_day_turns",))
def order_turns(spark, sf):
    return fx.day_turns(spark, sf).select(
        "agent_id", F.col("memory_date").cast("string").alias("memory_date"), "message_id", "turn_index")


@query("day_stats", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, total_turns, user_turns, assistant_turns FROM fx_days""", ("fx_days",))
def day_stats(spark, sf):
    return extract.day_stats(extract.with_days(fx.turns(spark, sf))).select(
        "agent_id", F.col("memory_date").cast("string").alias("memory_date"), "total_turns", "user_turns", "assistant_turns")


@query("day_markers", """
SELECT c.agent_id, CAST(c.memory_date AS VARCHAR) AS memory_date,
       CASE WHEN d.total_turns IS NULL THEN 'noconversation' ELSE 'nocontent' END AS marker
FROM (SELECT agent_id, CAST(unnest(generate_series(min(memory_date), max(memory_date), INTERVAL 1 DAY)) AS DATE) AS memory_date
      FROM fx_days GROUP BY agent_id) c
LEFT JOIN fx_days d USING (agent_id, memory_date) WHERE d.total_turns IS NULL OR d.user_turns <= 1""", ("fx_days",))
def day_markers(spark, sf):
    stats = extract.day_stats(extract.with_days(fx.turns(spark, sf)))
    return extract.day_markers(stats).withColumn("memory_date", F.col("memory_date").cast("string"))


@query("token_estimate", """
SELECT source, CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 2) END) AS BIGINT) AS tokens_by_turn,
       CAST(CASE WHEN sum(length(text)) = 0 THEN 0 ELSE greatest(1, sum(length(text)) // 2) END AS BIGINT) AS tokens_in_total
FROM documents GROUP BY source""")
def token_estimate(spark, sf):
    size = F.length("text")
    return fx.table(spark, sf, "documents").groupBy("source").agg(
        F.sum(estimate_tokens(size, 2)).alias("tokens_by_turn"), estimate_tokens(F.sum(size), 2).alias("tokens_in_total"))


@query("union_distinct_turns", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, message_id, min(origin) AS origin
FROM (SELECT *, 0 AS origin FROM fx_day_turns WHERE role <> 'system'
      UNION ALL SELECT *, 1 AS origin FROM fx_day_turns WHERE role <> 'assistant')
GROUP BY ALL""", ("fx_day_turns",))
def union_distinct_turns(spark, sf):
    turns = fx.day_turns(spark, sf)
    keys = ["agent_id", "memory_date", "session_id", "message_id", "role", "content"]
    merged = union_distinct(turns.filter("role != 'system'"), turns.filter("role != 'assistant'"), keys, "turn_index")
    return merged.select("agent_id", F.col("memory_date").cast("string").alias("memory_date"), "message_id",
                         F.col("origin").cast("bigint").alias("origin"))


@query("merge_transcript", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, session_id, hhmm, role, content,
       row_number() OVER (PARTITION BY agent_id, memory_date ORDER BY ts, session_id, origin, old_index) - 1 AS turn_index
FROM (SELECT agent_id, memory_date, session_id, ts, hhmm, role, content, min(origin) AS origin, arg_min(turn_index, (origin, turn_index)) AS old_index
      FROM (SELECT *, 0 AS origin FROM fx_day_turns WHERE role <> 'user' UNION ALL SELECT *, 1 AS origin FROM fx_day_turns)
      GROUP BY ALL)""", ("fx_day_turns",))
def merge_transcript(spark, sf):
    turns = fx.day_turns(spark, sf).withColumn("message_type", F.lit("text"))
    merged = extract.merge_transcript(turns.filter("role != 'user'"), turns)
    return merged.select("agent_id", F.col("memory_date").cast("string").alias("memory_date"), "session_id", "hhmm",
                         "role", "content", "turn_index")


# --- message logs --------------------------------------------------------------------------

def _log_lines(spark, sf):
    """Conversations as log lines: text blocks, plain texts, tool results, broken lines and tags."""
    turns = fx.turns(spark, sf)
    kind = F.col("message_id") % 5
    said = F.when(kind == 3, F.concat(F.lit("[[reply_to_current]]\n"), F.col("content"))).otherwise(F.col("content"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def line(role, content):
        return F.to_json(F.struct(F.lit("message").alias("type"), stamp.alias("timestamp"),
                                  F.struct(role.alias("role"), content.alias("content")).alias("message")))

    block = F.array(F.struct(F.lit("thinking").alias("type"), F.lit("hidden").alias("text")),
                    F.struct(F.lit("text").alias("type"), said.alias("text")))
    value = (F.when(kind == 0, line(F.col("role"), said))
              .when(kind == 4, line(F.when(F.col("role") == "system", "toolResult").otherwise(F.col("role")), said))
              .otherwise(line(F.col("role"), block)))
    value = F.when(F.col("message_id") % 11 == 7, F.left(value, F.length(value) - 3)).otherwise(value)
    return turns.select("agent_id", F.col("session_id").cast("string").alias("session_id"), "message_id", value.alias("value"))


@query("read_message_log", f"""
SELECT agent_id, message_id, role, {_sql_redacted(fx.sql_strip('content'))} AS content, 'text' AS message_type
FROM fx_turns WHERE message_id % 11 <> 7 AND role <> 'system'""", ("fx_turns",))
def read_message_log(spark, sf):
    messages = message_log.parse_log_lines(_log_lines(spark, sf))
    return message_log.clean_messages(messages).select("agent_id", "message_id", "role", "content", "message_type")


@query("log_day_stats", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, count(*) AS total_turns,
       count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns
FROM fx_day_turns WHERE message_id % 11 <> 7 AND NOT (message_id % 5 = 4 AND role = 'system') GROUP BY ALL""", ("fx_day_turns",))
def log_day_stats(spark, sf):
    messages = extract.with_days(message_log.parse_log_lines(_log_lines(spark, sf)))
    return extract.day_stats(messages).select(
        "agent_id", F.col("memory_date").cast("string").alias("memory_date"), "total_turns", "user_turns", "assistant_turns")


_USER_TEXT_SQL = """
SELECT doc_id, {redacted} AS cleaned, CASE WHEN doc_id % 4 = 2 THEN 'audio' ELSE 'text' END AS message_type
FROM (SELECT doc_id, {stripped} AS body FROM documents)"""


@query("clean_user_text", _USER_TEXT_SQL.format(redacted=_sql_redacted("body"), stripped=fx.sql_strip("text")))
def clean_user_text(spark, sf):
    """Documents wrapped the way hosts wrap user texts; cleaning must give the documents back."""
    body = tx.strip(F.col("text"))
    header = F.lit("Conversation info (untrusted metadata):\n```json\n{\"id\": 1}\n```\n\n"
                   "Sender (untrusted metadata):\n```json\n{\"name\": \"x\"}\n```\n\n")
    one_line = F.regexp_replace(body, r"(?U)\s*[\r\n\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]\s*", "\n")
    kind = F.col("doc_id") % 4
    wrapped = (F.when(kind == 0, F.concat(header, body))
                .when(kind == 1, F.concat(F.lit("[[reply_to:17]] [[reply_to_current]]\n"), body))
                .when(kind == 2, F.concat(F.lit("[Audio]\nUser text:\n[Telegram someone] "), one_line, F.lit("\nTranscript:\nheard")))
                .otherwise(body))
    rows = fx.table(spark, sf, "documents").select("doc_id", tx.clean_user_text(wrapped).alias("c"))
    return rows.select("doc_id", F.col("c.text").alias("cleaned"), F.col("c.message_type").alias("message_type"))


# --- message tables -----------------------------------------------------------------------

def _message_tables(spark, sf):
    base = fx.table(spark, sf, "conversations")
    note = (F.col("role") == "assistant") & (F.col("turn") % 3 == 0)
    messages = base.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "role",
        F.when(note, F.concat(F.lit("  [CONTEXT COMPACTION] "), F.col("text"))).otherwise(F.col("text")).alias("content"),
        (F.col("conv_id") * 61260 + F.col("turn") * 180).cast("double").alias("timestamp"))
    sessions = base.select(F.col("conv_id").alias("id")).distinct().select(
        "id", F.lit("cli").alias("source"), F.lit("").alias("title"),
        F.when(F.col("id") % 2 == 0, (F.col("id") + 1).cast("string")).alias("parent_session_id"))
    return messages, sessions


@query("read_message_tables", """
SELECT conv_id AS session_id, conv_id * 1000 + turn AS message_id, role, 'cli' AS session_source
FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' AND conv_id * 61260 + turn * 180 >= 86400""")
def read_message_tables(spark, sf):
    messages, sessions = _message_tables(spark, sf)
    return message_tables.join_messages(messages, sessions, start=86400.0).select(
        "session_id", "message_id", "role", "session_source")


@query("compaction_replay", """
SELECT conv_id AS session_id, conv_id * 1000 + turn AS message_id
FROM conversations c LEFT JOIN (SELECT conv_id AS sid, min(turn) AS note FROM conversations
                                WHERE role = 'assistant' AND turn % 3 = 0 AND conv_id % 2 = 0 GROUP BY 1) n ON sid = conv_id
WHERE role IN ('user', 'assistant') AND (note IS NULL OR turn > note)""")
def compaction_replay(spark, sf):
    return message_tables.drop_compaction_replay(message_tables.join_messages(*_message_tables(spark, sf))).select(
        "session_id", "message_id")


def _tool_rows(spark, sf):
    k = F.get_json_object("props", "$.k")
    path = F.concat(F.lit("/data/"), k)
    event = F.col("event_type")
    raw = (F.when(event == "click", F.concat(F.lit('{"name": "read", "arguments": {"path": "'), path, F.lit('"}}')))
            .when(event == "view", F.concat(F.lit('[{"name": "Write_File", "arguments": {"file_path": "'), path,
                                            F.lit('"}}, 5, {"name": "search", "arguments": {}}]')))
            .when(event == "purchase", F.concat(F.lit('{"function": {"name": "exec", "arguments": "{\\"command\\": \\"run '), k,
                                                F.lit('\\"}"}}')))
            .when(event == "signup", F.concat(F.lit('{"name": "terminal", "arguments": {"command": "'), F.repeat(F.lit("x"), 198),
                                              path, F.lit('"}}')))
            .otherwise(F.concat(F.lit('{"name": "read", '), path)))
    return fx.table(spark, sf, "events").select(
        F.concat(F.lit("agent_"), (F.col("user_id") % 5).cast("string")).alias("agent_id"),
        timeaxis.logical_day(F.col("ts")).alias("memory_date"), F.col("event_id").alias("message_id"),
        F.lit("assistant").alias("role"), raw.alias("tool_calls"))


_TOOL_SQL = """
SELECT agent_id, message_id, tool_name, kind, item FROM (
  SELECT concat('agent_', user_id % 5) AS agent_id, event_id AS message_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' - INTERVAL 3 HOUR AS DATE) AS memory_date,
         unnest(CASE event_type WHEN 'click' THEN [{'tool_name': 'read', 'kind': 'files_read', 'item': '/data/' || k}]
           WHEN 'view' THEN [{'tool_name': 'Write_File', 'kind': 'files_written', 'item': '/data/' || k}, {'tool_name': 'search', 'kind': NULL, 'item': NULL}]
           WHEN 'purchase' THEN [{'tool_name': 'exec', 'kind': 'commands_run', 'item': 'run ' || k}]
           WHEN 'signup' THEN [{'tool_name': 'terminal', 'kind': 'commands_run', 'item': left(repeat('x', 198) || '/data/' || k, 200) || '...'}]
           ELSE [] END, recursive := true)
  FROM (SELECT *, props ->> '$.k' AS k FROM events))"""


@query("tool_calls", _TOOL_SQL)
def tool_calls(spark, sf):
    calls = message_tables.classify_tool_call(message_tables.tool_calls(_tool_rows(spark, sf)))
    return calls.select("agent_id", "message_id", "tool_name", "kind", "item")


@query("tool_items", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, kind, item,
       row_number() OVER (PARTITION BY agent_id, memory_date, kind ORDER BY first_use, item) - 1 AS position
FROM (SELECT agent_id, memory_date, kind, item, min(message_id) AS first_use FROM (
        SELECT agent_id, memory_date, message_id, kind, item FROM ({_TOOL_SQL.replace('tool_name, kind, item FROM', 'memory_date, tool_name, kind, item FROM', 1)}) WHERE item IS NOT NULL
        UNION ALL SELECT agent_id, memory_date, message_id, 'tools_used', tool_name FROM ({_TOOL_SQL.replace('tool_name, kind, item FROM', 'memory_date, tool_name, kind, item FROM', 1)}))
      GROUP BY ALL)""")
def tool_items(spark, sf):
    calls = message_tables.classify_tool_call(message_tables.tool_calls(_tool_rows(spark, sf)))
    return extract.tool_items(calls, ["message_id", "call_pos"]).select(
        "agent_id", F.col("memory_date").cast("string").alias("memory_date"), "kind", "item", "position")


@query("resolve_session_version", """
SELECT folder, session_id, arg_max(name, (plain, name)) AS file_name FROM (
  SELECT 'host' || user_id % 7 AS folder, 's' || user_id AS session_id, event_type = 'click' AS plain,
         CASE event_type WHEN 'click' THEN 's' || user_id || '.jsonl' ELSE 's' || user_id || '.jsonl.reset.' || strftime(ts, '%Y-%m-%d') END AS name
  FROM events) GROUP BY ALL""")
def resolve_session_version(spark, sf):
    name = F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit(".jsonl"))
    file_name = F.when(F.col("event_type") == "click", name).otherwise(
        F.concat(name, F.lit(".reset."), F.date_format("ts", "yyyy-MM-dd")))
    folder = F.concat(F.lit("host"), (F.col("user_id") % 7).cast("string"))
    files = fx.table(spark, sf, "events").select(
        F.concat_ws("/", F.lit("/logs"), folder, file_name).alias("file_path"), file_name.alias("file_name")).distinct()
    return message_log.resolve_session_version(files).select(
        F.element_at(F.split("file_path", "/"), -2).alias("folder"), "session_id", "file_name")


# --- log files -------------------------------------------------------------------------------------

_LINE = """CASE (conv_id + turn) % 7 WHEN 0 THEN ' ' WHEN 1 THEN '{broken ' || conv_id || ':' || turn WHEN 2 THEN '{"type":"session","id":"' || conv_id || ':' || turn || '"}'
  WHEN 3 THEN '{"type":"message","timestamp":"never","message":{"role":"user","content":"' || conv_id || ':' || turn || '"}}'
  WHEN 4 THEN '{"type":"message","timestamp":"2024-01-01T10:00:00Z","message":{"role":"toolResult","content":"' || conv_id || ':' || turn || '"}}' END"""


def write_log_files(spark, sf) -> str:
    """Conversations as JSON lines, a file for each agent and session, with five kinds of lines that are no messages."""
    rows = fx.table(spark, sf, "conversations")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    good = F.to_json(F.struct(F.lit("message").alias("type"), stamp.alias("timestamp"), F.struct("role", F.col("text").alias("content")).alias("message")))
    lines = rows.select(F.concat(F.lit("agent_"), (F.col("conv_id") % 5).cast("string")).alias("agent"), F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string")).alias("session"),
                        F.coalesce(F.expr(_LINE), good).alias("value"))
    base = f"{checkpoint_dir(spark)}/logs-{uuid4().hex}"
    lines.repartition("agent", "session").write.partitionBy("agent", "session").text(f"{base}/written")
    # Spark names its own files; sessions are told by theirs. One rename for each of the fifteen files.
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(path(f"{base}/written/*/*/part-*")):
        session = found.getPath().getParent()
        folder = path(f"{base}/logs/{session.getParent().getName().split('=')[1]}")
        files.mkdirs(folder)
        files.rename(found.getPath(), path(folder, f"{session.getName().split('=')[1]}.jsonl"))
    files.mkdirs(path(f"{base}/logs"))
    return f"{base}/logs"


@query("message_log_files", f"""
SELECT 'agent_' || conv_id % 5 AS agent_id, 's' || conv_id % 3 AS session_id, ['good', 'blank', 'unparsable', 'other_type', 'no_time', 'tool_result'][
         CASE WHEN (conv_id + turn) % 7 > 4 THEN 1 ELSE (conv_id + turn) % 7 + 2 END] AS outcome,
       coalesce({_LINE}, role || '|' || (1704067200 + conv_id * 60 + turn) || '|' || text) AS content
FROM conversations""")
def message_log_files(spark, sf):
    """Messages and quarantined lines of written files; together they are all lines."""
    path = write_log_files(spark, sf)
    good = message_log.read_message_log(spark, path).select(
        "agent_id", "session_id", F.lit("good").alias("outcome"),
        F.concat_ws("|", "role", F.unix_timestamp("ts").cast("string"), F.col("blocks")[0]["text"]).alias("content"))
    bad = message_log.quarantine(spark, path)
    return good.unionByName(bad.select("agent_id", "session_id", F.col("problem").alias("outcome"), F.col("value").alias("content")))
