"""Model output, extractive summaries and the daily write."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.catalog import fixtures as fx
from memlake.catalog.registry import query
from memlake.functions import documents as dc
from memlake.functions.scores import render_topic
from memlake.operators.chunking import chunk_bounds, chunk_fragments
from memlake.plans import write


def _date():
    return F.col("memory_date").cast("string").alias("memory_date")



def _outputs(spark, sf):
    """Day summaries as a model might write them: one sound form in six wrappings and faulty variants."""
    k = F.col("doc_id") % 13
    text = F.col("text")

    def peak(intensity):
        return F.array(F.struct(F.lit(1).alias("turn"), F.lit("calm").alias("emotion"), intensity.alias("intensity"), text.alias("context")))

    def summary(intensity=F.lit(3), kind="milestone", **extra):
        parts = {
            "memory_signal": F.lit("normal"), "topics": F.array(F.struct(F.col("lang").alias("name"), text.alias("detail"))),
            "decisions": F.array(text), "todos": F.array().cast("array<string>"), "summary": text,
            "key_items": F.array(F.struct(F.lit(kind).alias("type"), text.alias("desc"))), "tags": F.array("lang", "source"),
            "day_mood": F.lit(""), "emotional_peaks": peak(intensity), "source_turns": F.array(F.lit(0), F.col("doc_id"))}
        parts.update(extra)
        return F.to_json(F.struct(*[v.alias(n) for n, v in parts.items() if v is not None]))

    plain = summary()
    raw = (F.when(k == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
            .when(k == 2, F.concat(F.lit("Here is the result:\n"), plain, F.lit("\nDone.")))
            .when(k == 3, F.concat(plain, F.lit("],\n")))
            .when(k == 4, F.concat(F.left(plain, F.length(plain) - 2), F.lit("]")))
            .when(k == 5, summary(note=F.lit("extra")))
            .when(k == 6, summary(todos=None))
            .when(k == 7, summary(intensity=F.lit(True)))
            .when(k == 8, summary(intensity=F.lit(6)))
            .when(k == 9, summary(kind="surprise"))
            .when(k == 10, summary(source_turns=F.array(F.lit(0.5))))
            .when(k == 11, summary(memory_signal=F.lit("medium")))
            .when(k == 12, summary(tags=F.array(F.lit(7))))
            .otherwise(F.concat(F.lit("  \n"), plain, F.lit("\n"))))
    return fx.table(spark, sf, "documents").select("doc_id", "source", raw.alias("raw"))


_EXPECTED = """
SELECT doc_id, CASE doc_id % 13 WHEN 1 THEN 'strip_markdown_fence' WHEN 2 THEN 'extract_outer_json_object' WHEN 3 THEN 'extract_outer_json_object'
         WHEN 4 THEN NULL ELSE 'direct' END AS method,
       CASE doc_id % 13 WHEN 4 THEN 'unparsable' WHEN 5 THEN 'keys' WHEN 6 THEN 'keys' WHEN 7 THEN 'emotional_peaks' WHEN 8 THEN 'emotional_peaks'
         WHEN 9 THEN 'key_items' WHEN 10 THEN 'source_turns' WHEN 11 THEN 'memory_signal' WHEN 12 THEN 'tags' END AS problem, text
FROM documents"""


@query("repair_json", f"SELECT doc_id, method, CASE WHEN method IS NOT NULL THEN text END AS summary FROM ({_EXPECTED})")
def repair_json(spark, sf):
    checked = write.read_model_output(_outputs(spark, sf))
    return checked.select("doc_id", "method", F.try_variant_get("document", "$.summary", "string").alias("summary"))


@query("validate_day_summary", f"SELECT doc_id, problem, problem IS NULL AS valid FROM ({_EXPECTED})")
def validate_day_summary(spark, sf):
    return write.read_model_output(_outputs(spark, sf)).select("doc_id", "problem", "valid")


@query("summaries_from_documents", f"""
SELECT doc_id, text AS summary, lang || ',' || source AS tags, lang || ': ' || text AS topic, doc_id AS last_turn
FROM documents WHERE doc_id % 13 < 4""")
def summaries_from_documents(spark, sf):
    checked = write.read_model_output(_outputs(spark, sf)).withColumnRenamed("doc_id", "chunk_id")
    typed = write.summaries_from_documents(checked)
    topic = F.element_at("topics", 1)
    return typed.select(F.col("chunk_id").alias("doc_id"), "summary", F.array_join("tags", ",").alias("tags"),
                        render_topic(topic["name"], topic["detail"]).alias("topic"), F.element_at("source_turns", -1).alias("last_turn"))


def _rollup_outputs(spark, sf, window: bool):
    k, text = F.col("doc_id") % 5, F.col("text")

    def document(intensity, **extra):
        span = {"window": F.lit("2024-01-01+28d"), "source_weeks": F.array(F.lit("2024-W01")), "window_mood": F.lit("")} if window else {
            "week": F.lit("2024-W01"), "week_mood": F.lit("")}
        parts = {**span, "window_date_start": F.lit("2024-01-01"), "window_date_end": F.lit("2024-01-07"), "summary": text,
                 "tags": F.array("lang"), "topics": F.array(F.struct(F.col("lang").alias("name"), text.alias("detail"))),
                 "decisions": F.array(text), "todos": F.array(text),
                 "key_items": F.array(F.struct(F.lit("incident").alias("type"), text.alias("desc"))),
                 "emotional_peaks": F.array(F.struct(F.lit("2024-01-02").alias("date"), F.lit("joy").alias("emotion"),
                                                     intensity.alias("intensity"), text.alias("context")))}
        parts.update(extra)
        return F.to_json(F.struct(*[v.alias(n) for n, v in parts.items()]))

    raw = (F.when(k == 1, document(F.lit(9))).when(k == 2, document(F.lit("3")))
            .when(k == 3, document(F.lit(1), summary=F.lit(3))).when(k == 4, document(F.lit(1), extra=text)).otherwise(document(F.lit(2))))
    problem = dc.window_summary_problem if window else dc.week_summary_problem
    return write.read_model_output(fx.table(spark, sf, "documents").select("doc_id", raw.alias("raw")), problem).select(
        "doc_id", "problem", "valid")


# An intensity of 9 is no fault in a rollup.
_ROLLUP_SQL = """
SELECT doc_id, problem, problem IS NULL AS valid FROM (
  SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN 'emotional_peaks' WHEN 3 THEN 'summary' WHEN 4 THEN 'keys' END AS problem FROM documents)"""
query("validate_week_summary", _ROLLUP_SQL)(lambda spark, sf: _rollup_outputs(spark, sf, False))
query("validate_window_summary", _ROLLUP_SQL)(lambda spark, sf: _rollup_outputs(spark, sf, True))


def _fragments(spark, sf):
    turns = fx.day_turns(spark, sf)
    bounds = chunk_bounds(turns.withColumn("length", F.length("content").cast("bigint")))
    return chunk_fragments(turns, bounds)


_WORDS = f"""SELECT agent_id, memory_date, turn_index, unnest({fx.sql_tokens('content')}) AS word FROM fx_day_turns"""


# Fixed value: the characters of a word, which the SQL engine's boundaries do not know beyond ASCII.
_W = r"\p{L}\p{M}\p{N}_"


def _cue(words: str, others: str) -> str:
    return f"regexp_matches(s, '(?i)(^|[^{_W}])({words})($|[^{_W}])|{others}')"


_CUES = {"decision": _cue("decided?|agreed|we will|let''s use", "决定|确定"), "todo": _cue("todo|to-do|need to|must|should", "待办|需要"),
         "milestone": _cue("released?|launched|completed|shipped", "完成|发布"), "bug_fix": _cue("fixed|bug|patch(ed)?", "修复"),
         "config_change": _cue("config(ured)?|setting|enabled|disabled", "配置"), "incident": _cue("outage|incident|crash(ed)?|failure", "故障")}
_TYPES = "CASE " + " ".join(f"WHEN {_CUES[t]} THEN '{t}'" for t in ("milestone", "bug_fix", "config_change", "incident", "decision")) + (
    " WHEN regexp_matches(s, '[?？]') THEN 'question' END")
# Findings of the built-in summariser: sentences by cue, and words with the least sentence of the first turn that has them.
_FOUND = rf""", sentences AS (
  SELECT agent_id, memory_date, turn_index, pos, s FROM (
    SELECT agent_id, memory_date, turn_index, generate_subscripts(parts, 1) - 1 AS pos, {fx.sql_strip('unnest(parts)')} AS s FROM (
      SELECT *, string_split_regex(regexp_replace(content, '([.!?。！？])\s*', '\1' || chr(1), 'g'), '\x01|\n+') AS parts FROM fx_day_turns)) WHERE s <> ''),
found AS (
  SELECT agent_id, memory_date, turn_index, 'summary' AS kind, left(s, 120) AS value, 0 AS weight, pos FROM sentences WHERE pos = 0
  UNION ALL SELECT agent_id, memory_date, turn_index, 'decision', left(s, 100), 0, pos FROM sentences WHERE {_CUES['decision']}
  UNION ALL SELECT agent_id, memory_date, turn_index, 'todo', left(s, 100), 0, pos FROM sentences WHERE {_CUES['todo']}
  UNION ALL SELECT agent_id, memory_date, turn_index, 'peak', left(s, 100), least(5, 2 + len(regexp_extract_all(s, '[!！]'))), pos FROM sentences WHERE regexp_matches(s, '[!！]')
  UNION ALL SELECT agent_id, memory_date, turn_index, 'item:' || type, left(s, 150), 0, pos FROM (SELECT *, {_TYPES} AS type FROM sentences) WHERE type IS NOT NULL
  UNION ALL SELECT agent_id, memory_date, first.t, 'topic', left(word, 20) || chr(10) || first.d, n, 0 FROM (
    SELECT agent_id, memory_date, word, count(*) AS n, min({{'t': turn_index, 'd': left(s, 120)}}) AS first FROM (
      SELECT agent_id, memory_date, turn_index, s, unnest({fx.sql_tokens('s')}) AS word FROM sentences) WHERE length(word) >= 4 GROUP BY ALL))
"""


@query("infer_map", _FOUND + """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, turn_index, kind, value, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight
FROM found GROUP BY ALL""", ("fx_day_turns",))
def infer_map(spark, sf):
    """All findings of all chunks."""
    found = write.infer_map(_fragments(spark, sf))
    return found.groupBy("agent_id", _date(), "turn_index", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


_DAY_TAGS = f"""
SELECT agent_id, memory_date, string_agg(word, ',' ORDER BY n DESC, place, word) AS tags FROM (
  SELECT agent_id, memory_date, left(word, 20) AS word, count(*) AS n, min(turn_index) AS place FROM ({_WORDS}) WHERE length(word) >= 4
  GROUP BY agent_id, memory_date, left(word, 20)
  QUALIFY row_number() OVER (PARTITION BY agent_id, memory_date ORDER BY count(*) DESC, min(turn_index), left(word, 20)) <= 10) GROUP BY ALL"""


_MERGED = """, merged AS (
  SELECT agent_id, memory_date, CASE WHEN starts_with(kind, 'item:') THEN 'item' ELSE kind END AS family, kind, name, sum(weight) AS weight, max(weight) AS highest,
         min({'t': turn_index, 'p': pos, 'v': value}) AS first
  FROM (SELECT *, CASE WHEN kind = 'topic' THEN split_part(value, chr(10), 1) ELSE value END AS name FROM found) GROUP BY ALL),
best AS (SELECT *, first.t AS turn, first.v AS value, row_number() OVER (
           PARTITION BY agent_id, memory_date, family ORDER BY weight DESC, first.t, first.p, kind, name) AS place FROM merged
         QUALIFY family NOT IN ('topic', 'summary') OR place <= CASE family WHEN 'topic' THEN 10 ELSE 1 END),
day AS (SELECT agent_id, memory_date,
    string_agg(name || ': ' || substring(value, strpos(value, chr(10)) + 1), chr(10) ORDER BY place) FILTER (family = 'topic' AND place <= 8) AS topics,
    string_agg(name, ',' ORDER BY place) FILTER (family = 'topic') AS tags, max(value) FILTER (family = 'summary') AS summary,
    string_agg(value, chr(10) ORDER BY place) FILTER (family = 'decision') AS decisions,
    string_agg(value, chr(10) ORDER BY place) FILTER (family = 'todo') AS todos,
    string_agg(substring(kind, 6) || ': ' || value, chr(10) ORDER BY place) FILTER (family = 'item') AS key_items,
    string_agg(turn || ' emphasis ' || highest || ' ' || value, chr(10) ORDER BY place) FILTER (family = 'peak') AS emotional_peaks,
    array_to_string(list_sort(list(DISTINCT turn)), ',') AS source_turns FROM best GROUP BY ALL)"""
_SUMMARY = ("summary", "topics", "decisions", "todos", "key_items", "tags", "emotional_peaks", "source_turns")


@query("infer_reduce", _FOUND + _MERGED + f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, CASE WHEN low THEN 'low' ELSE 'normal' END AS memory_signal,
       CASE WHEN low OR emotional_peaks IS NULL THEN '' ELSE 'emphatic' END AS day_mood,
       CASE WHEN low THEN '{write.LOW_SIGNAL_SUMMARY}' ELSE coalesce(summary, '') END AS summary,
       {', '.join(f"CASE WHEN low THEN '' ELSE coalesce({c}, '') END AS {c}" for c in _SUMMARY[1:])}
FROM (SELECT *, user_turns = 0 OR (total_turns <= 8 AND tags IS NULL) AS low FROM fx_days LEFT JOIN day USING (agent_id, memory_date))""", ("fx_days",))
def infer_reduce(spark, sf):
    """All fields of all day summaries."""
    fragments = _fragments(spark, sf)
    days = write.infer_reduce(write.infer_map(fragments), write.low_signal_context(fragments))
    lines = lambda name, line: F.array_join(F.transform(name, line), "\n").alias(name)
    return days.select(
        "agent_id", _date(), "memory_signal", "day_mood", "summary", lines("topics", lambda t: F.concat_ws(": ", t["name"], t["detail"])),
        F.array_join("decisions", "\n").alias("decisions"), F.array_join("todos", "\n").alias("todos"),
        lines("key_items", lambda k: F.concat_ws(": ", k["type"], k["desc"])), F.array_join("tags", ",").alias("tags"),
        lines("emotional_peaks", lambda p: F.concat_ws(" ", p["turn"].cast("string"), p["emotion"], p["intensity"].cast("string"), p["context"])),
        F.array_join(F.col("source_turns").cast("array<string>"), ",").alias("source_turns"))


@query("low_signal_context", """
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, 1 AS chunks, total_turns AS turns, user_turns,
       total_turns <= 8 AS low_allowed, user_turns = 0 AS low_forced FROM fx_days""", ("fx_days",))
def low_signal_context(spark, sf):
    return write.low_signal_context(_fragments(spark, sf)).withColumn("memory_date", _date())


@query("write_days", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS time_key, total_turns, tags, '标签：' || replace(tags, ',', ', ') AS tag_line
FROM fx_days JOIN ({_DAY_TAGS}) USING (agent_id, memory_date) WHERE user_turns > 0""", ("fx_days",))
def write_days(spark, sf):
    """Chunks, summaries, filled days, index rows and the text to embed, in one go."""
    fragments = _fragments(spark, sf)
    summaries = write.infer_reduce(write.infer_map(fragments), write.low_signal_context(fragments))
    skeletons = write.l1_skeleton(fx.days(spark, sf).select("agent_id", "memory_date", "total_turns", "user_turns"))
    filled, _ = write.finalize_days(skeletons, summaries)
    index = write.with_embed_text(write.index_rows(filled))
    counts = filled.select("agent_id", F.col("memory_date").cast("string").alias("time_key"), "total_turns")
    return index.join(counts, ["agent_id", "time_key"]).select(
        "agent_id", "time_key", "total_turns", F.array_join("tags", ",").alias("tags"),
        F.element_at(F.split("text_used", "\n"), F.when(F.col("mood") == "", -1).otherwise(-2)).alias("tag_line"))
