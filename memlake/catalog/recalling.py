"""Recall scoring, ranking, selection and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.catalog import fixtures as fx
from memlake.catalog.registry import query
from memlake.functions import scores as sc, timeaxis
from memlake.operators.diversity import diversify
from memlake.operators.prefix import id_bucket
from memlake.operators.ranking import calibrate, top_k
from memlake.plans import recall as rc
from memlake.session import materialize
from memlake.settings import Settings

_L2_VIEWS = ("fx_l1_ranked", "fx_l2_ranked")


def _today():
    return F.lit("2024-06-30").cast("date")


def _memories(spark, sf):
    """Index rows, written once, and what recall reads besides: vectors, and documents and turns of some keys."""
    rows = materialize(fx.memories(spark, sf))
    of = lambda make: lambda keys: make(spark, sf, rows.join(keys, rc.ROW, "left_semi"))
    return rows, of(fx.memory_documents), of(fx.memory_turns), fx.memory_vectors(spark, sf, rows)


def _scored(spark, sf, memories=None):
    rows, _, _, vectors = memories or _memories(spark, sf)
    return rc.score_index(fx.memory_queries(spark, sf), rows, vectors, fx.query_vectors(spark, sf))


def _anchors(spark, sf, memories=None):
    return materialize(rc.recall_anchors(materialize(_scored(spark, sf, memories))))


@query("lexical_score", """
SELECT query_id, ord_key, depth, time_key, lexical_raw FROM fx_pairs""", ("fx_pairs",))
def lexical_score(spark, sf):
    return rc.score_index(fx.memory_queries(spark, sf), fx.memories(spark, sf)).select(
        "query_id", "ord_key", "depth", "time_key", "lexical_raw")


@query("cosine_topk", """
SELECT query_id, depth, time_key, floor((embedding_raw)::DOUBLE * 10000 + 0.5) / 10000 AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY embedding_raw DESC, depth, time_key) AS rank
  FROM (SELECT DISTINCT query_id, depth, time_key, embedding_raw FROM fx_scored WHERE hybrid)) WHERE rank <= 12""", ("fx_scored",))
def cosine_topk(spark, sf):
    asked = fx.memory_queries(spark, sf).select("query_id", "agent_id")
    vectors = fx.query_vectors(spark, sf).select("query_id", F.col("embedding").alias("q"), sc.norm(F.col("embedding")).alias("qn"))
    rows = fx.memories(spark, sf).select("agent_id", "depth", "time_key").distinct()
    stored = fx.memory_vectors(spark, sf).select("agent_id", "depth", "time_key", F.col("embedding").alias("v"),
                                                 sc.norm(F.col("embedding")).alias("vn"))
    pairs = (asked.join(vectors, "query_id").join(stored.select("agent_id").distinct(), "agent_id", "left_semi")
             .join(rows.join(stored, ["agent_id", "depth", "time_key"], "left"), "agent_id"))
    similar = F.greatest(F.lit(0.0), F.coalesce(sc.cosine(F.col("q"), F.col("v"), F.col("qn"), F.col("vn")), F.lit(0.0)))
    ranked = top_k(pairs.select("query_id", "depth", "time_key", similar.alias("exact")), ["query_id"],
                   [F.desc("exact"), "depth", "time_key"], 12)
    return ranked.select("query_id", "depth", "time_key", fx.four_digits(F.col("exact")).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query("calibrate_lexical", f"""
SELECT query_id, ord_key, floor(({fx.sql_calibrated('lexical_raw', 'query_id', 'ord_key')})::DOUBLE * 10000 + 0.5) / 10000 AS lexical_score FROM fx_pairs""", ("fx_pairs",))
def calibrate_lexical(spark, sf):
    scored = materialize(rc.score_index(fx.memory_queries(spark, sf), fx.memories(spark, sf)))
    return calibrate(scored, ["query_id"], {"lexical_raw": "lexical_score"}, ["ord_key"], [id_bucket("ord_key")]).select(
        "query_id", "ord_key", fx.four_digits(F.col("lexical_score")).alias("lexical_score"))


@query("gated_fusion", """
SELECT query_id, ord_key, floor((score)::DOUBLE * 10000 + 0.5) / 10000 AS score FROM fx_fused""", ("fx_fused",))
def gated_fusion(spark, sf):
    calibrated = calibrate(materialize(_scored(spark, sf)), ["query_id"],
                           {"lexical_raw": "lexical_score", "embedding_raw": "embedding_score"}, ["ord_key"], [id_bucket("ord_key")])
    return calibrated.select("query_id", "ord_key", fx.four_digits(sc.gated_fuse(
        F.col("lexical_score"), F.col("embedding_score"), F.col("hybrid"))).alias("score"))


@query("recall_anchors", """
SELECT query_id, agent_id, depth, time_key, floor((score)::DOUBLE * 10000 + 0.5) / 10000 AS score, anchor_rank FROM fx_anchors""", ("fx_anchors",))
def recall_anchors(spark, sf):
    return rc.recall_anchors(materialize(_scored(spark, sf))).select(
        "query_id", "agent_id", "depth", "time_key", fx.four_digits(F.col("score")).alias("score"), F.col("anchor_rank").cast("bigint").alias("anchor_rank"))


@query("recall_summaries", """
SELECT query_id, depth, time_key, field, information, floor((score)::DOUBLE * 10000 + 0.5) / 10000 AS score, layer_rank FROM fx_l1_ranked""", ("fx_l1_ranked",))
def recall_summaries(spark, sf):
    memories = _memories(spark, sf)
    found = rc.recall_summaries(fx.memory_queries(spark, sf), _anchors(spark, sf, memories), memories[1])
    return found.select("query_id", "depth", "time_key", "field", "information", fx.four_digits(F.col("score")).alias("score"),
                        F.col("layer_rank").cast("bigint").alias("layer_rank"))


@query("recall_turns", """
SELECT query_id, time_key, role, hhmm, information, floor((score)::DOUBLE * 10000 + 0.5) / 10000 AS score, layer_rank FROM fx_l2_ranked""", ("fx_l2_ranked",))
def recall_turns(spark, sf):
    memories = _memories(spark, sf)
    found = rc.recall_turns(fx.memory_queries(spark, sf), _anchors(spark, sf, memories), memories[2])
    return found.select("query_id", "time_key", "role", "hhmm", "information", fx.four_digits(F.col("score")).alias("score"),
                        F.col("layer_rank").cast("bigint").alias("layer_rank"))


_CHARACTERIZED = """CASE depth WHEN 'surface' THEN CAST(time_key AS DATE)
  WHEN 'shallow' THEN CAST(date_trunc('week', make_date(CAST(left(time_key, 4) AS BIGINT), 1, 4)) AS DATE) + CAST((CAST(right(time_key, 2) AS INT) - 1) * 7 + 3 AS INT)
  ELSE CAST(left(time_key, 10) AS DATE) + 14 END"""


@query("recency_modulation", f"""
SELECT agent_id, doc_id, CAST(day AS VARCHAR) AS characterized_date, floor((1 / (1 + abs(date_diff('day', day, DATE '2024-06-30')) / 30.0))::DOUBLE * 10000 + 0.5) / 10000 AS recency,
       floor((1 / (1 + greatest(0, date_diff('day', day, DATE '2024-03-01'), date_diff('day', DATE '2024-03-31', day)) / 14.0))::DOUBLE * 10000 + 0.5) / 10000 AS window_recency,
       floor((0.7 * 0.83 * (0.85 + 0.15 / (1 + abs(date_diff('day', day, DATE '2024-06-30')) / 30.0)))::DOUBLE * 10000 + 0.5) / 10000 AS modulated
FROM (SELECT agent_id, doc_id, {_CHARACTERIZED} AS day FROM fx_memories)""", ("fx_memories",))
def recency_modulation(spark, sf):
    day = timeaxis.characterized_date(F.col("depth"), F.col("time_key"))
    none, date = F.lit(None).cast("date"), lambda d: F.lit(d).cast("date")
    rows = fx.memories(spark, sf).withColumn("day", day)
    recency = sc.recency_score(F.col("day"), _today(), none, none)
    weighted = F.lit(0.83) * sc.layer_weight(F.lit("l1"), F.lit(None).cast("double"))
    return rows.select(
        "agent_id", "doc_id", F.col("day").cast("string").alias("characterized_date"), fx.four_digits(recency).alias("recency"),
        fx.four_digits(sc.recency_score(F.col("day"), _today(), date("2024-03-01"), date("2024-03-31"))).alias("window_recency"),
        fx.four_digits(sc.recency_modulate(weighted, recency)).alias("modulated"))


# Greedy selection as a recursive walk over the ranked candidates of each query.
_WORDS = r"[^\p{L}\p{M}\p{N}]+"
_WEIGHED = f"""
, cand AS (
  SELECT query_id, depth, time_key, field, information, score, layer_rank, 'l1' AS source_layer, NULL::VARCHAR AS role, NULL::VARCHAR AS hhmm FROM fx_l1_ranked
  UNION ALL SELECT query_id, depth, time_key, 'conversation_excerpt', information, score, layer_rank, 'l2', role, hhmm FROM fx_l2_ranked),
weighed AS (
  SELECT *, round(w * (0.85 + 0.15 / (1 + abs(date_diff('day', {_CHARACTERIZED}, DATE '2024-06-30')) / 30.0)), 6) AS final_score,
         round(w, 6) AS weighted_score, trim(regexp_replace(lower(information), '{_WORDS}', ' ', 'g')) AS normalized
  FROM (SELECT *, greatest(0, least(1, score)) * CASE source_layer WHEN 'l1' THEN 0.7 ELSE 0.3 END AS w FROM cand)),
walk AS MATERIALIZED (
  SELECT *, string_split(normalized, ' ') AS words,
         row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, weighted_score DESC, source_layer, time_key, layer_rank) AS place
  FROM (SELECT * FROM weighed WHERE normalized <> '' QUALIFY row_number() OVER (
          PARTITION BY query_id, normalized ORDER BY final_score DESC, weighted_score DESC, source_layer, time_key, layer_rank) = 1)),
"""
_CHOSEN = _WEIGHED + """
steps AS (
  SELECT query_id, 0::BIGINT AS place, []::STRUCT(time_key VARCHAR, field VARCHAR, layer VARCHAR, words VARCHAR[], place BIGINT)[] AS kept
  FROM (SELECT DISTINCT query_id FROM walk)
  UNION ALL
  SELECT s.query_id, w.place, CASE
    WHEN len(s.kept) >= 8 OR len(list_filter(s.kept, lambda k: k.time_key = w.time_key)) >= 3
      OR len(list_filter(s.kept, lambda k: k.time_key = w.time_key AND k.field = w.field)) > 0
      OR (len(list_filter(s.kept, lambda k: k.time_key = w.time_key AND
              len(list_intersect(k.words, w.words)) >= 0.75 * least(len(k.words), len(list_distinct(w.words))))) > 0
          AND NOT (w.source_layer = 'l2' AND len(list_filter(s.kept, lambda k: k.time_key = w.time_key AND k.layer = 'l2')) = 0))
    THEN s.kept
    ELSE list_append(s.kept, {'time_key': w.time_key, 'field': w.field, 'layer': w.source_layer, 'words': list_distinct(w.words), 'place': w.place}) END
  FROM steps s JOIN walk w ON w.query_id = s.query_id AND w.place = s.place + 1),
chosen AS (
  SELECT query_id, unnest(range(1, len(kept) + 1)) AS rank, unnest(kept).place AS place
  FROM (SELECT query_id, arg_max(kept, place) AS kept FROM steps GROUP BY query_id))
"""


@query("diversify", _CHOSEN + """
SELECT query_id, rank, source_layer, depth, time_key, field, floor((final_score)::DOUBLE * 10000 + 0.5) / 10000 AS final_score, information
FROM chosen JOIN walk USING (query_id, place)""", _L2_VIEWS)
def diversified(spark, sf):
    return diversify(_candidates(spark, sf), 8).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "source_layer", "depth", "time_key", "field",
        fx.four_digits(F.col("final_score")).alias("final_score"), "information")


def _candidates(spark, sf):
    return materialize(rc.recall_candidates(
        fx.memory_queries(spark, sf), *_memories(spark, sf), fx.query_vectors(spark, sf), today=_today()))


_LINE = """'- [' || depth || ' ' || time_key || CASE source_layer WHEN 'l2' THEN ' ' || hhmm || ' ' || role || '] ' ELSE '] ' || CASE field
  WHEN 'summary' THEN '摘要' WHEN 'topic_name' THEN '主题' WHEN 'topic_detail' THEN '主题细节' WHEN 'decision' THEN '决策' WHEN 'todo' THEN '待办'
  WHEN 'key_item' THEN '关键事项[question]' WHEN 'emotional_peak_context' THEN '情绪高点[calm]' ELSE '情绪' END || '：' END || information"""


@query("recall", _CHOSEN + f"""
, lines AS (SELECT query_id, source_layer, string_agg({_LINE}, chr(10) ORDER BY rank) AS block, sum(length({_LINE}) + 1) AS size
            FROM chosen JOIN walk USING (query_id, place) GROUP BY ALL)
SELECT q.query_id, q.agent_id, coalesce(concat_ws(chr(10), '### 相关摘要' || chr(10) || a.block, '### 相关对话摘录' || chr(10) || b.block), '') AS assembled_text
FROM fx_queries q LEFT JOIN lines a ON a.query_id = q.query_id AND a.source_layer = 'l1'
LEFT JOIN lines b ON b.query_id = q.query_id AND b.source_layer = 'l2'""", (*_L2_VIEWS, "fx_queries"))
def recall(spark, sf):
    """The whole recall path: index, summaries, turns, weighing, selection, answer text."""
    answers = rc.recall(fx.memory_queries(spark, sf), *_memories(spark, sf), fx.query_vectors(spark, sf), today=_today())
    return answers.select("query_id", "agent_id", "assembled_text")


@query("iso_week_calendar", """
SELECT CAST(day AS VARCHAR) AS day, strftime(day, '%G-W%V') AS week, CAST(date_trunc('week', day) AS DATE)::VARCHAR AS monday,
       CAST(date_trunc('week', day) AS DATE)::VARCHAR AS week_start, (CAST(date_trunc('week', day) AS DATE) + 6)::VARCHAR AS week_end,
       strftime(CAST(date_trunc('week', day) AS DATE) - 21, '%G-W%V') AS three_before, strftime(CAST(date_trunc('week', day) AS DATE) - 7, '%G-W%V') AS previous,
       (CAST(date_trunc('week', day) AS DATE) - 15)::VARCHAR AS trim_boundary, orders
FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1)""")
def iso_week_calendar(spark, sf):
    days = fx.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    day, week = F.col("day"), F.col("week")
    return days.withColumn("week", timeaxis.week_id(day)).select(
        day.cast("string").alias("day"), "week", timeaxis.monday(day).cast("string").alias("monday"),
        timeaxis.week_monday(week).cast("string").alias("week_start"), timeaxis.week_sunday(week).cast("string").alias("week_end"),
        timeaxis.shift_week(week, -3).alias("three_before"), timeaxis.previous_week(day).alias("previous"),
        timeaxis.trim_boundary(week).cast("string").alias("trim_boundary"), "orders")


CAP = 600


@query("recall_capped", _CHOSEN + f"""
, said AS (SELECT query_id, source_layer, rank, {_LINE} AS line FROM chosen JOIN walk USING (query_id, place)),
one AS (SELECT query_id, '### 相关摘要' || coalesce(string_agg(chr(10) || line, '' ORDER BY rank) FILTER (used <= {CAP}), '') AS text
        FROM (SELECT *, 8 + sum(1 + length(line)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM said WHERE source_layer = 'l1') GROUP BY query_id),
two AS (SELECT query_id, '### 相关对话摘录' || coalesce(string_agg(chr(10) || line, '' ORDER BY rank) FILTER (used <= {CAP}), '') AS text
        FROM (SELECT s.*, begin + sum(1 + length(line)) OVER (PARTITION BY query_id ORDER BY rank) AS used
              FROM (SELECT said.*, CASE WHEN one.text IS NULL THEN 10 ELSE length(one.text) + 11 END AS begin FROM said LEFT JOIN one USING (query_id)
                    WHERE source_layer = 'l2') s WHERE begin <= {CAP}) GROUP BY query_id)
SELECT q.query_id, q.agent_id, coalesce(concat_ws(chr(10), one.text, two.text), '') AS assembled_text
FROM fx_queries q LEFT JOIN one USING (query_id) LEFT JOIN two USING (query_id)""", (*_L2_VIEWS, "fx_queries"))
def recall_capped(spark, sf):
    """Answers of six hundred characters at most: each section ends at its first line that does not fit."""
    answers = rc.recall(fx.memory_queries(spark, sf), *_memories(spark, sf), fx.query_vectors(spark, sf), today=_today(),
                        settings=Settings(max_chars=CAP))
    return answers.select("query_id", "agent_id", "assembled_text")


@query("index_entries", f"""
SELECT doc_id, CASE WHEN k IN (0, 2, 3, 6) THEN 'surface' WHEN k = 1 THEN 'shallow' WHEN k = 4 THEN 'deep' ELSE 'other' END AS depth,
       CASE WHEN k = 1 THEN 'week' WHEN k = 4 THEN 'window' WHEN k = 5 THEN 'week' ELSE 'day' END || doc_id AS time_key,
       {fx.sql_strip("concat_ws(' ', nullif(text, ''), nullif(lang || ' ' || source, ' '), nullif(lang, ''), nullif(text || ' ' || lang, ' '))")} AS text
FROM (SELECT *, doc_id % 7 AS k FROM documents)""")
def index_entries(spark, sf):
    """Entries with and without depth, granularity and keys."""
    k, name = F.col("doc_id") % 7, lambda n: F.concat(F.lit(n), F.col("doc_id").cast("string"))
    depth = F.when(k == 0, "surface").when(k == 1, " SHALLOW").when(k == 4, "deep").when(k == 5, "Other").when(k == 6, "").otherwise(None)
    entries = fx.table(spark, sf, "documents").select(
        "doc_id", depth.alias("depth"), F.when(k == 2, "Daily").when(k == 3, "surface ").when(k == 5, "weekly").alias("granularity"),
        F.when(k != 5, name("day")).alias("date"), name("week").alias("week"), name("window").alias("window"),
        F.col("text").alias("summary"), F.array("lang", "source").alias("tags"), F.col("lang").alias("mood"), F.array("text", "lang").alias("decisions"))
    return rc.index_entries(entries).select("doc_id", "depth", "time_key", "text")


@query("runtime_penalty", f"""
SELECT doc_id, floor((CASE WHEN n >= 2 THEN {sc.RUNTIME_PENALTY} * greatest(0.0, least(1.0, score)) ELSE score END)::DOUBLE * 10000 + 0.5) / 10000 AS score
FROM (SELECT doc_id, doc_id % 13 / 10.0 AS score, {' + '.join(f"CAST(contains(lower(t), '{m}') AS INT)" for m in sc.RUNTIME_MARKERS)} AS n
      FROM (SELECT doc_id, text || ' ' || [{', '.join(f"upper('{m}')" for m in sc.RUNTIME_MARKERS)}][doc_id % {len(sc.RUNTIME_MARKERS)} + 1]
              || CASE WHEN doc_id % 3 = 0 THEN '{sc.RUNTIME_MARKERS[0]}' ELSE '' END AS t FROM documents))""")
def runtime_penalty(spark, sf):
    """Texts with one or two marks of a host program's own output."""
    marks = F.array(*[F.upper(F.lit(m)) for m in sc.RUNTIME_MARKERS])
    own = F.element_at(marks, (F.col("doc_id") % len(sc.RUNTIME_MARKERS) + 1).cast("int"))
    text = F.concat("text", F.lit(" "), own, F.when(F.col("doc_id") % 3 == 0, sc.RUNTIME_MARKERS[0]).otherwise(""))
    score = (F.col("doc_id") % 13) / F.lit(10.0)
    return fx.table(spark, sf, "documents").select("doc_id", fx.four_digits(sc.runtime_penalty(score, text)).alias("score"))


@query("date_windows", """
SELECT given, CAST(day AS VARCHAR) AS day, count(*) AS orders FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders),
  (VALUES ('1995-02-10, 1995-01-20', DATE '1995-01-20', DATE '1995-02-10'), ('1996-03-01', DATE '1996-03-01', DATE '1996-03-01'),
          ('1997-01-01,1997-01-03,', DATE '1997-01-01', DATE '1997-01-03')) w(given, a, b)
WHERE day BETWEEN a AND b GROUP BY ALL""")
def date_windows(spark, sf):
    """Orders in windows given as one date, two dates, and two in the wrong order."""
    days = fx.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    parts = []
    for given in ("1995-02-10, 1995-01-20", "1996-03-01", "1997-01-01,1997-01-03,"):
        start, end = timeaxis.date_window(given)
        parts.append(days.where(timeaxis.date_in_range(F.col("day"), start=start, end=end)).withColumn("given", F.lit(given)))
    counted = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("given", "day").agg(F.count(F.lit(1)).alias("orders"))
    return counted.withColumn("day", F.col("day").cast("string"))
