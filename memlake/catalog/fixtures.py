"""Views derived from the shared tables: once as Spark DataFrames, once as SQL text for checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.functions import timeaxis
from memlake.operators.prefix import id_bucket, ordinal
from memlake.plans.extract import order_turns, with_days

PIECE = 120


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A shared table. Texts that lie in fewer pieces than there are cores (one small file) are spread over them; others stay where they are."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name != "documents":
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, "doc_id") if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


# --- turns of conversations -------------------------------------------------------------

def turns(spark: SparkSession, sf: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("conv_id") * 1021 + F.col("turn") * 3).cast("int"))
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("agent_"), (F.col("conv_id") % 5).cast("string")).alias("agent_id"),
        F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        "role", (start + minutes).alias("ts"), F.col("text").alias("content"))


def day_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with logical day, clock text and number within the day."""
    return order_turns(with_days(turns(spark, sf)))


def days(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Transcript days with a day number that drives the flags of the lifecycle views; `of` day turns that are stored already."""
    return ((with_days(turns(spark, sf)) if of is None else of).groupBy("agent_id", "memory_date").agg(
        F.count(F.lit(1)).alias("total_turns"), F.count_if(F.col("role") == "user").alias("user_turns"))
        .withColumn("d", F.datediff("memory_date", F.lit("2023-12-01").cast("date")).cast("bigint")))


def _status(archived: Column, trimmed: Column) -> Column:
    no_time = F.lit(None).cast("timestamp")
    flags = {"initialized": F.lit(True), "filled": F.lit(True), "archived": archived, "trimmed": trimmed,
             "restored": F.lit(False)}
    return F.struct(*[part for name, value in flags.items() for part in (value.alias(name), no_time.alias(f"{name}_at"))])


def l2_days(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    return days(spark, sf, of).select("agent_id", "memory_date", _status(F.col("d") % 3 != 0, F.col("d") % 7 == 0).alias("status"))


def l1_days(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Summaries of all days but thin ones. Every turn of the day is dealt, by its number, to one of the five lists."""
    per_day = (day_turns(spark, sf) if of is None else of).groupBy("agent_id", "memory_date").agg(
        F.count(F.lit(1)).alias("total_turns"), F.count_if(F.col("role") == "user").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.array_sort(F.collect_list(F.struct("message_id", "turn_index", "content"))).alias("said"))
    d = F.datediff("memory_date", F.lit("2023-12-01").cast("date"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("milestone", "bug_fix", "incident", "question")]), (d % 4 + 1).cast("int"))

    def dealt(turn: int, value=lambda x: x["content"]) -> Column:
        return F.transform(F.filter("said", lambda x: x["message_id"] % 5 == turn), value)

    return per_day.filter("user_turns > 1").select(
        "agent_id", "memory_date", "total_turns", "user_turns", "assistant_turns",
        F.lit(0).cast("bigint").alias("tools_called_count"), F.lit("normal").alias("memory_signal"),
        F.col("said")[0]["content"].alias("summary"), F.array("agent_id", kind).alias("tags"), kind.alias("day_mood"),
        dealt(0, lambda x: F.struct(kind.alias("name"), x["content"].alias("detail"))).alias("topics"),
        dealt(1).alias("decisions"), dealt(2).alias("todos"),
        dealt(3, lambda x: F.struct(kind.alias("type"), x["content"].alias("desc"))).alias("key_items"),
        dealt(4, lambda x: F.struct(x["turn_index"].alias("turn"), kind.alias("emotion"), (d % 5 + 1).cast("int").alias("intensity"),
                                    x["content"].alias("context"))).alias("emotional_peaks"),
        F.array(F.lit(0).cast("bigint"), F.col("user_turns")).alias("compress_hints"),
        _status(d % 3 != 0, F.lit(False)).alias("status"))


def day_markers(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """A marker for every thin day; some are marked as without conversation, which leaves them without a summary or thin-day mark."""
    marker = F.when(F.col("d") % 2 == 0, "nocontent").otherwise("noconversation")
    return days(spark, sf, of).filter("user_turns <= 1").select("agent_id", "memory_date", marker.alias("marker"))


def l0_index(spark: SparkSession, sf: str, l1: DataFrame | None = None) -> DataFrame:
    """Surface index rows of all summarised days."""
    return (l1_days(spark, sf) if l1 is None else l1).select(
        "agent_id", F.lit("surface").alias("depth"), F.col("memory_date").cast("string").alias("time_key"), "summary",
        "tags", F.col("day_mood").alias("mood"), F.lit(None).cast("string").alias("window_date_start"),
        F.col("total_turns").alias("access_count"))


# --- items of events ------------------------------------------------------------------------

def day_items(spark: SparkSession, sf: str) -> DataFrame:
    kind = (F.when(F.col("event_id") % 7 == 0, "bug_fix").when(F.col("event_type") == "signup", "milestone")
             .when(F.col("event_type") == "error", "incident").when(F.col("event_type") == "purchase", "decision")
             .when(F.col("event_type") == "click", "config_change").otherwise("question"))
    return table(spark, sf, "events").select(
        F.concat(F.lit("agent_"), F.col("user_id").cast("string")).alias("agent_id"),
        timeaxis.logical_day(F.col("ts")).alias("memory_date"), kind.alias("item_type"),
        (1 + F.floor("value").cast("int") % 5).alias("intensity"))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(
        F.concat(F.lit("agent_"), (F.col("user_id") % 5).cast("string")).alias("agent_id"),
        F.to_date("ts").alias("memory_date"), F.col("user_id").cast("string").alias("session_id")).agg(
        F.min(F.col("ts").cast("timestamp")).alias("first_seen"))


# --- long days and memories of documents ---------------------------------------------------------

def long_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("agent_id"), F.lit("2024-01-01").cast("date").alias("memory_date"), "doc_id",
        F.when(F.col("doc_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("text").alias("content"),
        F.lit("").alias("hhmm"), F.length("text").cast("bigint").alias("length"))
    return ordinal(rows, ["agent_id", "memory_date"], [id_bucket("doc_id")], [F.col("doc_id")])


def memories(spark: SparkSession, sf: str) -> DataFrame:
    """Index rows of three depths, one per document and key, with the whole text.

    An agent's n-th document has the n-th day, week or start of a window back
    from a fixed date, so that no two share a key.
    """
    numbered = ordinal(table(spark, sf, "documents").select(F.col("source").alias("agent_id"), "doc_id", "text", "lang"),
                       ["agent_id"], [id_bucket("doc_id")], [F.col("doc_id")], name="ord").withColumn("ord", F.col("ord") + 1)
    o = F.col("ord")
    depth = F.when(o % 25 == 0, "deep").when(o % 10 == 0, "shallow").otherwise("surface")
    back = lambda day, n: F.date_sub(F.lit(day).cast("date"), n.cast("int"))
    key = (F.when(o % 25 == 0, F.concat(back("2023-12-02", o).cast("string"), F.lit("+28d")))
            .when(o % 10 == 0, timeaxis.week_id(back("2023-12-25", F.floor(o / 10) * 7)))
            .otherwise(back("2024-12-28", o).cast("string")))
    return numbered.select("agent_id", "doc_id", o.alias("ord_key"), depth.alias("depth"), key.alias("time_key"), "text", "lang")


def memory_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("agent_id"),
        F.col("text").alias("query"))


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"),
                                                 F.col("embedding").cast("array<double>").alias("embedding"))


def memory_vectors(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Vectors of index rows (`memories`, or those given)."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"),
                                                    F.col("embedding").cast("array<double>").alias("embedding"))
    return (memories(spark, sf) if rows is None else rows).join(vectors, "doc_id").select("agent_id", "depth", "time_key", "embedding")


def _pieces(text: Column) -> Column:
    """The whole text in consecutive pieces."""
    count = F.ceil(F.length(text) / PIECE).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substr(
        text, k * PIECE + 1, F.lit(PIECE)))).otherwise(F.array().cast("array<string>"))


def memory_documents(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """One document per index key; the pieces of its text are dealt to the field families in turn."""
    cut = (memories(spark, sf) if rows is None else rows).select("agent_id", "depth", "time_key", "lang", _pieces(F.col("text")).alias("p"))

    def dealt(turn: int) -> Column:
        return F.filter("p", lambda x, i: (i > 0) & (i % 5 == turn))

    return cut.select(
        "agent_id", "depth", "time_key", F.coalesce(F.try_element_at("p", F.lit(1)), F.lit("")).alias("summary"),
        F.col("lang").alias("mood"),
        F.transform(dealt(1), lambda x: F.struct(F.lit("").alias("name"), x.alias("detail"))).alias("topics"),
        dealt(2).alias("decisions"), dealt(3).alias("todos"),
        F.transform(dealt(4), lambda x: F.struct(F.lit("question").alias("type"), x.alias("desc"))).alias("key_items"),
        F.transform(dealt(0), lambda x: F.struct(F.lit("calm").alias("emotion"), x.alias("context"))).alias("emotional_peaks"))


def memory_turns(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Transcript turns of surface days: the pieces of the day's documents."""
    return (memories(spark, sf) if rows is None else rows).filter("depth = 'surface'").select(
        "agent_id", "time_key", "ord_key", F.posexplode(_pieces(F.col("text"))).alias("k", "content")).select(
        "agent_id", "time_key", (F.col("ord_key") * 100000 + F.col("k")).alias("turn_index"),
        F.when(F.col("k") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lpad((F.col("k") % 24).cast("string"), 2, "0"), F.lit(":00")).alias("hhmm"), "content")


# --- the same views as SQL ----------------------------------------------------------------------

_LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London')"
_DAY = f"CAST({_LOCAL} - INTERVAL 3 HOUR AS DATE)"
_PIECES = (f"list_transform(range(0, CAST(ceil(length(text) / {PIECE}.0) AS BIGINT)), "
           f"lambda k: substring(text, k * {PIECE} + 1, {PIECE}))")
# Fixed value: the characters that end a match token (`text.SEPARATORS` and white space), as a class of the SQL engine.
_ENDS = r"[\n\t,，.。!！?？:：;；()（）\[\]【】/\\|\"''\-_\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def four_digits(value: Column) -> Column:
    """Rounded by plain arithmetic, which both engines do alike where their `round` differs."""
    return F.floor(value * 10000 + 0.5) / 10000


def sql_tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{_ENDS}'), lambda t: t <> '')"


def sql_strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[\\s\\x{{a0}}\\x{{3000}}]+', ''), '[\\s\\x{{a0}}\\x{{3000}}]+$', '')"


def sql_lexical(terms: str, tokens: str) -> str:
    return (f"coalesce(list_sum(list_transform({terms}, lambda t: CASE WHEN list_contains({tokens}, t) THEN 1.0 "
            f"WHEN len(list_filter({tokens}, lambda x: contains(x, t) OR contains(t, x))) > 0 THEN 0.5 ELSE 0.0 END)), 0.0)::DOUBLE")


def sql_calibrated(value: str, key: str, order: str) -> str:
    """Calibrated score of `value` within `key`, ties by `order`."""
    w = f"PARTITION BY {key}"
    lo, hi, n = f"min({value}) OVER ({w})", f"max({value}) OVER ({w})", f"count(*) OVER ({w})"
    mid = f"coalesce(avg(CASE WHEN {value} > 0 THEN {value} END) OVER ({w}), 0)"
    pos = f"(row_number() OVER ({w} ORDER BY {value} DESC, {order}) - 1)"
    return (f"(0.4 * CASE WHEN abs({hi} - {lo}) <= greatest(abs({hi}), abs({lo})) * 1e-9 THEN CASE WHEN {hi} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
            f"ELSE ({value} - {lo}) / ({hi} - {lo}) END "
            f"+ 0.4 * CASE WHEN {n} = 1 THEN CASE WHEN {value} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 1 - {pos}::DOUBLE / ({n} - 1) END "
            f"+ 0.2 * CASE WHEN {value} > 0 THEN 1 / (1 + exp(-({value} - {mid}) / greatest({mid}, 1e-6))) ELSE 0.0::DOUBLE END)")


def sql_latest(texts: str, limit: int) -> str:
    """Per agent and week the latest distinct texts `s` (in order of `at_`) that fit into `limit` characters together.

    Of a longer last one its whole sentences. `cut` is 1 if something was left out.
    """
    return f"""
SELECT agent_id, week, coalesce(CASE WHEN max(n) FILTER (back = 1) <= {limit} THEN string_agg(s, '；' ORDER BY back DESC) FILTER (used <= {limit})
    ELSE coalesce(nullif(regexp_extract(left(max(s) FILTER (back = 1), {limit}), '(?s)^(.*[.!?。！？；])', 1), ''), left(max(s) FILTER (back = 1), {limit})) END, '') AS text,
  CASE WHEN max(used) > {limit} THEN 1 ELSE 0 END AS cut
FROM (SELECT *, sum(n + CASE WHEN back = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY agent_id, week ORDER BY back) AS used FROM (
  SELECT agent_id, week, s, length(s) AS n, row_number() OVER (PARTITION BY agent_id, week ORDER BY seen DESC) AS back FROM (
    SELECT agent_id, week, s, min(at_) AS seen FROM ({texts}) WHERE s <> '' GROUP BY ALL)))
GROUP BY agent_id, week"""


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_turns": ((), """
SELECT concat('agent_', conv_id % 5) AS agent_id, conv_id AS session_id, conv_id * 1000 + turn AS message_id, role,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 1021 + turn * 3 AS INT)) AS ts, text AS content
FROM conversations"""),
    "fx_day_turns": (("fx_turns",), f"""
SELECT *, row_number() OVER (PARTITION BY agent_id, memory_date ORDER BY ts, session_id, message_id) - 1 AS turn_index
FROM (SELECT *, {_DAY} AS memory_date, strftime({_LOCAL}, '%H:%M') AS hhmm FROM fx_turns)"""),
    "fx_days": (("fx_day_turns",), """
SELECT agent_id, memory_date, count(*) AS total_turns, count(*) FILTER (role = 'user') AS user_turns,
       count(*) FILTER (role = 'assistant') AS assistant_turns,
       arg_min(content, message_id) AS first_text, arg_max(content, message_id) AS last_text,
       date_diff('day', DATE '2023-12-01', memory_date) AS d
FROM fx_day_turns GROUP BY agent_id, memory_date"""),
    "fx_l2": (("fx_days",), "SELECT agent_id, memory_date, d % 3 <> 0 AS archived, d % 7 = 0 AS trimmed FROM fx_days"),
    "fx_l1": (("fx_days", "fx_day_turns"), """
SELECT d.*, ['milestone', 'bug_fix', 'incident', 'question'][d % 4 + 1] AS kind, d % 5 + 1 AS intensity, d % 3 <> 0 AS archived,
       coalesce(topics, []) AS topics, coalesce(decisions, []) AS decisions, coalesce(todos, []) AS todos,
       coalesce(items, []) AS items, coalesce(peaks, []) AS peaks
FROM fx_days d LEFT JOIN (
  SELECT agent_id, memory_date, list(content ORDER BY message_id) FILTER (message_id % 5 = 0) AS topics,
         list(content ORDER BY message_id) FILTER (message_id % 5 = 1) AS decisions,
         list(content ORDER BY message_id) FILTER (message_id % 5 = 2) AS todos,
         list(content ORDER BY message_id) FILTER (message_id % 5 = 3) AS items,
         list({'turn': turn_index, 'text': content} ORDER BY message_id) FILTER (message_id % 5 = 4) AS peaks
  FROM fx_day_turns GROUP BY ALL) USING (agent_id, memory_date) WHERE user_turns > 1"""),
    "fx_markers": (("fx_days",), """
SELECT agent_id, memory_date, CASE WHEN d % 2 = 0 THEN 'nocontent' ELSE 'noconversation' END AS marker FROM fx_days WHERE user_turns <= 1"""),
    "fx_l0": (("fx_l1",), """
SELECT agent_id, 'surface' AS depth, CAST(memory_date AS VARCHAR) AS time_key, first_text AS summary, kind AS mood,
       total_turns AS access_count, memory_date, d FROM fx_l1"""),
    # All entries of the lists of a week's summaries, in order (`o`), and what a rollup of the week keeps of them.
    "fx_week_items": (("fx_l1",), f"""
SELECT agent_id, week, field, d * 100000 + p AS o, v FROM (
  SELECT agent_id, strftime(memory_date, '%G-W%V') AS week, d, field, unnest(vs) AS v, generate_subscripts(vs, 1) AS p FROM (
    SELECT agent_id, memory_date, d, 'tags' AS field, [agent_id, kind] AS vs FROM fx_l1
    UNION ALL SELECT agent_id, memory_date, d, 'topics', list_transform(topics, lambda x: kind || ': ' || x) FROM fx_l1
    UNION ALL SELECT agent_id, memory_date, d, 'decisions', list_filter(list_transform(decisions, lambda x: {sql_strip('x')}), lambda x: x <> '') FROM fx_l1
    UNION ALL SELECT agent_id, memory_date, d, 'todos', list_filter(list_transform(todos, lambda x: {sql_strip('x')}), lambda x: x <> '') FROM fx_l1
    UNION ALL SELECT agent_id, memory_date, d, 'key_items', list_transform(items, lambda x: kind || ': ' || x) FROM fx_l1
    UNION ALL SELECT agent_id, memory_date, d, 'emotional_peaks',
              list_transform(peaks, lambda x: memory_date || ' ' || kind || ' ' || intensity || ' ' || x.text) FROM fx_l1))"""),
    "fx_limits": ((), "SELECT * FROM (VALUES ('tags', 12), ('topics', 20), ('decisions', 20), ('todos', 15), ('key_items', 20), ('emotional_peaks', 15)) t(field, most)"),
    "fx_week_kept": (("fx_week_items", "fx_limits"), """
SELECT agent_id, week, field, v, o, n, back, most FROM (
  SELECT *, row_number() OVER (PARTITION BY agent_id, week, field ORDER BY o DESC) AS back, count(*) OVER (PARTITION BY agent_id, week, field) AS n
  FROM (SELECT agent_id, week, field, v, max(o) AS o FROM fx_week_items GROUP BY ALL)) JOIN fx_limits USING (field) WHERE back <= most"""),
    "fx_week_texts": (("fx_l1",), f"""
SELECT s.agent_id, s.week, s.text AS summary, m.text AS mood, s.cut + m.cut AS cut
FROM ({sql_latest("SELECT agent_id, strftime(memory_date, '%G-W%V') AS week, first_text AS s, d AS at_ FROM fx_l1", 200)}) s
JOIN ({sql_latest("SELECT agent_id, strftime(memory_date, '%G-W%V') AS week, kind AS s, d AS at_ FROM fx_l1", 40)}) m USING (agent_id, week)"""),
    "fx_day_items": ((), f"""
SELECT concat('agent_', user_id) AS agent_id, {_DAY} AS memory_date,
       CASE WHEN event_id % 7 = 0 THEN 'bug_fix' WHEN event_type = 'signup' THEN 'milestone' WHEN event_type = 'error' THEN 'incident'
            WHEN event_type = 'purchase' THEN 'decision' WHEN event_type = 'click' THEN 'config_change' ELSE 'question' END AS item_type,
       1 + CAST(floor(value) AS INT) % 5 AS intensity
FROM events"""),
    "fx_registry": ((), """
SELECT concat('agent_', user_id % 5) AS agent_id, CAST(ts AS DATE) AS memory_date, CAST(user_id AS VARCHAR) AS session_id,
       min(ts) AS first_seen
FROM events GROUP BY ALL"""),
    "fx_long_turns": ((), """
SELECT source AS agent_id, DATE '2024-01-01' AS memory_date, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS turn_index,
       CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, text AS content, length(text) AS length
FROM documents"""),
    "fx_memories": ((), """
SELECT agent_id, doc_id, ord AS ord_key, text, lang,
       CASE WHEN ord % 25 = 0 THEN 'deep' WHEN ord % 10 = 0 THEN 'shallow' ELSE 'surface' END AS depth,
       CASE WHEN ord % 25 = 0 THEN CAST(DATE '2023-12-02' - CAST(ord AS INT) AS VARCHAR) || '+28d'
            WHEN ord % 10 = 0 THEN strftime(DATE '2023-12-25' - CAST(ord // 10 * 7 AS INT), '%G-W%V')
            ELSE CAST(DATE '2024-12-28' - CAST(ord AS INT) AS VARCHAR) END AS time_key
FROM (SELECT source AS agent_id, doc_id, text, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord FROM documents)"""),
    "fx_queries": ((), "SELECT item_id AS query_id, concat('src', item_id % 20) AS agent_id, text AS query FROM benchmark"),
    "fx_terms": (("fx_queries",), f"SELECT query_id, agent_id, {sql_tokens('query')} AS terms FROM fx_queries"),
    "fx_vectors": (("fx_memories",), """
SELECT agent_id, depth, time_key, embedding::DOUBLE[] AS embedding FROM fx_memories JOIN embeddings ON vec_id = doc_id"""),
    "fx_pairs": (("fx_terms", "fx_memories"), f"""
SELECT query_id, agent_id, depth, time_key, ord_key, {sql_lexical('terms', 'tokens')} AS lexical_raw
FROM fx_terms JOIN (SELECT *, list_distinct({sql_tokens('text')}) AS tokens FROM fx_memories) m USING (agent_id)"""),
    "fx_scored": (("fx_pairs", "fx_vectors"), """
SELECT p.*, greatest(0.0, coalesce(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding), 0.0)) AS embedding_raw,
       q.vec_id IS NOT NULL AND p.agent_id IN (SELECT agent_id FROM fx_vectors) AS hybrid
FROM fx_pairs p LEFT JOIN embeddings q ON q.vec_id = p.query_id LEFT JOIN fx_vectors v USING (agent_id, depth, time_key)"""),
    "fx_calibrated": (("fx_scored",), f"""
SELECT *, {sql_calibrated('lexical_raw', 'query_id', 'ord_key')} AS lexical_score,
       {sql_calibrated('embedding_raw', 'query_id', 'ord_key')} AS embedding_score FROM fx_scored"""),
    "fx_fused": (("fx_calibrated",), """
SELECT *, CASE WHEN NOT hybrid THEN lexical_score
               WHEN l >= 0.7 AND e >= 0.7 THEN 0.5 * l + 0.5 * e WHEN l >= 0.7 AND e < 0.4 THEN 0.65 * l + 0.35 * e
               WHEN l < 0.4 AND e >= 0.7 THEN 0.35 * l + 0.65 * e ELSE 0.45 * l + 0.55 * e END AS score
FROM (SELECT *, greatest(0, least(1, lexical_score)) AS l, CASE WHEN hybrid THEN greatest(0, least(1, embedding_score)) ELSE 0 END AS e
      FROM fx_calibrated)"""),
    "fx_anchors": (("fx_fused",), """
SELECT query_id, agent_id, depth, time_key, round(score, 6) AS score, anchor_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lexical_score DESC, e DESC, depth, time_key) AS anchor_rank
  FROM (SELECT * FROM fx_fused WHERE score > 0 QUALIFY row_number() OVER (
          PARTITION BY query_id, depth, time_key ORDER BY score DESC, lexical_score DESC, e DESC) = 1))
WHERE anchor_rank <= 12"""),
    "fx_cut": (("fx_memories",), f"""
SELECT agent_id, depth, time_key, lang, {_PIECES} AS p FROM fx_memories"""),
    "fx_items": (("fx_cut",), f"""
SELECT * FROM (
  SELECT agent_id, depth, time_key, field, field_no, pos, {sql_strip('information')} AS information FROM (
    SELECT agent_id, depth, time_key, 'summary' AS field, 0 AS field_no, 0 AS pos, p[1] AS information FROM fx_cut
    UNION ALL SELECT agent_id, depth, time_key,
                     CASE depth WHEN 'surface' THEN 'day_mood' WHEN 'shallow' THEN 'week_mood' ELSE 'window_mood' END, 1, 0, lang
              FROM fx_cut
    UNION ALL SELECT agent_id, depth, time_key,
                     ['emotional_peak_context', 'topic_detail', 'decision', 'todo', 'key_item'][(i - 1) % 5 + 1],
                     [6, 2, 3, 4, 5][(i - 1) % 5 + 1], i, p[i]
              FROM (SELECT *, unnest(range(2, len(p) + 1)) AS i FROM fx_cut))) WHERE information <> ''"""),
    "fx_l1_ranked": (("fx_anchors", "fx_items", "fx_terms"), f"""
WITH raw AS (SELECT * FROM (
  SELECT query_id, a.agent_id, depth, time_key, anchor_rank, field, field_no, pos, information,
         {sql_lexical('terms', f"list_distinct({sql_tokens('information')})")} AS raw_score
  FROM fx_anchors a JOIN fx_items USING (agent_id, depth, time_key) JOIN fx_terms t USING (query_id)) WHERE raw_score > 0)
SELECT query_id, agent_id, depth, time_key, field, information, round(score, 6) AS score, layer_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_score DESC, depth, time_key, field, information) AS layer_rank
  FROM (SELECT * FROM (SELECT *, {sql_calibrated('raw_score', 'query_id', 'anchor_rank, field_no, pos')} AS score FROM raw)
        WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, depth, time_key, field, information ORDER BY score DESC) = 1))
WHERE layer_rank <= 24"""),
    "fx_memory_turns": (("fx_memories",), f"""
SELECT agent_id, time_key, ord_key * 100000 + i - 1 AS turn_index, CASE WHEN (i - 1) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
       lpad(CAST((i - 1) % 24 AS VARCHAR), 2, '0') || ':00' AS hhmm, {sql_strip('p[i]')} AS information
FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT agent_id, time_key, ord_key, {_PIECES} AS p FROM fx_memories WHERE depth = 'surface'))"""),
    "fx_l2_ranked": (("fx_anchors", "fx_memory_turns", "fx_terms"), f"""
WITH raw AS (SELECT * FROM (
  SELECT query_id, a.agent_id, depth, time_key, anchor_rank, turn_index, role, hhmm, information,
         {sql_lexical('terms', f"list_distinct({sql_tokens('information')})")} AS raw_score
  FROM fx_anchors a JOIN fx_memory_turns USING (agent_id, time_key) JOIN fx_terms t USING (query_id)
  WHERE depth = 'surface' AND information <> '') WHERE raw_score > 0)
SELECT query_id, agent_id, depth, time_key, role, hhmm, information, round(score, 6) AS score, layer_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_score DESC, time_key, hhmm, role, information) AS layer_rank
  FROM (SELECT * FROM (SELECT *, {sql_calibrated('raw_score', 'query_id', 'anchor_rank, turn_index')} AS score FROM raw)
        WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, time_key, role, hhmm, information ORDER BY score DESC) = 1))
WHERE layer_rank <= 24"""),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix SQL with the views it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql
    clauses = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name][1].strip()})" for name in ordered)
    recursive = "RECURSIVE " if "UNION ALL\n" in sql and "FROM steps" in sql else ""
    return f"WITH {recursive}{clauses}\n{sql.strip()}"
