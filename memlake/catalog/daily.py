"""The daily write over targets, with failing inference, reruns and late turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.catalog import fixtures as fx, lifecycle
from memlake.catalog.registry import query
from memlake.catalog.summaries import _DAY_TAGS
from memlake.catalog.weekly import _folder
from memlake.operators import landmarks
from memlake.plans import daily, late_turns, weekly, write
from memlake.sources.snapshots import Store

DAY = ["agent_id", "memory_date"]


def _number():
    return F.datediff("memory_date", F.lit("2023-12-01").cast("date"))


def _all_days(store: Store) -> tuple:
    """First and last day with a transcript."""
    return tuple(store.read("l2_days").agg(F.min("memory_date"), F.max("memory_date")).first())


def _store(spark, sf) -> Store:
    """Lifecycle tables before a run that is still to write the index row of every second day."""
    tables = lifecycle.store(spark, sf)
    index = lifecycle.stored_index(spark, sf)
    vectors = write.hashed_embedding(8)(write.with_embed_text(index)).select(tables["l0_embeddings"].columns)
    store = Store(spark, _folder(spark, "store"))
    weekly.create_store(store, {**tables, "l0_index": index, "l0_embeddings": vectors, "agents": fx.days(spark, sf).select("agent_id").distinct(),
                                "landmark_counts": landmarks.count_documents(tables["l1_days"])})
    return store


def failing() -> daily.Inference:
    """Chunks of days with d % 4 = 1 fail once, those with d % 4 = 2 always; the merge of days with d % 8 = 3 always."""
    sound, calls = daily.built_in(), []

    def chunks(fragments):
        calls.append(1)
        bad = (_number() % 4 == 2) | (F.lit(len(calls) == 1) & (_number() % 4 == 1))
        return sound.chunks(fragments).withColumn("valid", ~bad)

    def days(chunked, fragments):
        bad = _number() % 8 == 3
        return sound.days(chunked, fragments).withColumns({"valid": ~bad, "problem": F.when(bad, "keys")})

    return daily.Inference(chunks, days)


def _rows(store: Store):
    tags = F.array_join("tags", ",")
    text = lambda *parts: F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    item = {"day_markers": text("memory_date", "marker"), "l0_index": F.col("time_key"), "l0_embeddings": F.col("time_key")}
    content = {"ledger": text("status", "attempts", "run_name", F.coalesce("problem", F.lit("-"))), "l1_days": tags, "l0_index": tags}
    out = None
    for name in ("ledger", *daily.DAY_TABLES):
        part = store.read(name).select(F.lit(name).alias("table_name"), "agent_id", item.get(name, F.col("memory_date").cast("string") if not name.startswith("l0_") else None).alias("item"),
                                       content.get(name, F.lit("")).alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


def _expected(rerun: bool) -> str:
    """Day tables after the run; with `rerun` also the failed days are done."""
    failed = "false" if rerun else "(d % 4 = 2 OR d % 8 = 3)"
    attempts = "CASE WHEN d % 4 = 2 OR d % 8 = 3 THEN 1 WHEN d % 4 = 1 THEN 2 ELSE 1 END" if rerun else "CASE WHEN d % 4 IN (1, 2) OR d % 8 = 3 THEN 2 ELSE 1 END"
    run = "CASE WHEN d % 4 = 2 OR d % 8 = 3 THEN 'rerun' ELSE 'daily' END" if rerun else "'daily'"
    return f""", t AS (
  SELECT agent_id, memory_date, d, has_l1, target, {failed} AS failed, target AND NOT {failed} AS done, user_turns = 0 OR (tags IS NULL AND total_turns <= 8) AS low,
         coalesce(tags, '') AS tags, agent_id || ',' || kind AS stored
  FROM (SELECT *, (has_l1 AND d % 2 = 0) OR (NOT has_l1 AND d % 2 = 1) AS target FROM (
    SELECT agent_id, memory_date, d, user_turns, total_turns, user_turns > 1 AS has_l1, tags, ['milestone', 'bug_fix', 'incident', 'question'][d % 4 + 1] AS kind
    FROM fx_days LEFT JOIN ({_DAY_TAGS}) USING (agent_id, memory_date)))),
l1 AS (SELECT *, CASE WHEN done THEN tags ELSE stored END AS now FROM t WHERE CASE WHEN done THEN NOT low ELSE has_l1 END),
i AS (SELECT * FROM l1 WHERE done OR d % 2 = 1)
SELECT 'ledger' AS table_name, agent_id, CAST(memory_date AS VARCHAR) AS item, CASE WHEN failed THEN 'failed' ELSE 'done' END || '|' || {attempts} || '|' || {run} || '|'
  || CASE WHEN failed AND d % 4 = 2 THEN '1 of 1 chunks failed' WHEN failed THEN 'keys' ELSE '-' END AS content FROM t WHERE target
UNION ALL SELECT 'l1_days', agent_id, CAST(memory_date AS VARCHAR), now FROM l1
UNION ALL SELECT 'landmark_counts', agent_id, CAST(memory_date AS VARCHAR), '' FROM t WHERE has_l1 OR (done AND NOT low)
UNION ALL SELECT 'day_markers', agent_id, memory_date || '|' || marker, '' FROM fx_markers
UNION ALL SELECT 'day_markers', agent_id, memory_date || '|nocontent', '' FROM t WHERE done AND low
UNION ALL SELECT 'l0_index', agent_id, CAST(memory_date AS VARCHAR), now FROM i
UNION ALL SELECT 'l0_embeddings', agent_id, CAST(memory_date AS VARCHAR), '' FROM i"""


@query("backfill_days", _expected(False), ("fx_days", "fx_markers"))
def backfill_days(spark, sf):
    """All incomplete days are written, with one retry and inference that fails for some; a second call finds only days that failed."""
    store = _store(spark, sf)
    first, last = _all_days(store)
    for _ in range(2):
        daily.backfill_days(store, first, last, inference=failing())
    return _rows(store)


@query("rerun_failures", _expected(True), ("fx_days", "fx_markers"))
def rerun_failures(spark, sf):
    """The same run, then its failed days again with inference that works."""
    store = _store(spark, sf)
    daily.backfill_days(store, *_all_days(store), inference=failing())
    daily.rerun_failures(store)
    return _rows(store)


@query("retry_failed", """
SELECT doc_id, doc_id % 3 <> 2 AS valid, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS attempt, length(text) AS length FROM documents""")
def retry_failed(spark, sf):
    """Every document as a chunk; a third fails once, another third always."""
    rows = fx.table(spark, sf, "documents").select(F.col("source").alias("agent_id"), F.lit("2024-01-01").cast("date").alias("memory_date"),
                                                   F.col("doc_id").alias("chunk_id"), "text")
    calls = []

    def run(chunks):
        calls.append(1)
        valid = (F.col("chunk_id") % 3 == 0) | (F.lit(len(calls) > 1) & (F.col("chunk_id") % 3 == 1))
        return chunks.select("agent_id", "memory_date", "chunk_id", valid.alias("valid"), F.lit(len(calls)).alias("attempt"),
                             F.length("text").cast("bigint").alias("length"))

    return write.retry_failed(rows, run).select(F.col("chunk_id").alias("doc_id"), "valid", "attempt", "length")


# --- late turns ------------------------------------------------------------------------------------

@query("late_turns", f"""
SELECT 'turns' AS table_name, agent_id, memory_date || '|' || turn_index AS item, content
FROM fx_day_turns
UNION ALL SELECT 'l1_days', agent_id, CAST(memory_date AS VARCHAR), total_turns || '|' || user_turns || '|' || tags FROM fx_days JOIN ({_DAY_TAGS}) USING (agent_id, memory_date) WHERE user_turns > 0
UNION ALL SELECT 'l0_index', agent_id, CAST(memory_date AS VARCHAR), tags FROM fx_days JOIN ({_DAY_TAGS}) USING (agent_id, memory_date) WHERE user_turns > 0""", ("fx_days",))
def late(spark, sf):
    """Days are written without every third turn; then those arrive, with some that are known. All is as if written at once."""
    turns = fx.day_turns(spark, sf).withColumn("message_type", F.lit("text"))
    arrived = late_turns.order_turns(turns.where("message_id % 3 != 2")).drop("message_id")
    missing = turns.where("message_id % 3 = 2 or message_id % 3 = 1").withColumn("turn_index", F.lit(-1).cast("bigint"))
    store = written_store(spark, arrived)
    late_turns.fold_late_turns(store, missing.select(arrived.columns), daily.built_in())
    daily.write_targets(store, store.read("l2_days").select(*DAY))
    return _late_rows(store)


def written_store(spark, turns) -> Store:
    """A store with these turns, all days written."""
    days = turns.select(*DAY).distinct()
    tables = {"turns": turns, "l2_days": days.withColumn("status", late_turns.initial_status()), "agents": days.select("agent_id").distinct(),
              "day_markers": days.limit(0).withColumn("marker", F.lit("")), "l1_days": write.l1_skeleton(days.limit(0))}
    tables["landmark_counts"] = landmarks.count_documents(tables["l1_days"])
    tables["l0_index"] = write.index_rows(tables["l1_days"])
    tables["l0_embeddings"] = write.hashed_embedding(8)(write.with_embed_text(tables["l0_index"])).select("agent_id", "depth", "time_key", "text_used", "embedding")
    store = Store(spark, _folder(spark, "store"))
    weekly.create_store(store, tables)
    daily.write_targets(store, days)
    return store


def _late_rows(store: Store):
    date_, tags = F.col("memory_date").cast("string"), F.array_join("tags", ",")
    turns = store.read("turns").select(F.lit("turns").alias("table_name"), "agent_id", F.concat_ws("|", date_, F.col("turn_index").cast("string")).alias("item"),
                                       "content")
    l1 = store.read("l1_days").select(F.lit("l1_days").alias("table_name"), "agent_id", date_.alias("item"), F.concat_ws(
        "|", F.col("total_turns").cast("string"), F.col("user_turns").cast("string"), tags).alias("content"))
    index = store.read("l0_index").select(F.lit("l0_index").alias("table_name"), "agent_id", F.col("time_key").alias("item"), tags.alias("content"))
    return turns.unionByName(l1).unionByName(index)
