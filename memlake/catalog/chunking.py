"""Token budgets and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.catalog import fixtures as fx
from memlake.catalog.registry import query
from memlake.functions.text import estimate_tokens
from memlake.operators import chunking as ck
from memlake.settings import Settings

# Small budgets, so that the test documents are cut into many chunks.
SMALL = Settings(context_total=12_000, context_free=4_000, map_prompt=1_000, reduce_prompt=1_000, system_prompt=1_000,
                 reduce_output=1_000, chunk_max_turns=20)

def _date():
    return F.col("memory_date").cast("string").alias("memory_date")



def _sized(spark, sf):
    return fx.long_turns(spark, sf).withColumn("tokens", estimate_tokens(F.col("length"), 2))


def _plan_sql(a: int, r: int, most: int) -> str:
    """Chunk counts found by trying n = least, least + 1, ... as far as needed."""
    return f"""
SELECT agent_id, total_tokens, longest, turns, chunk_count, map_output_budget, {a} - map_output_budget AS chunk_budget,
       CAST(greatest(1, least({most}, ceil(turns / chunk_count))) AS BIGINT) AS turn_budget
FROM (SELECT *, {r} // chunk_count AS map_output_budget FROM (
  SELECT agent_id, total_tokens, longest, turns, min(n) AS chunk_count FROM (
    SELECT *, unnest(range(least_count, greatest(least_count, turns) + 1)) AS n FROM (
      SELECT *, CAST(CASE WHEN total_tokens > 0 THEN greatest(1, ceil((total_tokens + {r}) / {a})) ELSE 1 END AS BIGINT) AS least_count FROM (
        SELECT agent_id, CAST(sum(tokens) AS BIGINT) AS total_tokens, max(tokens) AS longest, count(*) AS turns FROM (
          SELECT agent_id, CASE WHEN length = 0 THEN 0 ELSE greatest(1, length // 2) END AS tokens FROM fx_long_turns) GROUP BY agent_id)))
  WHERE longest <= {a} - {r} // n OR n >= turns GROUP BY ALL))"""


@query("token_budget_plan", _plan_sql(105_000, 95_000, 200), ("fx_long_turns",))
def token_budget_plan(spark, sf):
    return _plan(ck.token_budget_plan(_sized(spark, sf)))


@query("token_budget_plan_small", _plan_sql(SMALL.map_budget, SMALL.reduce_budget, SMALL.chunk_max_turns), ("fx_long_turns",))
def token_budget_plan_small(spark, sf):
    return _plan(ck.token_budget_plan(_sized(spark, sf), SMALL))


def _plan(plan):
    return plan.select("agent_id", "total_tokens", "longest", "turns", "chunk_count",
                       F.col("map_output_budget").cast("bigint").alias("map_output_budget"),
                       F.col("chunk_budget").cast("bigint").alias("chunk_budget"), "turn_budget")


@query("split_point", """
SELECT agent_id, split_at, split_tokens FROM (
  SELECT agent_id, turn_index AS split_at, before AS split_tokens, row_number() OVER (PARTITION BY agent_id ORDER BY NOT fresh, uneven, turn_index) AS pick
  FROM (SELECT *, abs(before - total / 2) / greatest(1, total) + abs(turn_index - n / 2) / greatest(1, n) + CASE WHEN fresh THEN 0 ELSE 0.25::DOUBLE END AS uneven
        FROM (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY agent_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
                     sum(tokens) OVER (PARTITION BY agent_id)::DOUBLE AS total, count(*) OVER (PARTITION BY agent_id)::DOUBLE AS n,
                     role = 'user' AND lag(role) OVER (PARTITION BY agent_id ORDER BY turn_index) = 'assistant' AS fresh
              FROM (SELECT *, CASE WHEN length = 0 THEN 0 ELSE greatest(1, length // 2) END AS tokens FROM fx_long_turns)))
  WHERE turn_index > 0) WHERE pick = 1""", ("fx_long_turns",))
def split_point(spark, sf):
    turns = _sized(spark, sf).select("agent_id", "memory_date", "turn_index", "role", "tokens")
    whole = turns.groupBy("agent_id", "memory_date").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("turns"))
    zero = F.lit(0).cast("bigint")
    points = ck.split_points(ck.mark_cuts(turns).withColumn("first", zero),
                             whole.withColumn("first", zero).withColumn("start_tokens", zero))
    return points.select("agent_id", "split_at", F.col("split_tokens").cast("bigint").alias("split_tokens"))


@query("plan_chunks")
def plan_chunks(spark, sf):
    """Chunks of every source's documents; compared with a brute-force model in the tests."""
    return ck.chunk_bounds(fx.long_turns(spark, sf), SMALL).withColumn("memory_date", _date())


# The pieces of a day must give its text back, whole and in order.
@query("chunk_fragments", """
SELECT agent_id, CAST(count(*) AS BIGINT) AS turns, CAST(sum(length) AS BIGINT) AS characters, 0::BIGINT AS over_budget, true AS rejoined
FROM fx_long_turns GROUP BY agent_id""", ("fx_long_turns",))
def chunk_fragments(spark, sf):
    turns = fx.long_turns(spark, sf)
    bounds = ck.chunk_bounds(turns, SMALL)
    day = ["agent_id", "memory_date"]
    # Pieces of one turn are few: a turn is halved until it fits one chunk.
    per_turn = ck.chunk_fragments(turns, bounds, SMALL).groupBy(*day, "turn_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from_char", "text"))), lambda p: p["text"]), "").alias("again"))
    checked = per_turn.join(turns, [*day, "turn_index"]).groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length("again")).alias("characters"),
        F.bool_and(F.col("again") == F.col("content")).alias("rejoined"))
    budgets = ck.token_budget_plan(turns.withColumn("tokens", estimate_tokens(F.col("length"), 2)), SMALL)
    over = bounds.join(budgets.select(*day, "chunk_budget", "turn_budget"), day).groupBy("agent_id").agg(
        F.count_if((F.col("token_estimate") > F.col("chunk_budget")) | (F.col("fragment_count") > F.col("turn_budget"))).alias("over_budget"))
    return checked.join(over, "agent_id").select("agent_id", "turns", "characters", "over_budget", "rejoined")


# Every fifth chunk has no result and every seventh an invalid one.
@query("run_outcome", """
SELECT agent_id, count(*) AS total_chunks, count(*) FILTER (NOT ok) AS failed_chunks, bool_and(ok) AS succeeded
FROM (SELECT source AS agent_id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS ok FROM documents) GROUP BY agent_id""")
def run_outcome(spark, sf):
    from memlake.plans.write import run_outcome as outcome
    plan, results = _chunk_results(spark, sf)
    return outcome(plan, results).select("agent_id", "total_chunks", "failed_chunks", "succeeded")


def _chunk_results(spark, sf):
    rows = fx.table(spark, sf, "documents").select(
        F.col("source").alias("agent_id"), F.lit("2024-01-01").cast("date").alias("memory_date"), F.col("doc_id").alias("chunk_id"))
    sizes = rows.groupBy("agent_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    results = rows.filter(F.col("chunk_id") % 5 != 0).withColumn("valid", F.col("chunk_id") % 7 != 0)
    return rows.join(sizes, "agent_id"), results


@query("failed_chunks", """
SELECT source AS agent_id, doc_id AS chunk_id, count(*) OVER (PARTITION BY source) AS total_chunks
FROM documents QUALIFY doc_id % 5 = 0 OR doc_id % 7 = 0""")
def failed_chunks(spark, sf):
    from memlake.plans.write import failed_chunks as failed
    return failed(*_chunk_results(spark, sf)).select("agent_id", "chunk_id", "total_chunks")


@query("run_verdict", """
SELECT count(*) AS agents, count(*) FILTER (NOT ok) AS failed_agents, bool_or(ok) AS success
FROM (SELECT source, bool_and(doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS ok FROM documents GROUP BY source)""")
def run_verdict(spark, sf):
    from memlake.plans.write import run_outcome as outcome, run_verdict as verdict
    return verdict(outcome(*_chunk_results(spark, sf))).select("agents", "failed_agents", "success")


@query("chunk_completeness", """
SELECT source AS agent_id, count(*) AS planned, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS valid_chunks,
       bool_and(doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS complete FROM documents GROUP BY source""")
def chunk_completeness(spark, sf):
    return ck.chunk_completeness(*_chunk_results(spark, sf)).select("agent_id", "planned", "valid_chunks", "complete")
