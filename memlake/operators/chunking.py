"""Cutting long days into token-budgeted chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memlake.functions.text import estimate_tokens
from memlake.operators.prefix import id_bucket, ordinal, running
from memlake.session import materialize
from memlake.settings import DEFAULTS, Settings

DAY = ["agent_id", "memory_date"]


def token_budget_plan(turns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunk count and budgets per agent-day from turn sizes (`tokens`).

    The count is the least that covers all tokens, raised until the longest turn
    fits one chunk or there is a chunk per turn. The share of reduce input
    shrinks as R // n, so the raised count has a closed form.
    """
    a, r = settings.map_budget, settings.reduce_budget
    if a <= 0 or r < 0:
        raise ValueError("no token budget is left for map or reduce calls")
    sized = turns.groupBy(*DAY).agg(
        F.sum("tokens").alias("total_tokens"), F.max("tokens").alias("longest"),
        F.count(F.lit(1)).alias("turns"))
    least = F.greatest(F.lit(1), F.ceil((F.col("total_tokens") + r) / a))
    least = F.when(F.col("total_tokens") > 0, least).otherwise(F.lit(1)).cast("bigint")
    room = F.lit(a) - F.col("longest")
    fitting = F.when(room >= 0, F.floor(F.lit(r) / (room + 1)) + 1).otherwise(F.col("turns"))
    count = F.greatest(F.col("_least"), F.least(fitting, F.greatest(F.col("turns"), F.lit(1)))).cast("bigint")
    return (sized.withColumn("_least", least).withColumn("chunk_count", count)
            .withColumn("map_output_budget", F.floor(F.lit(r) / F.col("chunk_count")))
            .withColumn("chunk_budget", F.lit(a) - F.col("map_output_budget"))
            .withColumn("turn_budget", F.greatest(F.lit(1), F.least(
                F.lit(settings.chunk_max_turns), F.ceil(F.col("turns") / F.col("chunk_count")))).cast("bigint"))
            .withColumn("feasible", F.col("chunk_count") * F.col("chunk_budget") >= F.col("total_tokens"))
            .drop("_least"))


def split_points(cuts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Best cut of each chunk.

    `cuts` has a row per turn with `first` (start of its chunk), `turn_index`,
    `before` (tokens before the turn on that day) and `fresh` (true when a user
    turn follows an assistant turn). `chunks` has `first`, `start_tokens`,
    `tokens` and `turns`. The cut goes before the turn that leaves tokens and
    turns most even; cuts between question rounds win if there are any.
    """
    total, count = F.col("tokens"), F.col("turns")
    left_tokens = F.col("before") - F.col("start_tokens")
    left_turns = F.col("turn_index") - F.col("first")
    uneven = (F.abs(left_tokens - total / 2) / F.greatest(F.lit(1), total)
              + F.abs(left_turns - count / 2) / F.greatest(F.lit(1), count))
    uneven = uneven + F.when(F.col("fresh"), 0.0).otherwise(0.25)
    best = F.min(F.struct((~F.col("fresh")).alias("stale"), uneven.alias("uneven"), "turn_index", "before"))
    return (cuts.filter(F.col("turn_index") > F.col("first"))
            .select(*DAY, "first", "turn_index", "before", "fresh")
            .join(chunks.select(*DAY, "first", "start_tokens", "tokens", "turns"), [*DAY, "first"])
            .groupBy(*DAY, "first").agg(best.alias("_best"))
            .select(*DAY, "first", F.col("_best.turn_index").alias("split_at"), F.col("_best.before").alias("split_tokens")))


def mark_cuts(turns: DataFrame) -> DataFrame:
    """Add `before` and `fresh` to turns that have `turn_index`, `role` and `tokens`."""
    role = F.lower(F.trim("role"))
    summed = running(turns, DAY, [id_bucket("turn_index")], [F.col("turn_index")], {"before": F.col("tokens")})
    # The role of the previous turn comes from an equi join, not from a window over the day.
    previous = turns.select(*DAY, (F.col("turn_index") + 1).alias("turn_index"),
                            (role == "assistant").alias("_after_assistant"))
    return (summed.join(previous, [*DAY, "turn_index"], "left")
            .withColumn("fresh", F.coalesce(F.col("_after_assistant") & (role == "user"), F.lit(False)))
            .drop("_after_assistant"))


def _halve_long_turns(alone: DataFrame, chars_per_token: int) -> DataFrame:
    """Cut single turns that exceed the budget in half by characters until each piece fits."""
    pieces = alone.withColumn("from_char", F.lit(0).cast("bigint")).withColumn("to_char", F.col("length"))
    done = None
    while True:
        size = F.col("to_char") - F.col("from_char")
        fits = (estimate_tokens(size, chars_per_token) <= F.col("chunk_budget")) | (size <= 1)
        ready, rest = pieces.filter(fits), pieces.filter(~fits)
        done = ready if done is None else done.unionByName(ready)
        if rest.isEmpty():
            return done
        middle = F.col("from_char") + F.ceil(size / 2)
        halves = F.explode(F.array(
            F.struct(F.col("from_char").alias("a"), middle.alias("b")),
            F.struct(middle.alias("a"), F.col("to_char").alias("b"))))
        kept = [c for c in rest.columns if c not in ("from_char", "to_char")]
        pieces = materialize(rest.select(*kept, halves.alias("_h")).select(
            *kept, F.col("_h.a").alias("from_char"), F.col("_h.b").alias("to_char")))


def chunk_bounds(turns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks as ranges of turns (and, for one over-long turn, of its characters).

    Needs `turn_index` dense from 0, `role` and `length`. Every round cuts all
    chunks that are over budget at once, so the number of rounds grows with the
    logarithm of the longest day, and each round moves only sizes, no text.
    """
    turns = turns.select(*DAY, "turn_index", "role", "length",
                         estimate_tokens(F.col("length"), settings.chars_per_token).alias("tokens"))
    plan = token_budget_plan(turns, settings)
    if not plan.filter(F.col("chunk_budget") < 1).isEmpty():
        raise ValueError("a chunk budget below one token cannot be met")
    cuts = materialize(mark_cuts(turns).withColumn("first", F.lit(0).cast("bigint")))
    chunks = plan.select(*DAY, "chunk_budget", "turn_budget", F.lit(0).cast("bigint").alias("first"),
                         F.lit(0).cast("bigint").alias("start_tokens"),
                         F.col("total_tokens").alias("tokens"), "turns")
    over = ((F.col("tokens") > F.col("chunk_budget")) | (F.col("turns") > F.col("turn_budget"))) & (F.col("turns") > 1)
    settled = None
    while True:
        chunks = materialize(chunks)
        within = chunks.filter(~over)
        settled = within if settled is None else settled.unionByName(within)
        pending = chunks.filter(over)
        if pending.isEmpty():
            break
        points = materialize(split_points(cuts, pending))
        parts = pending.join(points, [*DAY, "first"])
        left_tokens = F.col("split_tokens") - F.col("start_tokens")
        left_turns = F.col("split_at") - F.col("first")
        part = F.explode(F.array(
            F.struct("first", "start_tokens", left_tokens.alias("tokens"), left_turns.alias("turns")),
            F.struct(F.col("split_at").alias("first"), F.col("split_tokens").alias("start_tokens"),
                     (F.col("tokens") - left_tokens).alias("tokens"), (F.col("turns") - left_turns).alias("turns"))))
        chunks = parts.select(*DAY, "chunk_budget", "turn_budget", part.alias("_p")).select(
            *DAY, "chunk_budget", "turn_budget", "_p.*")
        cuts = materialize(cuts.join(points, [*DAY, "first"])
                           .withColumn("first", F.when(F.col("turn_index") >= F.col("split_at"), F.col("split_at"))
                                       .otherwise(F.col("first")))
                           .select(cuts.columns))
    too_long = (F.col("turns") == 1) & (F.col("tokens") > F.col("chunk_budget"))
    lengths = turns.select(*DAY, F.col("turn_index").alias("first"), "length")
    halved = _halve_long_turns(settled.filter(too_long).join(lengths, [*DAY, "first"]), settings.chars_per_token)
    size = estimate_tokens(F.col("to_char") - F.col("from_char"), settings.chars_per_token)
    bounds = (settled.filter(~too_long).withColumn("from_char", F.lit(0).cast("bigint"))
              .withColumn("to_char", F.lit(None).cast("bigint"))
              .unionByName(halved.withColumn("tokens", size).select(
                  *settled.columns, F.col("from_char").cast("bigint"), F.col("to_char").cast("bigint"))))
    bounds = materialize(bounds)
    counts = bounds.groupBy(*DAY).agg(F.count(F.lit(1)).alias("total_chunks"))
    numbered = ordinal(bounds, DAY, [id_bucket("first")], [F.col("first"), F.col("from_char")], name="chunk_id")
    return numbered.join(counts, DAY).select(
        *DAY, (F.col("chunk_id") + 1).alias("chunk_id"), "total_chunks", F.col("first").alias("first_turn"),
        (F.col("first") + F.col("turns") - 1).alias("last_turn"), "from_char", "to_char",
        F.col("tokens").alias("token_estimate"), F.col("turns").alias("fragment_count"))


def chunk_fragments(turns: DataFrame, bounds: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per fragment: the turns, or the pieces of a turn, of each chunk.

    A chunk covers at most `chunk_max_turns` turns, so laying chunks out over
    their turn numbers keeps the join an equi join.
    """
    laid = bounds.select("*", F.explode(F.sequence("first_turn", "last_turn")).alias("turn_index"))
    text = F.when(F.col("to_char").isNull(), F.col("content")).otherwise(
        F.substr("content", F.col("from_char") + 1, F.col("to_char") - F.col("from_char")))
    return turns.join(laid, [*DAY, "turn_index"]).select(
        *DAY, "chunk_id", "total_chunks", "turn_index", "role", "hhmm", text.alias("text"), "from_char").withColumn(
        "token_estimate", estimate_tokens(F.length("text"), settings.chars_per_token))


def chunk_completeness(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Per agent-day: planned, valid and missing chunks; complete only when every chunk has a valid result."""
    valid = results.select(*DAY, "chunk_id", "valid")
    return (plan.select(*DAY, "chunk_id").join(valid, [*DAY, "chunk_id"], "left")
            .groupBy(*DAY).agg(
                F.count(F.lit(1)).alias("planned"),
                F.count_if(F.coalesce("valid", F.lit(False))).alias("valid_chunks"),
                F.bool_and(F.coalesce("valid", F.lit(False))).alias("complete")))
