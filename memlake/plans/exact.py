"""Exact recall of a time slice of one day's transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import scores as sc, text as tx
from memlake.operators import slices as sl
from memlake.operators.prefix import id_bucket, ordinal
from memlake.session import materialize
from memlake.settings import DEFAULTS, Settings

# --- fixed value: the answer when nothing was said ---------------------------------------
NO_TRANSCRIPT = "该时间范围内无可用对话记录。"
# -------------------------------------------------------------------------------------------


def time_slice(hhmm: Column, start: Column, end: Column) -> Column:
    """Inclusive comparison of clock texts; turns without a time always belong."""
    clock = tx.strip(F.coalesce(hhmm, F.lit("")))
    return (clock == "") | clock.between(start, end)


def choose_copy(slices: DataFrame, live_days: DataFrame, archived_days: DataFrame,
                settings: Settings = DEFAULTS) -> DataFrame:
    """Which copy of the day answers each slice: `live`, `archive` or none.

    Recent days: the live transcript unless it was trimmed, then the archive.
    Older days: the archive, then the live transcript unless it was trimmed.
    """
    cutoff = F.date_sub("today", 7 * max(0, settings.trim_weeks))
    live = live_days.select("agent_id", "memory_date", F.coalesce("status.trimmed", F.lit(False)).alias("_trimmed"))
    stored = archived_days.select("agent_id", "memory_date", F.lit(True).alias("_stored"))
    facts = slices.join(live, ["agent_id", "memory_date"], "left").join(stored, ["agent_id", "memory_date"], "left")
    whole = F.when(~F.col("_trimmed"), "live")
    kept = F.when(F.col("_stored"), "archive")
    choice = F.when(F.col("memory_date") >= cutoff, F.coalesce(whole, kept)).otherwise(F.coalesce(kept, whole))
    return facts.withColumn("copy", choice).drop("_trimmed", "_stored")


def slice_turns(slices: DataFrame, live_turns: DataFrame, archived_turns: DataFrame) -> DataFrame:
    """Turns of each slice from its chosen copy, with the lengths the reduction needs."""
    columns = ["agent_id", "memory_date", "turn_index", "role", "hhmm", "content"]
    copies = (live_turns.select(*columns).withColumn("copy", F.lit("live"))
              .unionByName(archived_turns.select(*columns).withColumn("copy", F.lit("archive"))))
    picked = (slices.select("slice_id", "agent_id", "memory_date", "copy", "from_hhmm", "to_hhmm")
              .join(copies, ["agent_id", "memory_date", "copy"])
              .filter(time_slice(F.col("hhmm"), F.col("from_hhmm"), F.col("to_hhmm"))))
    lines = picked.select(
        "slice_id", "turn_index", tx.strip(F.coalesce("role", F.lit(""))).alias("role"),
        tx.strip(F.coalesce("hhmm", F.lit(""))).alias("hhmm"),
        tx.strip(F.coalesce("content", F.lit(""))).alias("content"))
    return lines.withColumn("content_length", F.length("content").cast("bigint")).withColumn(
        "line_length", sl.line_length(F.col("role"), F.col("hhmm"), F.col("content")))


def _renumber(turns: DataFrame) -> DataFrame:
    return ordinal(turns.drop("pos"), ["slice_id"], [id_bucket("turn_index")], [F.col("turn_index")], name="pos")


def _over(turns: DataFrame, budget: int) -> DataFrame:
    return turns.groupBy("slice_id").agg(F.sum("line_length").alias("_t")).filter(F.col("_t") > budget).select("slice_id")


def reduce_slices(turns: DataFrame, budget: int) -> DataFrame:
    """Fit every slice into `budget` characters.

    Slices that fit pass through. The others lose their shortest assistant
    turns, then turns between strides, and as a last step the middle of their
    longest texts. Each step works only on slices that are still too long.
    Line breaks do not count towards the budget.
    """
    turns = materialize(_renumber(turns))
    over = _over(turns, budget)
    done = turns.join(over, "slice_id", "left_anti")
    reduced = materialize(_renumber(sl.drop_shortest_assistant(turns.join(over, "slice_id", "left_semi"), budget)))
    still = _over(reduced, budget)
    done = done.unionByName(reduced.join(still, "slice_id", "left_anti"))
    sampled = materialize(_renumber(sl.stride_downsample(reduced.join(still, "slice_id", "left_semi"), budget)))
    last = _over(sampled, budget)
    done = done.unionByName(sampled.join(last, "slice_id", "left_anti"))
    return done.unionByName(sl.compress_longest(sampled.join(last, "slice_id", "left_semi"), budget))


def recall_exact(slices: DataFrame, live_turns: DataFrame, live_days: DataFrame, archived_turns: DataFrame,
                 archived_days: DataFrame, max_chars: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Transcript text per slice.

    `slices`: slice_id, agent_id, memory_date, from_hhmm, to_hhmm, today.
    """
    budget = settings.exact_max_chars if max_chars is None else max(1, min(settings.exact_max_chars, max_chars))
    chosen = choose_copy(slices, live_days, archived_days, settings)
    lines = slice_turns(chosen, live_turns, archived_turns)
    whole = lines.groupBy("slice_id").agg(F.sum("line_length").alias("_before"))
    fitted = reduce_slices(lines, budget)
    line = sc.render_exact_line(F.col("role"), F.col("hhmm"), F.col("content"))
    # What is gathered fits the budget, so a group is a few thousand characters.
    text = (fitted.groupBy("slice_id").agg(F.array_sort(F.collect_list(
        F.struct("turn_index", line.alias("line")))).alias("_l"))
        .select("slice_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text")))
    cut = F.when(F.col("_before") > budget, F.left("text", F.lit(budget))).otherwise(F.col("text"))
    return (slices.select("slice_id", "agent_id", "memory_date").join(text, "slice_id", "left").join(whole, "slice_id", "left")
            .select("slice_id", "agent_id", "memory_date", F.coalesce(F.nullif(cut, F.lit("")), F.lit(NO_TRANSCRIPT)).alias("text")))
