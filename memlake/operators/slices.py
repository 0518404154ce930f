"""Reduction of a transcript slice to a character budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions.text import middle_trim
from memlake.operators.prefix import id_bucket, running

MIN_LINE = 4  # "[x] ", the shortest possible line head
FLOOR = 24
SHRINK = 0.85


def drop_shortest_assistant(turns: DataFrame, budget: int) -> DataFrame:
    """Remove assistant turns, shortest first, until the slice fits.

    Needs `slice_id`, `pos` (0-based), `role`, `content_length`, `line_length`.
    A turn goes exactly when what is left without all shorter ones is still over
    budget, so no loop is needed: a running sum in length order decides.
    """
    totals = turns.groupBy("slice_id").agg(F.sum("line_length").alias("_total"))
    assistants = turns.filter(F.lower("role") == "assistant")
    ranked = running(assistants, ["slice_id"], [F.col("content_length"), id_bucket("pos")],
                     [F.col("content_length"), F.col("pos")], {"_gone": F.col("line_length")})
    doomed = ranked.join(totals, "slice_id").filter(F.col("_total") - F.col("_gone") > budget)
    return turns.join(doomed.select("slice_id", "pos"), ["slice_id", "pos"], "left_anti")


def stride_downsample(turns: DataFrame, budget: int) -> DataFrame:
    """Keep every s-th turn and the last one, with the smallest stride s >= 2 that fits.

    Needs `slice_id`, `pos` (dense from 0) and `line_length`. When no stride fits
    the widest one stays, which leaves the first and the last turn. Slices of one
    or two turns are returned whole.

    A row matters only to strides that divide its position. Lines have at least
    MIN_LINE characters, so a fitting stride keeps at most budget / MIN_LINE rows:
    each row is handed to a bounded number of strides, and their sums are plain
    aggregates.
    """
    most = max(1, budget // MIN_LINE)
    shape = turns.groupBy("slice_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("pos", "line_length")).alias("_last"),
        F.min(F.struct("pos", "line_length")).alias("_first"))
    sized = turns.join(shape, "slice_id")
    cofactors = F.sequence(F.lit(1).cast("bigint"), F.least(F.col("pos"), F.lit(most).cast("bigint")))
    strides = F.when(F.col("pos") > 0, F.filter(
        F.transform(F.filter(cofactors, lambda c: F.col("pos") % c == 0),
                    lambda c: F.floor(F.col("pos") / c)), lambda s: s >= 2))
    inner = sized.filter((F.col("_n") > 2) & (F.col("pos") < F.col("_last.pos")))
    sums = (inner.select("slice_id", F.explode(strides).alias("stride"), "line_length")
            .groupBy("slice_id", "stride").agg(F.sum("line_length").alias("_middle")))
    # A stride that divides no inner position keeps only the two ends; the widest always does.
    ends = shape.filter("_n > 2").select("slice_id", F.col("_n").alias("stride"), F.lit(0).cast("bigint").alias("_middle"))
    fitting = (sums.unionByName(ends).join(shape, "slice_id")
               .filter((F.col("_middle") + F.col("_first.line_length") + F.col("_last.line_length") <= budget)
                       & (F.col("_n") <= F.col("stride") * F.lit(most)))
               .groupBy("slice_id").agg(F.min("stride").alias("_stride")))
    chosen = shape.join(fitting, "slice_id", "left").select(
        "slice_id", "_n", F.col("_last.pos").alias("_end"), F.coalesce("_stride", "_n").alias("_stride"))
    return (turns.join(chosen, "slice_id")
            .filter((F.col("_n") <= 2) | (F.col("pos") % F.col("_stride") == 0) | (F.col("pos") == F.col("_end")))
            .select(turns.columns))


def compress_longest(turns: DataFrame, budget: int) -> DataFrame:
    """Shorten the longest content again and again until the slice fits.

    Needs `slice_id`, `pos`, `content`, `line_length`. Meant for what
    `stride_downsample` leaves over budget, which is two turns per slice: these
    are gathered and shortened in one expression. Each step takes SHRINK of the
    longest content, so the number of steps grows with the logarithm of lengths.
    """
    heads = turns.groupBy("slice_id").agg(
        F.sum(F.col("line_length") - F.length("content")).alias("_head"),
        F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("_turns"))
    sizes = lambda texts: F.transform(texts, F.length)
    total = lambda texts: F.aggregate(sizes(texts), F.lit(0).cast("bigint"), lambda n, size: n + size)
    texts = F.transform("_turns", lambda t: t["content"])
    most = F.aggregate(sizes(texts), F.lit(0), lambda n, size: n + F.ceil(
        F.log(F.greatest(size, F.lit(1)).cast("double")) / -math.log(SHRINK)).cast("int") + 1)

    def step(texts: Column, _: Column) -> Column:
        longest = F.array_max(sizes(texts))
        target = F.greatest(F.lit(FLOOR), F.floor(longest * F.lit(SHRINK)).cast("int"))
        at = F.array_position(sizes(texts), longest)
        shorter = F.transform(texts, lambda t, i: F.when(i + 1 == at, middle_trim(t, target)).otherwise(t))
        return F.when((F.col("_head") + total(texts) > budget) & (longest > FLOOR), shorter).otherwise(texts)

    cut = heads.select("slice_id", F.explode(F.arrays_zip(
        F.transform("_turns", lambda t: t["pos"]).alias("pos"),
        F.aggregate(F.sequence(F.lit(1), most), texts, step).alias("content"))).alias("_cut"))
    cut = cut.select("slice_id", "_cut.pos", F.col("_cut.content").alias("_content"))
    length = F.col("line_length") - F.length("content") + F.length("_content")
    joined = turns.join(cut, ["slice_id", "pos"])
    return joined.select(*[
        {"content": F.col("_content"), "line_length": length}.get(c, F.col(c)).alias(c) for c in turns.columns])


def line_length(role: Column, hhmm: Column, content: Column) -> Column:
    """Length of `render_exact_line` without building the line."""
    who = F.when(F.coalesce(role, F.lit("")) == "", F.lit(7)).otherwise(F.length(role))
    return (who + F.when(F.coalesce(hhmm, F.lit("")) != "", F.length(hhmm) + 1).otherwise(0)
            + 3 + F.length(content)).cast("bigint")
