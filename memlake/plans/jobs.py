"""Targets of backfills and reruns, and rescoring. The runs themselves are in `daily` and `weekly`."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from memlake.functions import timeaxis
from memlake.operators.merging import without
from memlake.plans.write import record_counts

DAY = ["agent_id", "memory_date"]


def complete_days(l2_days: DataFrame, l1_days: DataFrame, markers: DataFrame, index: DataFrame) -> DataFrame:
    """Days that need no work: a transcript, and either a thin-day marker or summary plus index row."""
    indexed = index.select("agent_id", F.try_to_date("time_key").alias("memory_date")).filter("memory_date is not null")
    finished = l1_days.select(*DAY).join(indexed, DAY, "left_semi").unionByName(
        markers.filter("marker = 'nocontent'").select(*DAY))
    return l2_days.select(*DAY).join(finished, DAY, "left_semi")


def backfill_targets(agents: DataFrame, first: date, last: date, l2_days: DataFrame, l1_days: DataFrame,
                     markers: DataFrame, index: DataFrame) -> DataFrame:
    """Agent-days of the range that are not complete."""
    if last < first:
        raise ValueError("the last day is before the first")
    wanted = agents.select("agent_id").distinct().select(
        "agent_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("memory_date"))
    return without(wanted, complete_days(l2_days, l1_days, markers, index), keys=DAY)


def rerun_targets(failures: DataFrame) -> DataFrame:
    """Agent-days to run again: failures not yet marked done. A null agent means the whole day."""
    return failures.filter(~F.coalesce("rerun_done", F.lit(False))).select("agent_id", "memory_date").distinct()


def mark_rerun_done(failures: DataFrame, targets: DataFrame, run_name: str) -> DataFrame:
    """Flag the failures that a rerun covered."""
    hit = targets.select(F.col("memory_date").alias("_day"), F.col("agent_id").alias("_agent"), F.lit(True).alias("_hit"))
    joined = failures.join(hit, (F.col("memory_date") == F.col("_day")) & F.col("agent_id").eqNullSafe(F.col("_agent")), "left")
    done = F.coalesce("_hit", F.lit(False))
    return joined.select(
        *[c for c in failures.columns if c not in ("rerun_done", "rerun_at", "rerun_run_name")],
        (F.coalesce("rerun_done", F.lit(False)) | done).alias("rerun_done"),
        F.when(done, F.current_timestamp()).otherwise(F.col("rerun_at")).alias("rerun_at"),
        F.when(done, run_name).otherwise(F.col("rerun_run_name")).alias("rerun_run_name"))


def rescore_range(counts: DataFrame, l1_days: DataFrame, **days) -> DataFrame:
    """Count the days of a range anew; `days` as for `timeaxis.date_in_range`."""
    return record_counts(counts, l1_days.filter(timeaxis.date_in_range(F.col("memory_date"), **days)))
