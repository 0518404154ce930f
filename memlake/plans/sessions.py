"""Session registry: archiving finished sessions and forgetting archived ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import timeaxis
from memlake.operators.merging import merge_session_archive, prune
from memlake.settings import DEFAULTS, Settings

SESSION = ["agent_id", "session_id"]


def session_rollup(registry: DataFrame, boundary: Column | None = None) -> DataFrame:
    """Per session its distinct days and first sighting, up to `boundary`.

    Days are made distinct by an aggregate first, so only one row per session
    and day is gathered.
    """
    rows = registry if boundary is None else registry.filter(F.col("memory_date") <= boundary)
    per_day = rows.groupBy(*SESSION, "memory_date").agg(F.min("first_seen").alias("first_seen"))
    return per_day.groupBy(*SESSION).agg(F.array_sort(F.collect_list("memory_date")).alias("dates"),
                                         F.min("first_seen").alias("first_seen_min"))


def session_preserve(registry: DataFrame, archive: DataFrame, current: DataFrame, week: str,
                     files: DataFrame | None = None) -> DataFrame:
    """Session archive after the run of `week`: sessions seen by its Sunday, except the current ones."""
    seen = session_rollup(registry, timeaxis.week_sunday(F.lit(week))).join(current.select(*SESSION), SESSION, "left_anti")
    if files is None:
        incoming = seen.withColumn("archived_files", F.array().cast("array<string>"))
    else:
        names = files.groupBy(*SESSION).agg(F.array_sort(F.collect_set("file_name")).alias("archived_files"))
        incoming = seen.join(names, SESSION, "left")
    return merge_session_archive(archive, incoming.withColumn("archived_at", F.current_timestamp()))


def decay_days(registry: DataFrame, archive: DataFrame, boundary: Column) -> DataFrame:
    """Registered days up to the boundary: removable when some archived session covers them."""
    days = registry.filter(F.col("memory_date") <= boundary).select("agent_id", "memory_date").distinct()
    covered = archive.select("agent_id", F.explode("dates").alias("memory_date")).distinct().withColumn("_c", F.lit(True))
    return days.join(covered, ["agent_id", "memory_date"], "left").select(
        "agent_id", "memory_date", F.when(F.col("_c").isNull(), "missing_archive").alias("kept_because"))


def decay_sessions(registry: DataFrame, archive: DataFrame, current: DataFrame, boundary: Column) -> DataFrame:
    """Sessions up to the boundary, with the reason why each one stays, if it does."""
    facts = registry.groupBy(*SESSION).agg(
        F.bool_or(F.col("memory_date") <= boundary).alias("_before"),
        F.bool_or(F.col("memory_date") > boundary).alias("_after")).filter("_before")
    stored = archive.select(*SESSION, F.lit(True).alias("_stored"))
    live = current.select(*SESSION).distinct().withColumn("_current", F.lit(True))
    reason = (F.when(F.col("_current"), "current_session")
               .when(F.col("_stored").isNull(), "missing_archive")
               .when(F.col("_after"), "seen_after_boundary"))
    return (facts.join(live, SESSION, "left").join(stored, SESSION, "left")
            .select(*SESSION, reason.alias("kept_because")))


def decay_files(sessions: DataFrame, files: DataFrame, archived_files: DataFrame) -> DataFrame:
    """Files of removable sessions; those without an archived copy stay."""
    copies = archived_files.select("agent_id", "file_name").distinct().withColumn("_copy", F.lit(True))
    return (files.join(sessions.filter("kept_because is null").select(*SESSION), SESSION, "left_semi")
            .join(copies, ["agent_id", "file_name"], "left")
            .select(*SESSION, "file_name", F.when(F.col("_copy").isNull(), "missing_archive").alias("kept_because")))


def session_decay(registry: DataFrame, archive: DataFrame, week: str, apply: bool = False,
                  settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The registry after the decay run of `week` and the day report; unchanged unless `apply`."""
    report = decay_days(registry, archive, timeaxis.session_decay_boundary(F.lit(week), settings))
    if not apply:
        return registry, report
    return prune(registry, report.filter("kept_because is null"), ["agent_id", "memory_date"]), report
