"""Weekly decay: trimming, week rollups, multi-week rollups and their cleanups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.functions import let, timeaxis, text as tx
from memlake.operators.landmarks import analyze_counts, judge
from memlake.operators.merging import prune
from memlake.plans.preserve import mark_status
from memlake.settings import DEFAULTS, Settings

DAY = ["agent_id", "memory_date"]

# --- fixed values --------------------------------------------------------------------
EMPTY_WEEK_SUMMARY = "本周无可用 surface L1 文件，不生成周级语义摘要。"
# Limits of a rollup: counts of the lists, characters of the mood and of the summary of a week and of a window.
MERGE_LIMITS = {"tags": 12, "topics": 20, "decisions": 20, "todos": 15, "key_items": 20, "emotional_peaks": 15, "mood": 40}
SUMMARY_LIMITS = {"shallow": 200, "deep": 240}
# ---------------------------------------------------------------------------------------


# --- trimming ---------------------------------------------------------------------------

def trim_plan(l2_days: DataFrame, l1_days: DataFrame, markers: DataFrame, boundary: Column) -> DataFrame:
    """What happens to each transcript day up to `boundary`: a trim mode, or why it is left alone."""
    summarised = l1_days.select(*DAY, F.lit(True).alias("_l1"))
    thin = markers.filter("marker = 'nocontent'").select(*DAY).distinct().withColumn("_thin", F.lit(True))
    facts = (l2_days.filter(F.col("memory_date") <= boundary).join(summarised, DAY, "left").join(thin, DAY, "left"))
    reason = (F.when(F.col("status").isNull(), "invalid_l2_schema")
               .when(~F.coalesce("status.archived", F.lit(False)), "status_not_archived")
               .when(F.coalesce("status.trimmed", F.lit(False)), "already_trimmed")
               .when(F.col("_l1").isNull() & F.col("_thin").isNull(), "missing_l1_and_nocontent"))
    mode = F.when(F.col("_l1"), "trim_from_l1").otherwise("clear_for_nocontent")
    return facts.select(*DAY, F.when(reason.isNull(), mode).alias("mode"), reason.alias("skip_reason"))


def anchor_turns(l1_days: DataFrame) -> DataFrame:
    """Turn numbers worth keeping: emotional peaks and the turns a summary was drawn from."""
    peaks = F.transform(F.coalesce("emotional_peaks", F.array()), lambda p: p["turn"].cast("bigint"))
    hints = F.coalesce(F.col("compress_hints").cast("array<bigint>"), F.array())
    return l1_days.select(*DAY, F.explode(F.array_distinct(F.concat(peaks, hints))).alias("turn_index"))


def trim_turns(turns: DataFrame, plan: DataFrame, anchors: DataFrame) -> DataFrame:
    """Turns after trimming. Untouched days pass through; planned days keep their anchors."""
    planned = plan.filter("mode is not null").select(*DAY, "mode")
    tagged = turns.join(planned, DAY, "left").join(
        anchors.withColumn("_anchor", F.lit(True)), [*DAY, "turn_index"], "left")
    keep = F.col("mode").isNull() | ((F.col("mode") == "trim_from_l1") & F.col("_anchor").isNotNull())
    return tagged.filter(keep).select(turns.columns)


def trim_l2(turns: DataFrame, l2_days: DataFrame, l1_days: DataFrame, markers: DataFrame, week: str,
            settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trimmed turns, updated day rows and the plan of the decay run of `week`."""
    plan = trim_plan(l2_days, l1_days, markers, timeaxis.trim_boundary(F.lit(week), settings))
    done = plan.filter("mode is not null")
    return (trim_turns(turns, plan, anchor_turns(l1_days)), mark_status(l2_days, done, "trimmed"), plan)


# --- merging periods ----------------------------------------------------------------------

def _blank_free(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), tx.strip), lambda v: v != "")


def week_view(l1_days: DataFrame) -> DataFrame:
    """Per agent and ISO week, its day summaries in date order; a group has at most seven."""
    day = F.struct(
        "memory_date", F.coalesce("summary", F.lit("")).alias("summary"), _blank_free(F.col("tags")).alias("tags"),
        F.coalesce("day_mood", F.lit("")).alias("mood"), "topics", _blank_free(F.col("decisions")).alias("decisions"),
        _blank_free(F.col("todos")).alias("todos"), "key_items",
        F.transform("emotional_peaks", lambda p: F.struct(
            F.col("memory_date").alias("date"), p["emotion"].alias("emotion"),
            p["intensity"].cast("int").alias("intensity"), p["context"].alias("context"))).alias("emotional_peaks"))
    week = timeaxis.week_id(F.col("memory_date"))
    return l1_days.groupBy("agent_id", week.alias("week")).agg(F.array_sort(F.collect_list(day), lambda a, b: (
        F.when(a["memory_date"] < b["memory_date"], -1).when(a["memory_date"] > b["memory_date"], 1).otherwise(0)
    )).alias("periods"))


def _latest_texts(parts: Column, limit: int) -> Column:
    """The latest of some texts that fit into `limit` characters together, in order.

    If the last alone is too long, its beginning up to the last sentence end
    inside the limit, or cut at the limit where it has none.
    """
    kept = F.aggregate(F.reverse(parts), F.struct(F.lit("").alias("text"), F.lit(False).alias("full")), lambda got, part: F.struct(
        F.when(got["text"] == "", F.when(F.length(part) <= limit, part).otherwise(""))
         .when(~got["full"] & (F.length(got["text"]) + F.length(part) + 1 <= limit), F.concat_ws("；", part, got["text"]))
         .otherwise(got["text"]).alias("text"),
        (got["full"] | (F.length(got["text"]) + F.length(part) + F.when(got["text"] == "", 0).otherwise(1) > limit)).alias("full")),
        lambda got: got["text"])
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    head = F.left(last, F.lit(limit))
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?。！？；])", 1)
    return F.when(F.length(last) <= limit, kept).when(whole != "", whole).otherwise(head)


def merge_periods(periods: Column, depth: str = "shallow") -> dict[str, Column]:
    """Merge the summaries of consecutive periods into one.

    Lists are deduplicated and kept in order; beyond a limit the latest entries
    stay. `dropped` counts what the limits left out, texts included.
    """
    def gathered(name: str) -> Column:
        flat = F.flatten(F.transform(F.filter(periods, lambda p: p[name].isNotNull()), lambda p: p[name]))
        return F.reverse(F.array_distinct(F.reverse(flat)))  # of repeated entries the latest

    def latest(name: str) -> Column:
        return let(gathered(name), lambda all_: F.slice(
            all_, F.greatest(F.size(all_) - MERGE_LIMITS[name], F.lit(0)) + 1, MERGE_LIMITS[name]))

    def texts(name: str) -> Column:
        return F.array_distinct(F.filter(F.transform(periods, lambda p: p[name]), lambda v: v != ""))

    lists = ("tags", "topics", "decisions", "todos", "key_items", "emotional_peaks")
    dropped = sum((F.greatest(F.size(gathered(name)) - MERGE_LIMITS[name], F.lit(0)) for name in lists), F.lit(0))
    for name, limit in (("mood", MERGE_LIMITS["mood"]), ("summary", SUMMARY_LIMITS[depth])):
        long = F.length(F.array_join(texts(name), "；")) > limit
        dropped = dropped + F.when(long, 1).otherwise(0)
    return {"mood": let(texts("mood"), lambda t: _latest_texts(t, MERGE_LIMITS["mood"])),
            "summary": let(texts("summary"), lambda t: _latest_texts(t, SUMMARY_LIMITS[depth])),
            **{name: latest(name) for name in lists}, "dropped": dropped.cast("bigint")}


def shallow_rollup(agents: DataFrame, l1_days: DataFrame, week: str, settings: Settings = DEFAULTS,
                   source_week: str | None = None) -> DataFrame:
    """Week rollup rows of the decay run of `week`: one per agent, an empty one where no day summary exists."""
    source = F.lit(source_week) if source_week else timeaxis.shift_week(F.lit(week), -settings.shallow_weeks)
    start = timeaxis.week_monday(source)
    inside = l1_days.filter(F.col("memory_date").between(start, F.date_add(start, 6)))
    joined = agents.select("agent_id").distinct().join(week_view(inside), "agent_id", "left")
    merged = merge_periods(F.col("periods"))
    has = F.col("periods").isNotNull()
    fields = [F.when(has, merged["mood"]).otherwise("").alias("mood"),
              F.when(has, merged["summary"]).otherwise(EMPTY_WEEK_SUMMARY).alias("summary")]
    fields += [F.when(has, merged[n]).otherwise(F.array()).alias(n) for n in
               ("tags", "topics", "decisions", "todos", "key_items", "emotional_peaks")]
    return joined.select(
        "agent_id", F.lit("shallow").alias("depth"), source.alias("time_key"), start.alias("window_date_start"),
        F.date_add(start, 6).alias("window_date_end"), F.array().cast("array<string>").alias("source_weeks"),
        *fields, F.when(has, merged["dropped"]).otherwise(0).cast("bigint").alias("dropped"), (~has).alias("no_l1_files"))


def rollup_index_rows(rollups: DataFrame) -> DataFrame:
    """Index rows of rollups. Empty weeks wait for the deep rollup too but get no index row."""
    return rollups.filter(~F.coalesce("no_l1_files", F.lit(False))).select(
        "agent_id", "depth", "time_key", "summary", "tags", "mood",
        F.col("window_date_start").cast("string").alias("window_date_start"), F.lit(0).cast("bigint").alias("access_count"))


def shallow_delete_set(agents: DataFrame, l1_days: DataFrame, l2_days: DataFrame, markers: DataFrame,
                       verdicts: DataFrame, source_week: str) -> DataFrame:
    """Artefacts that leave with a rolled-up week.

    Only days that are no landmarks, a day without a verdict included. Summaries
    and transcripts go when archived, markers always; the index row goes with
    its summary.
    """
    calendar = agents.select("agent_id").distinct().select(
        "agent_id", F.explode(timeaxis.week_dates(F.lit(source_week))).alias("memory_date"))
    ordinary = calendar.join(verdicts.filter("landmark").select(*DAY), DAY, "left_anti")
    archived = F.coalesce("status.archived", F.lit(False))
    l1 = l1_days.filter(archived).select(*DAY)
    l2 = l2_days.filter(archived).select(*DAY)
    doomed = (l1.withColumn("artefact", F.lit("l1")).unionByName(l1.withColumn("artefact", F.lit("l0")))
              .unionByName(l2.withColumn("artefact", F.lit("l2")))
              .unionByName(markers.select(*DAY, F.col("marker").alias("artefact"))))
    return doomed.join(ordinary, DAY, "left_semi")


def apply_day_deletes(store: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """The store without the artefacts of a delete set."""
    def of(kind: str) -> DataFrame:
        return doomed.filter(F.col("artefact") == kind).select(*DAY)

    index_keys = of("l0").select("agent_id", F.lit("surface").alias("depth"),
                                 F.col("memory_date").cast("string").alias("time_key"))
    keys = ["agent_id", "depth", "time_key"]
    return {**store, "l1_days": prune(store["l1_days"], of("l1"), DAY), "l2_days": prune(store["l2_days"], of("l2"), DAY),
            "turns": prune(store["turns"], of("l2"), DAY),
            "day_markers": prune(store["day_markers"], doomed.withColumnRenamed("artefact", "marker"), [*DAY, "marker"]),
            "l0_index": prune(store["l0_index"], index_keys, keys),
            "l0_embeddings": prune(store["l0_embeddings"], index_keys, keys)}


def week_verdicts(counts: DataFrame, source_week: str, settings: Settings = DEFAULTS) -> DataFrame:
    start = timeaxis.week_monday(F.lit(source_week))
    return judge(analyze_counts(counts.filter(F.col("memory_date").between(start, F.date_add(start, 6)))), settings)


# --- multi-week rollups ----------------------------------------------------------------------

def earliest_weeks(registered: DataFrame, n: int) -> DataFrame:
    """The `n` oldest registered weeks per agent, for agents that have that many.

    Ranking is a top-k, which Spark cuts per task; the count is an aggregate. An
    agent therefore never needs all its weeks in one task.
    """
    known = registered.select("agent_id", "week").distinct().withColumn("monday", timeaxis.week_monday(F.col("week")))
    order = Window.partitionBy("agent_id").orderBy("monday")
    first = known.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
    enough = known.groupBy("agent_id").agg(F.count(F.lit(1)).alias("available")).filter(F.col("available") >= n)
    return first.join(enough, "agent_id")


def deep_windows(weeks: DataFrame) -> DataFrame:
    """Window of each agent's chosen weeks: `start+Nd`, gaps between weeks included."""
    spans = weeks.groupBy("agent_id").agg(
        F.min("monday").alias("window_date_start"), F.date_add(F.max("monday"), 6).alias("window_date_end"),
        F.array_sort(F.collect_list("week")).alias("source_weeks"))
    days = F.datediff("window_date_end", "window_date_start") + 1
    return spans.withColumn("time_key", F.concat(
        F.col("window_date_start").cast("string"), F.lit("+"), days.cast("string"), F.lit("d")))


def window_view(rollups: DataFrame, weeks: DataFrame) -> DataFrame:
    """Per agent, the week rollups of the chosen weeks in order; a group has as many as were chosen."""
    period = F.struct("window_date_start", "time_key", "summary", "tags", "mood", "topics", "decisions", "todos",
                      "key_items", "emotional_peaks")
    chosen = weeks.select("agent_id", F.col("week").alias("time_key"))
    return (rollups.filter("depth = 'shallow'").join(chosen, ["agent_id", "time_key"], "left_semi")
            .groupBy("agent_id").agg(F.array_sort(F.collect_list(period)).alias("periods")))


def deep_rollup(rollups: DataFrame, registered: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Multi-week rollup rows of all agents that have enough registered weeks."""
    weeks = earliest_weeks(registered, settings.deep_weeks)
    joined = deep_windows(weeks).join(window_view(rollups, weeks), "agent_id")
    merged = merge_periods(F.col("periods"), "deep")
    return joined.select(
        "agent_id", F.lit("deep").alias("depth"), "time_key", "window_date_start", "window_date_end", "source_weeks",
        *[merged[n].alias(n) for n in ("mood", "summary", "tags", "topics", "decisions", "todos", "key_items",
                                       "emotional_peaks", "dropped")], F.lit(False).alias("no_l1_files"))


def deep_delete_set(deep: DataFrame) -> DataFrame:
    """Week rows, registrations and index rows that a multi-week rollup replaced."""
    return deep.select("agent_id", F.lit("shallow").alias("depth"), F.explode("source_weeks").alias("time_key"))


def apply_deep_deletes(rollups: DataFrame, registered: DataFrame, index: DataFrame, embeddings: DataFrame,
                       doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    keys = ["agent_id", "depth", "time_key"]
    weeks = doomed.select("agent_id", F.col("time_key").alias("week"))
    return (prune(rollups, doomed, keys), prune(registered, weeks, ["agent_id", "week"]),
            prune(index, doomed, keys), prune(embeddings, doomed, keys))
