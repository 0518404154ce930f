"""Late turns of days that are written already: what depends on a day follows its transcript.

A late turn renumbers its day. Turn numbers in the day's summary (peaks, hints)
are what trimming later goes by, and its counts, index row and vector came from
the transcript too. Days are summarised again where a summariser is given;
otherwise their summary stays and its turn numbers move along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memlake.plans import daily
from memlake.plans.embedding import Embed
from memlake.plans.extract import day_stats, initial_status, merge_transcript, order_turns, remap_anchors
from memlake.plans.weekly import partitioned
from memlake.plans.write import hashed_embedding
from memlake.session import materialize
from memlake.settings import DEFAULTS, Settings
from memlake.sources.snapshots import Change, Store

DAY = ["agent_id", "memory_date"]
STATS = ["total_turns", "user_turns", "assistant_turns"]


def move_anchors(l1_days: DataFrame, merged: DataFrame) -> DataFrame:
    """Day summaries with the turn numbers of their peaks and hints as they are after a merge.

    `merged` is a result of `merge_transcript` with the existing turns of all days
    of `l1_days`. Order is kept; a number that no turn has stays out.
    """
    peaks = l1_days.select(*DAY, F.posexplode("emotional_peaks").alias("pos", "p")).select(*DAY, F.lit("peak").alias("kind"), "pos", F.col("p.turn").alias("turn"), "p")
    hints = l1_days.select(*DAY, F.posexplode("compress_hints").alias("pos", "turn"))
    anchors = peaks.unionByName(hints.withColumn("kind", F.lit("hint")), allowMissingColumns=True)
    moved = remap_anchors(merged, anchors)
    # The peaks and hints of one day, as many as its summary has.
    sorted_ = lambda kind, value: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", value.alias("v"))))), lambda x: x["v"])
    lists = moved.groupBy(*DAY).agg(sorted_("peak", F.col("p").withField("turn", F.col("turn"))).alias("_peaks"), sorted_("hint", F.col("turn")).alias("_hints"))
    empty = lambda name: F.array().cast(l1_days.schema[name].dataType)
    changed = {"emotional_peaks": F.coalesce("_peaks", empty("emotional_peaks")), "compress_hints": F.coalesce("_hints", empty("compress_hints"))}
    kept = {name: F.when(F.col(name).isNotNull(), value) for name, value in changed.items()}
    return l1_days.join(lists, DAY, "left").withColumns(kept).select(l1_days.columns)


def fold_late_turns(store: Store, late: DataFrame, inference: daily.Inference | None = None, settings: Settings = DEFAULTS,
                    embed: Embed | None = None, model: str = "hashed-64", mark: dict | None = None) -> None:
    """Fold late turns into the store's days and bring all that depends on those days up to date, in one version.

    `late` has the columns of `turns`; turns that a day has already change
    nothing. New days get a transcript row and wait for the daily write. Written
    days (with a summary or a thin-day marker) are summarised again by
    `inference`, or keep their summary with moved turn numbers and new counts if
    it is None.
    """
    embed = embed or hashed_embedding()
    touched = materialize(late.select(*DAY).distinct())
    # Names of months go to the driver: the partitions to read and rewrite.
    months = [r[0] for r in touched.select(F.date_format("memory_date", "yyyy-MM")).distinct().collect()]
    if not months:
        return
    only = {t: {"depth": ["surface"], "period": months} if t.startswith("l0_") else {"memory_month": months} for t in (*daily.DAY_TABLES, "turns", "l2_days")}
    tables = {t: store.read(t, o).drop("memory_month", "period") for t, o in only.items()}
    inside = tables["turns"].join(touched, DAY, "left_semi")
    merged = materialize(merge_transcript(inside, late))
    turns = merged.select(tables["turns"].columns)
    out = {"turns": tables["turns"].join(touched, DAY, "left_anti").unionByName(turns)}
    new = touched.join(tables["l2_days"].select(*DAY), DAY, "left_anti").withColumn("status", initial_status())
    out["l2_days"] = tables["l2_days"].unionByName(new)

    written = tables["l1_days"].select(*DAY).unionByName(tables["day_markers"].where("marker = 'nocontent'").select(*DAY))
    again = turns.join(written, DAY, "left_semi")
    if inference is not None:
        summaries, _ = daily.summarise(again, inference, settings)
        out.update(daily.write_days(tables, again, summaries, embed, model))
    else:
        own = tables["l1_days"].join(touched, DAY, "left_semi")
        counts = day_stats(again).select(*DAY, *[F.col(c).alias(f"_{c}") for c in STATS])
        fresh = move_anchors(own, merged).join(counts, DAY, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in STATS})
        out["l1_days"] = tables["l1_days"].join(touched, DAY, "left_anti").unionByName(fresh.select(tables["l1_days"].columns))
    changes = {}
    for name, rows in out.items():
        rows, by = partitioned(name, rows)
        changes[name] = Change(rows, by, emptied=tuple(store.parts(name, only[name])))
    store.publish(changes, mark)
