"""The daily write over targets: a ledger hands out open work, failed days stay out, reruns take them up again.

The ledger is a table of the store, one row per agent-day that was ever a target:
`status` (open, failed, done), `attempts`, `problem` and the run's name. Each
round hands out the open days with attempts left, and publishes their results
and their ledger rows together, so that a job that dies repeats at most the
round it was in. Inside a round a day whose chunk or merge failed is left out of
everything that follows; the other days are written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from memlake.operators.chunking import chunk_bounds, chunk_fragments
from memlake.operators.landmarks import count_documents
from memlake.operators.merging import prune, upsert
from memlake.plans import jobs, write
from memlake.plans.embedding import Embed, index_and_embed
from memlake.plans.weekly import partitioned
from memlake.plans.write import hashed_embedding
from memlake.session import materialize
from memlake.settings import DEFAULTS, Settings
from memlake.sources.snapshots import Change, Store

DAY = ["agent_id", "memory_date"]
CHUNK = [*DAY, "chunk_id"]
LEDGER = "agent_id string, memory_date date, status string, attempts int, problem string, run_name string"
OPEN, FAILED, DONE = "open", "failed", "done"


@dataclass(frozen=True)
class Inference:
    """How a round is summarised: rows of fragments in, checked rows out.

    `chunks` gets the fragments of the handed-out days and returns one row per
    chunk with `valid`; `days` gets those results and returns one row per day with
    `valid`, `problem` and the fields of a day summary. Days of an invalid chunk
    are taken out before `days` sees them.
    """
    chunks: Callable[[DataFrame], DataFrame]
    days: Callable[[DataFrame, DataFrame], DataFrame]


def built_in() -> Inference:
    """The extractive summariser, which cannot fail."""
    def chunks(fragments: DataFrame) -> DataFrame:
        return fragments.select(*CHUNK).distinct().withColumn("valid", F.lit(True))

    def days(_: DataFrame, fragments: DataFrame) -> DataFrame:
        found = write.infer_reduce(write.infer_map(fragments), write.low_signal_context(fragments))
        return found.withColumns({"valid": F.lit(True), "problem": F.lit(None).cast("string")})

    return Inference(chunks, days)


# --- ledger -----------------------------------------------------------------------------------

def enroll(ledger: DataFrame, targets: DataFrame) -> DataFrame:
    """The ledger with new targets as open; days that it has stay as they are."""
    new = targets.select(*DAY).distinct().join(ledger.select(*DAY), DAY, "left_anti")
    return ledger.unionByName(new.select(*DAY, F.lit(OPEN).alias("status"), F.lit(0).alias("attempts"),
                                         F.lit(None).cast("string").alias("problem"), F.lit(None).cast("string").alias("run_name")))


def reopen(ledger: DataFrame, targets: DataFrame) -> DataFrame:
    """Failed days among the targets are open again, with all attempts left; a null agent means every agent of the day."""
    exact = targets.where("agent_id is not null").select(*DAY).distinct().withColumn("_exact", F.lit(True))
    whole = targets.where("agent_id is null").select("memory_date").distinct().withColumn("_whole", F.lit(True))
    hit = (F.col("status") == FAILED) & (F.col("_exact").isNotNull() | F.col("_whole").isNotNull())
    return ledger.join(exact, DAY, "left").join(whole, "memory_date", "left").withColumns({
        "status": F.when(hit, OPEN).otherwise(F.col("status")), "attempts": F.when(hit, 0).otherwise(F.col("attempts"))}).select(ledger.columns)


def hand_out(ledger: DataFrame, retries: int) -> DataFrame:
    """Open days with attempts left."""
    return ledger.where((F.col("status") == OPEN) & (F.col("attempts") <= retries)).select(*DAY)


def settle(ledger: DataFrame, outcome: DataFrame, retries: int, run_name: str) -> DataFrame:
    """The ledger after a round; `outcome` has `succeeded` and `problem` of the days handed out."""
    tried = F.col("_ok").isNotNull()
    attempts = F.when(tried, F.col("attempts") + 1).otherwise(F.col("attempts"))
    status = (F.when(~tried, F.col("status")).when(F.col("_ok"), DONE)
               .when(F.col("attempts") + 1 > retries, FAILED).otherwise(OPEN))
    known = outcome.select(*DAY, F.col("succeeded").alias("_ok"), F.col("problem").alias("_problem"))
    return ledger.join(known, DAY, "left").select(
        *DAY, status.alias("status"), attempts.cast("int").alias("attempts"),
        F.when(tried, F.col("_problem")).otherwise(F.col("problem")).alias("problem"),
        F.when(tried, run_name).otherwise(F.col("run_name")).alias("run_name"))


def failures(store: Store) -> DataFrame:
    """Failed days with their problem, as `jobs.rerun_targets` and `reopen` take them."""
    return store.read("ledger").where(F.col("status") == FAILED).select(*DAY, "attempts", "problem", "run_name")


# --- rounds -----------------------------------------------------------------------------------

def summarise(turns: DataFrame, inference: Inference, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Summaries of the days whose every chunk and merge is valid, and the outcome of all days.

    Days without a turn have an empty transcript and fail as such only if they
    are not in `turns` at all; see `write_targets`.
    """
    bounds = chunk_bounds(turns.withColumn("length", F.length("content").cast("bigint")), settings)
    fragments = materialize(chunk_fragments(turns, bounds, settings))
    chunked = materialize(inference.chunks(fragments))
    plan = fragments.select(*CHUNK, "total_chunks").distinct()
    outcome = write.run_outcome(plan, chunked)
    sound = outcome.where("succeeded").select(*DAY)
    merged = materialize(inference.days(chunked.join(sound, DAY, "left_semi"), fragments.join(sound, DAY, "left_semi")))
    joined = outcome.join(merged.select(*DAY, F.col("valid").alias("_valid"), "problem"), DAY, "left")
    problem = F.when(~F.col("succeeded"), F.concat(F.col("failed_chunks").cast("string"), F.lit(" of "), F.col("total_chunks").cast("string"),
                                                   F.lit(" chunks failed"))).otherwise(F.coalesce("problem", F.when(~F.coalesce("_valid", F.lit(False)), F.lit("merge failed"))))
    done = F.col("succeeded") & F.coalesce("_valid", F.lit(False))
    return merged.where("valid").drop("valid", "problem"), joined.select(*DAY, done.alias("succeeded"), F.when(~done, problem).alias("problem"))


def write_days(tables: dict[str, DataFrame], turns: DataFrame, summaries: DataFrame, embed: Embed, model: str) -> dict[str, DataFrame]:
    """The day tables with the summaries written: L1 rows or thin-day markers, index rows, vectors and counts."""
    written = summaries.select(*DAY)
    stats = turns.join(written, DAY, "left_semi").groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("total_turns"), F.count_if(F.col("role") == "user").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"))
    filled, thin = write.finalize_days(write.l1_skeleton(stats), summaries)
    filled = materialize(filled)
    others = lambda t: tables[t].join(written, DAY, "left_anti")
    out = {"l1_days": others("l1_days").unionByName(filled), "landmark_counts": others("landmark_counts").unionByName(count_documents(filled)),
           "day_markers": prune(tables["day_markers"], written.withColumn("marker", F.lit("nocontent")), [*DAY, "marker"]).unionByName(thin)}
    gone = thin.select("agent_id", F.lit("surface").alias("depth"), F.col("memory_date").cast("string").alias("time_key"))
    index, vectors = index_and_embed(tables["l0_index"], tables["l0_embeddings"], write.index_rows(filled), embed, model)
    keys = ["agent_id", "depth", "time_key"]
    return {**out, "l0_index": prune(index, gone, keys), "l0_embeddings": prune(vectors, gone, keys)}


DAY_TABLES = ("l1_days", "landmark_counts", "day_markers", "l0_index", "l0_embeddings")


def write_targets(store: Store, targets: DataFrame | None, inference: Inference | None = None, run_name: str = "daily",
                  settings: Settings = DEFAULTS, embed: Embed | None = None, model: str = "hashed-64") -> int:
    """Write all targets and retry what failed; returns the number of rounds.

    Targets are enrolled in the ledger first; None takes up what is open. A
    target without a transcript fails as `no transcript`. After at most
    `settings.retries` + 1 rounds every target is done or failed.
    """
    inference, embed = inference or built_in(), embed or hashed_embedding()
    spark = store.spark
    ledger = store.read("ledger") if store.has("ledger") else spark.createDataFrame([], LEDGER)
    if targets is not None:
        store.publish({"ledger": Change(enroll(ledger.select([f.split(" ")[0] for f in LEDGER.split(", ")]), targets), whole=True)})
    rounds = 0
    while True:
        ledger = store.read("ledger")
        handed = materialize(hand_out(ledger, settings.retries))
        if handed.isEmpty():
            return rounds
        rounds += 1
        _round(store, ledger, handed, inference, run_name, settings, embed, model)


def _round(store: Store, ledger: DataFrame, handed: DataFrame, inference: Inference, run_name: str, settings: Settings,
           embed: Embed, model: str) -> None:
    # Names of months, not days, go to the driver: the partitions that the round reads and rewrites.
    months = [r[0] for r in handed.select(F.date_format("memory_date", "yyyy-MM")).distinct().collect()]
    turns = store.read("turns", {"memory_month": months}).drop("memory_month").join(handed, DAY, "left_semi")
    summaries, outcome = summarise(turns, inference, settings)
    outcome = materialize(handed.join(outcome, DAY, "left").select(
        *DAY, F.coalesce("succeeded", F.lit(False)).alias("succeeded"),
        F.when(F.col("succeeded").isNull(), "no transcript").otherwise(F.col("problem")).alias("problem")))
    only = {t: {"depth": ["surface"], "period": months} if t.startswith("l0_") else {"memory_month": months} for t in DAY_TABLES}
    tables = {t: store.read(t, only[t]).drop("memory_month", "period") for t in DAY_TABLES}
    changes = {"ledger": Change(settle(ledger, outcome, settings.retries, run_name), whole=True)}
    for name, rows in write_days(tables, turns, summaries, embed, model).items():
        rows, by = partitioned(name, rows)
        changes[name] = Change(rows, by, emptied=tuple(store.parts(name, only[name])))
    store.publish(changes)


# --- jobs -------------------------------------------------------------------------------------

def backfill_days(store: Store, first: date, last: date, **how) -> int:
    """Write all days of a range that are not complete; returns the number of rounds."""
    read = store.read
    targets = jobs.backfill_targets(read("agents"), first, last, read("l2_days"), read("l1_days"), read("day_markers"), read("l0_index"))
    transcripts = read("l2_days").select(*DAY)
    return write_targets(store, materialize(targets.join(transcripts, DAY, "left_semi")), **how)


def rerun_failures(store: Store, targets: DataFrame | None = None, run_name: str = "rerun", **how) -> int:
    """Run failed days again, all or the given ones; returns the number of rounds."""
    targets = failures(store) if targets is None else targets
    store.publish({"ledger": Change(reopen(store.read("ledger"), targets), whole=True)})
    return write_targets(store, None, run_name=run_name, **how)


__all__ = ["Inference", "backfill_days", "built_in", "enroll", "failures", "hand_out", "reopen", "rerun_failures", "settle", "summarise",
           "upsert", "write_days", "write_targets"]
