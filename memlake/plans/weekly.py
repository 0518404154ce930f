"""The weekly run on a store of tables: archive, trim, rollups, vectors, cleanup, sessions; and many of them in a row.

Day tables are partitioned by month, index rows, vectors and rollups by depth and
month or year. A run reads and rewrites the partitions that its week and the days
still to trim lie in, and publishes all tables together with the key of its step:
a run that dies leaves the store as it was, and one that was published is not
done again. Each run starts from files, so that the hundredth plan is as small
as the first.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import timeaxis
from memlake.operators.merging import prune, register_weeks
from memlake.plans import decay, preserve, sessions
from memlake.plans.embedding import EMBEDDINGS, Embed, index_and_embed
from memlake.plans.write import hashed_embedding
from memlake.session import materialize
from memlake.settings import DEFAULTS, Settings
from memlake.sources import archive_files
from memlake.sources.snapshots import Change, Store, part_values

DAY = ["agent_id", "memory_date"]
L0 = ["agent_id", "depth", "time_key"]
DAYS = ("l1_days", "l2_days", "turns", "day_markers", "landmark_counts")
KEYED = ("l0_index", "l0_embeddings", "rollups")
WHOLE = ("agents", "shallow_weeks", "session_registry", "session_archive", "current_sessions")
ARCHIVED = ("l1_days", "l2_days", "turns", "day_markers", "l0_index", "l0_embeddings")
Verdicts = Callable[[DataFrame, str, Settings], DataFrame]


def _period() -> Column:
    """Months of days, years of weeks and windows."""
    return F.when(F.col("depth") == "surface", F.left("time_key", F.lit(7))).otherwise(F.left("time_key", F.lit(4)))


def partitioned(table: str, rows: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    if table in DAYS:
        return rows.withColumn("memory_month", F.date_format("memory_date", "yyyy-MM")), ("memory_month",)
    if table in KEYED:
        return rows.withColumn("period", _period()), ("depth", "period")
    return rows, ()


def create_store(store: Store, tables: dict[str, DataFrame]) -> None:
    """Write tables as the first version of a store (or replace them whole)."""
    changes = {}
    for name, rows in tables.items():
        if name == "l0_embeddings" and "fingerprint" not in rows.columns:
            rows = rows.withColumns({"model": F.lit("").cast("string"), "fingerprint": F.lit("")}).select(
                *[f.split(" ")[0] for f in EMBEDDINGS.split(", ")])
        rows, by = partitioned(name, rows)
        changes[name] = Change(rows, by, whole=True, shared=True)  # a folder for each month would cost more than its rows
    store.publish(changes)


class Slice:
    """The partitions of a store that one run works on, as plain tables."""

    def __init__(self, store: Store, months: set[str], years: set[str]):
        self.store, self.parts = store, {}
        self.tables: dict[str, DataFrame] = {}
        version = store.version()
        for name, about in version["tables"].items():
            if name in DAYS:
                only = {"memory_month": sorted(months)}
            elif name in KEYED:
                only = {"depth": ["surface", "shallow", "deep"], "period": sorted(months | years)}
            else:
                only = None
            self.parts[name] = tuple(store.parts(name, only, version)) if about["by"] else ()
            self.tables[name] = store.read(name, only, version).drop("memory_month", "period")

    def publish(self, tables: dict[str, DataFrame], marks: dict) -> None:
        """Put changed tables in place of the slice."""
        changes = {}
        for name, rows in tables.items():
            rows, by = partitioned(name, rows)
            changes[name] = Change(rows, by, whole=not by, emptied=self.parts[name])
        self.store.publish(changes, marks)


def week_of(week: str) -> tuple[date, date]:
    year, number = week.split("-W")
    return date.fromisocalendar(int(year), int(number), 1), date.fromisocalendar(int(year), int(number), 7)


def _to_trim(store: Store, sunday: date) -> set[str]:
    """Months with days up to `sunday` that may still be trimmed; month names, not days, go to the driver."""
    version = store.version()
    months = {(part_values(n) or {}).get("memory_month") for n in store.parts("l2_days", None, version)}
    past = sorted(m for m in months if m is not None and m <= sunday.strftime("%Y-%m"))
    open_ = store.read("l2_days", {"memory_month": past}, version).where((F.col("memory_date") <= F.lit(sunday)) & ~F.coalesce("status.trimmed", F.lit(False)))
    return {r.memory_month for r in open_.select("memory_month").distinct().collect()}


def decay_week(state: dict[str, DataFrame], week: str, apply: bool, settings: Settings = DEFAULTS, embed: Embed | None = None,
               model: str = "hashed-64", verdicts: Verdicts = decay.week_verdicts) -> dict[str, DataFrame]:
    """The tables after trimming, rolling up and, with `apply`, cleaning one source week.

    Returns the changed tables only. Rollups get index rows and vectors as days
    do. A rollup of a week or window that exists is replaced, so that a run that
    is repeated, or one without `apply`, adds no second row.
    """
    embed = embed or hashed_embedding()
    out: dict[str, DataFrame] = {}
    plan = materialize(decay.trim_plan(state["l2_days"], state["l1_days"], state["day_markers"], timeaxis.week_sunday(F.lit(week))))
    out["turns"] = decay.trim_turns(state["turns"], plan, decay.anchor_turns(state["l1_days"]))
    out["l2_days"] = preserve.mark_status(state["l2_days"], plan.where("mode is not null"), "trimmed")

    columns = state["rollups"].columns
    weekly = materialize(decay.shallow_rollup(state["agents"], state["l1_days"], week, settings, source_week=week)).select(columns)
    rollups = prune(state["rollups"], weekly, L0).unionByName(weekly)
    registered = register_weeks(state["shallow_weeks"], weekly.withColumn("week", F.col("time_key")))
    deep = materialize(decay.deep_rollup(rollups, registered, settings)).select(columns)
    out["rollups"] = prune(rollups, deep, L0).unionByName(deep)
    out["shallow_weeks"] = registered
    fresh = decay.rollup_index_rows(weekly).unionByName(decay.rollup_index_rows(deep))
    out["l0_index"], out["l0_embeddings"] = index_and_embed(state["l0_index"], state["l0_embeddings"], fresh, embed, model, "deep")
    if not apply:
        return out
    doomed = materialize(decay.shallow_delete_set(state["agents"], state["l1_days"], state["l2_days"], state["day_markers"],
                                                  verdicts(state["landmark_counts"], week, settings), week))
    out = {**out, **{t: rows for t, rows in decay.apply_day_deletes({**state, **out}, doomed).items() if t in ARCHIVED}}
    consumed = decay.deep_delete_set(deep)
    out["rollups"], out["shallow_weeks"], out["l0_index"], out["l0_embeddings"] = decay.apply_deep_deletes(
        out["rollups"], out["shallow_weeks"], out["l0_index"], out["l0_embeddings"], consumed)
    return out


def run_week(store: Store, week: str, archive_path: str | None = None, apply: bool = False, settings: Settings = DEFAULTS,
             embed: Embed | None = None, model: str = "hashed-64", verdicts: Verdicts = decay.week_verdicts) -> bool:
    """The whole run over one source week; False if it was done before.

    With `archive_path` the week is archived to files first and its days are
    flagged, which is what allows them to be trimmed and deleted. Sessions, where
    the store has them, are archived up to the week and, with `apply`, forgotten
    as the settings say.
    """
    step = f"weekly:{week}:{'apply' if apply else 'keep'}"
    if store.mark(step) is not None:
        return False
    monday, sunday = week_of(week)
    months = {d.strftime("%Y-%m") for d in (monday, sunday)} | _to_trim(store, sunday)
    # Week and window rows of the years that this week's rollups and the weeks waiting for a window are in.
    years = {int(r[0]) for r in store.read("shallow_weeks").select(F.left("week", F.lit(4))).distinct().collect()}
    years |= {monday.year, sunday.year, int(week[:4])}
    slice_ = Slice(store, months, {str(y - back) for y in years for back in (0, 1)})  # a week may begin in the year before
    state = dict(slice_.tables)
    marks = {step: sunday.isoformat()}
    if archive_path:
        state.update(archive_files.archive_store({t: state[t] for t in ARCHIVED}, archive_path, [week]))
    changed = {**{t: state[t] for t in ("l1_days", "l2_days") if archive_path}, **decay_week(state, week, apply, settings, embed, model, verdicts)}
    if {"session_registry", "session_archive", "current_sessions"} <= set(state):
        archive = sessions.session_preserve(state["session_registry"], state["session_archive"], state["current_sessions"], week)
        changed["session_archive"] = archive = materialize(archive)
        changed["session_registry"], _ = sessions.session_decay(state["session_registry"], archive, week, apply, settings)
    slice_.publish(changed, marks)
    return True


def weeks_between(first: date, last: date) -> list[str]:
    """Week ids from the week of `first` to the last week complete by `last`."""
    monday, out = first - timedelta(days=first.weekday()), []
    while monday + timedelta(days=6) <= last:
        year, number, _ = monday.isocalendar()
        out.append(f"{year}-W{number:02d}")
        monday += timedelta(days=7)
    return out


def backfill_weeks(store: Store, first: date, last: date, archive_path: str | None = None, apply: bool = False,
                   settings: Settings = DEFAULTS, keep: int = 2, **how) -> list[str]:
    """Weekly runs in order, each on what the one before published; returns the weeks that were run.

    A job that was ended goes on with the first week that is not published.
    Versions before the last `keep` go with their files.
    """
    done = []
    for week in weeks_between(first, last):
        if run_week(store, week, archive_path, apply, settings, **how):
            done.append(week)
            store.expire(keep)
    return done
