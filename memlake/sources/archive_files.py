"""Archive files: weeks of all tables with their manifest, published together, and the way back.

The archive is a store (`snapshots`) whose tables are partitioned by week. Week
partitions are written first, the manifest of agent-weeks last, and the pointer
moves after both: an archive that was interrupted shows neither rows nor manifest
of the run. A restore reads the partitions of its week only.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.plans import preserve
from memlake.session import materialize
from memlake.sources.snapshots import Change, Store

MANIFEST = "manifest"
WEEK = ("week_id",)
AGENT_WEEK = ["agent_id", "week_id"]


def manifest(spark: SparkSession, path: str, weeks: list[str] | None = None) -> DataFrame | None:
    """Agent-weeks in the archive, None before the first one."""
    store = Store(spark, path)
    return store.read(MANIFEST, {"week_id": weeks} if weeks is not None else None) if store.has(MANIFEST) else None


def write_archive(tables: dict[str, DataFrame], path: str, weeks: list[str], overwrite: bool = False) -> DataFrame:
    """Archive the weeks of some tables; returns the manifest of what this run archived.

    Agent-weeks that are in the archive already stay as they are unless
    `overwrite`. Other agents of a week keep their rows; weeks without a row to
    archive are not written again. A run that finds nothing to archive publishes
    nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    store = Store(spark, path)
    version = store.version()
    known = store.read(MANIFEST, {"week_id": weeks}, version) if MANIFEST in version["tables"] else None
    archive = preserve.archive_weeks(tables, weeks, known, overwrite)
    fresh = materialize(preserve.manifest(archive))
    if fresh.isEmpty():
        return fresh
    # Names of weeks, not rows, go to the driver.
    touched = [r.week_id for r in fresh.where("week_id is not null").select("week_id").distinct().collect()]
    changes = {}
    for table, rows in {**archive, MANIFEST: fresh}.items():
        parts = store.parts(table, {"week_id": touched}, version) if table in version["tables"] else {}
        if parts:
            others = store.read(table, {"week_id": touched}, version).join(fresh.select(AGENT_WEEK), AGENT_WEEK, "left_anti")
            changes[table] = Change(others.unionByName(rows), WEEK, emptied=tuple(parts))
        else:
            changes[table] = Change(rows, WEEK)
    store.publish(changes)
    return fresh


def read_archive(spark: SparkSession, path: str, *, week: str | None = None, on: date | None = None,
                 levels: tuple[str, ...] = preserve.LEVELS) -> dict[str, DataFrame]:
    """Archived rows of a week or a day as `preserve.restore` takes them; only that week's files are listed."""
    store = Store(spark, path)
    if on is not None:
        year, number, _ = on.isocalendar()
        only = f"{year}-W{number:02d}"
    else:
        only = week
    tables = {t: store.read(t, {"week_id": [only]}) for t in store.version()["tables"] if t != MANIFEST}
    return preserve.select_for_restore(tables, week=week, on=on, levels=levels)


def archive_store(tables: dict[str, DataFrame], path: str, weeks: list[str], overwrite: bool = False) -> dict[str, DataFrame]:
    """Archive weeks to files; returns the tables with the archived days flagged.

    A day counts as archived if the archive has it, by this run or an earlier one.
    """
    write_archive(tables, path, weeks, overwrite)
    store = Store(next(iter(tables.values())).sparkSession, path)
    marked, version = dict(tables), store.version()
    for table in ("l1_days", "l2_days"):
        if table in version["tables"]:
            stored = store.read(table, {"week_id": weeks}, version).select(*preserve.DAY)
            unflagged = tables[table].where(~F.coalesce("status.archived", F.lit(False))).select(*preserve.DAY)
            marked[table] = preserve.mark_status(tables[table], stored.join(unflagged, preserve.DAY, "left_semi"), "archived")
    return marked
