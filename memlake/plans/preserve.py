"""Weekly archive and restore.

A store is a dict of DataFrames: `l1_days`, `l2_days`, `turns`, `day_markers`,
`l0_index`, `l0_embeddings`. An archive holds the same tables with a `week_id`
partition column.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import timeaxis
from memlake.operators.merging import restore_merge

DAY = ["agent_id", "memory_date"]
L0 = ["agent_id", "depth", "time_key"]
KEYS = {"l1_days": DAY, "l2_days": DAY, "turns": DAY, "day_markers": [*DAY, "marker"],
        "l0_index": L0, "l0_embeddings": L0}
LEVELS = ("l0", "l1", "l2")


def _day(table: str) -> Column:
    return F.try_to_date("time_key") if table.startswith("l0_") else F.col("memory_date")


def _spans(weeks: list[str]) -> list[tuple[date, date]]:
    """First and last days of runs of consecutive weeks."""
    mondays = sorted(date.fromisocalendar(int(week.split("-W")[0]), int(week.split("-W")[1]), 1) for week in set(weeks))
    spans: list[tuple[date, date]] = []
    for monday in mondays:
        begin = spans.pop()[0] if spans and spans[-1][1] + timedelta(days=1) == monday else monday
        spans.append((begin, monday + timedelta(days=6)))
    return spans


def _ids(spans: list[tuple[date, date]]) -> list[str]:
    """The ISO weeks of the spans."""
    mondays = [first + timedelta(days=n) for first, last in spans for n in range(0, (last - first).days, 7)]
    return ["{}-W{:02d}".format(*monday.isocalendar()) for monday in mondays]


def _in_weeks(df: DataFrame, table: str, weeks: list[str] | None) -> DataFrame:
    """Rows of the given ISO weeks with their `week_id`; of the index only day rows are archived."""
    if table.startswith("l0_"):
        df = df.filter("depth = 'surface'")
    day = _day(table)
    tagged = df.withColumn("week_id", timeaxis.week_id(day))
    if weeks is None:
        return tagged
    # A plain range reaches the Parquet scan as a filter; the derived week id would not. Where weeks are missing in
    # between, their ids decide: a range for each run of weeks nests as deep as there are runs, too deep for years of them.
    spans = _spans(weeks)
    if not spans:
        return tagged.filter(F.lit(False))
    first, last = spans[0][0], spans[-1][1]
    if table.startswith("l0_"):
        tagged = tagged.filter(F.col("time_key").between(first.isoformat(), last.isoformat()))
    else:
        tagged = tagged.filter(F.col("memory_date").between(F.lit(first), F.lit(last)))
    if len(spans) == 1:
        return tagged
    return tagged.filter(F.expr(f"week_id IN ({', '.join(repr(week) for week in _ids(spans))})"))  # a literal each takes seconds


def archive_weeks(store: dict[str, DataFrame], weeks: list[str] | None = None,
                  present: DataFrame | None = None, overwrite: bool = False) -> dict[str, DataFrame]:
    """Archive tables of the weeks. Agent-weeks in `present` are skipped unless `overwrite`."""
    out = {}
    for table, df in store.items():
        rows = _in_weeks(df, table, weeks)
        if present is not None and not overwrite:
            rows = rows.join(present.select("agent_id", "week_id"), ["agent_id", "week_id"], "left_anti")
        out[table] = rows
    return out


def members(archive: dict[str, DataFrame]) -> DataFrame:
    """One row per archived day artefact: its kind and date."""
    kinds = {"l1_days": F.lit("l1"), "l2_days": F.lit("l2"), "day_markers": F.col("marker"),
             "l0_index": F.lit("l0_index"), "l0_embeddings": F.lit("l0_embedding")}
    rows = None
    for table, kind in kinds.items():
        if table not in archive:
            continue
        part = archive[table].select("agent_id", "week_id", kind.alias("kind"), _day(table).alias("memory_date"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def manifest(archive: dict[str, DataFrame]) -> DataFrame:
    """Per agent-week: window and sorted lists of what was archived. A week has at most seven days of each kind."""
    def dates(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("memory_date").cast("string"))))

    return members(archive).groupBy("agent_id", "week_id").agg(
        F.count_if(~F.col("kind").startswith("l0_")).alias("file_count"),
        *[dates(kind).alias(f"{kind}_dates") for kind in
          ("l1", "l2", "nocontent", "noconversation", "l0_index", "l0_embedding")]).select(
        "agent_id", "week_id", timeaxis.week_monday(F.col("week_id")).alias("window_start"),
        timeaxis.week_sunday(F.col("week_id")).alias("window_end"), "file_count",
        "l1_dates", "l2_dates", "nocontent_dates", "noconversation_dates", "l0_index_dates", "l0_embedding_dates")


def mark_status(days: DataFrame, keys: DataFrame, flag: str) -> DataFrame:
    """Set a status flag, with its time, on the days in `keys`."""
    marked = keys.select(*DAY).distinct().withColumn("_hit", F.lit(True))
    status = F.coalesce("status", F.from_json(F.lit("{}"), days.schema["status"].dataType))
    changed = status.withField(flag, F.lit(True)).withField(f"{flag}_at", F.current_timestamp())
    return (days.join(marked, DAY, "left")
            .withColumn("status", F.when(F.col("_hit"), changed).otherwise(F.col("status"))).drop("_hit")
            .select(days.columns))


def archive_and_mark(store: dict[str, DataFrame], weeks: list[str], present: DataFrame | None = None,
                     overwrite: bool = False) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Archive weeks and return the archive with the store whose archived days carry the flag."""
    archive = archive_weeks(store, weeks, present, overwrite)
    marked = dict(store)
    for table in ("l1_days", "l2_days"):
        marked[table] = mark_status(store[table], archive[table], "archived")
    return archive, marked


def select_for_restore(archive: dict[str, DataFrame], *, week: str | None = None, on: date | None = None,
                       levels: tuple[str, ...] = LEVELS) -> dict[str, DataFrame]:
    """Archived rows of one week or one day, limited to levels.

    Thin-day markers come with index or summary level, no-conversation markers always.
    """
    if (week is None) == (on is None):
        raise ValueError("give a week or a date")
    unknown = set(levels) - set(LEVELS)
    if unknown:
        raise ValueError(f"unknown levels {sorted(unknown)}")
    wanted = {"l0_index": "l0" in levels, "l0_embeddings": "l0" in levels, "l1_days": "l1" in levels,
              "l2_days": "l2" in levels, "turns": "l2" in levels, "day_markers": True}
    out = {}
    for table, df in archive.items():
        if not wanted[table]:
            continue
        if on is not None:
            year, number, _ = on.isocalendar()
            df = df.filter((F.col("week_id") == f"{year}-W{number:02d}") & (_day(table) == F.lit(on)))
        else:
            df = df.filter(F.col("week_id") == week)
        if table == "day_markers" and not {"l0", "l1"} & set(levels):
            df = df.filter("marker = 'noconversation'")
        out[table] = df
    return out


def restore(store: dict[str, DataFrame], selected: dict[str, DataFrame], mode: str = "mirrored") -> dict[str, DataFrame]:
    """Bring selected rows back.

    `mirrored` returns them as a store of their own; `update` adds what is
    missing; `overwrite` replaces. The latter two flag the restored days. Turns
    follow their day: a day is restored as a whole or not at all.
    """
    restored = dict(store) if mode != "mirrored" else {}
    for table, archived in selected.items():
        rows = archived.drop("week_id")
        if mode == "mirrored":
            restored[table] = rows
            continue
        live = store[table]
        if table == "turns":
            days = store["l2_days"]
            if mode == "update":
                restored[table] = live.unionByName(rows.join(days.select(*DAY), DAY, "left_anti"))
            else:
                restored[table] = rows.unionByName(live.join(rows.select(*DAY).distinct().unionByName(
                    selected["l2_days"].select(*DAY)).distinct(), DAY, "left_anti"))
            continue
        merged = restore_merge(live, rows, KEYS[table], mode)
        if table in ("l1_days", "l2_days"):
            applied = rows if mode == "overwrite" else rows.join(live.select(*DAY), DAY, "left_anti")
            merged = mark_status(merged, applied, "restored")
        restored[table] = merged
    return restored


def restore_report(store: dict[str, DataFrame], selected: dict[str, DataFrame], mode: str) -> DataFrame:
    """Per agent: how many day artefacts and index rows apply, how many conflict, and the outcome."""
    files, index = None, None
    for table in ("l1_days", "l2_days", "day_markers", "l0_index", "l0_embeddings"):
        if table not in selected:
            continue
        keys = KEYS[table]
        hit = store[table].select(*keys).withColumn("_hit", F.lit(True))
        part = selected[table].select(*keys).join(hit, keys, "left").select(
            "agent_id", F.lit(table.startswith("l0_")).alias("is_index"),
            (F.col("_hit").isNotNull() & F.lit(mode == "update")).alias("blocked"))
        files = part if files is None else files.unionByName(part)
    counts = files.groupBy("agent_id").agg(
        F.count_if(~F.col("is_index") & ~F.col("blocked")).alias("restored_files"),
        F.count_if(~F.col("is_index") & F.col("blocked")).alias("file_conflicts"),
        F.count_if(F.col("is_index") & ~F.col("blocked")).alias("restored_index_rows"))
    applied = F.col("restored_files") + F.col("restored_index_rows")
    return counts.withColumn("status", F.when(applied == 0, "skipped").when(
        F.col("file_conflicts") > 0, "partial").otherwise("restored"))
