"""Upserts, ordered unions and deletes on plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

L1_FIELDS = ["memory_signal", "summary", "tags", "day_mood", "topics", "decisions", "todos", "key_items",
             "emotional_peaks", "compress_hints"]
STAT_FIELDS = ["total_turns", "user_turns", "assistant_turns", "tools_called_count"]


def union_distinct(existing: DataFrame, incoming: DataFrame, columns: list[str], position: str) -> DataFrame:
    """Concatenation without repeats: a record present before keeps its place.

    Records are equal when all `columns` are. The result carries `origin` (0 for
    existing, 1 for incoming) and the position of the first occurrence, which
    together give the order.
    """
    both = (existing.select(*columns, position).withColumn("origin", F.lit(0))
            .unionByName(incoming.select(*columns, position).withColumn("origin", F.lit(1))))
    first = F.min(F.struct("origin", position)).alias("_first")
    return both.groupBy(*columns).agg(first).select(
        *columns, F.col("_first.origin").alias("origin"), F.col(f"_first.{position}").alias(position))


def _paired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    old = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_old"))
    new = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("_new"))
    return old.join(new, keys, "full_outer")


def upsert(old: DataFrame, new: DataFrame, keys: list[str],
           carried: dict[str, Column] | None = None) -> DataFrame:
    """Replace rows by key, keep the others; `new` holds each key once.

    `carried` gives values that survive a replacement as expressions over the
    structs `_old` and `_new`.
    """
    fields = [c for c in old.columns if c not in keys]
    carried = carried or {}
    return _paired(old, new, keys).select(*keys, *[
        F.when(F.col("_new").isNull(), F.col(f"_old.{c}"))
         .otherwise(carried[c] if c in carried else F.col(f"_new.{c}")).alias(c) for c in fields])


def anchor_text(depth: Column, time_key: Column, window_start: Column) -> Column:
    return F.when(depth == "surface", time_key).otherwise(F.coalesce(F.nullif(window_start, F.lit("")), time_key))


def order_index(index: DataFrame, last: str = "surface") -> DataFrame:
    """Add `ord_key`, a sortable text that puts an agent's index rows in file order.

    Which order holds depends on the kind of the last update: a day update sorts
    by date, where rows of weeks and windows have none and come first; a rollup
    sorts by start of period, wider periods first.
    """
    depth = F.col("depth")
    anchor = anchor_text(depth, F.col("time_key"), F.col("window_date_start"))
    if last == "surface":
        anchor = F.when(depth == "surface", F.col("time_key")).otherwise("")
        priority = F.lit("0")
    elif last == "shallow":
        anchor = F.when(depth == "deep", "").otherwise(anchor)
        priority = F.when(depth == "shallow", "0").otherwise("1")
    else:
        priority = F.when(depth == "deep", "0").when(depth == "shallow", "1").otherwise("2")
    return index.withColumn("ord_key", F.concat_ws("|", anchor, priority, depth, "time_key"))


def upsert_index(old: DataFrame, new: DataFrame, last: str = "surface") -> DataFrame:
    """Replace index rows by (agent, depth, time key), keep their access count, sort anew."""
    keys = ["agent_id", "depth", "time_key"]
    columns = [c for c in old.columns if c != "ord_key"]
    merged = upsert(old.select(columns), new, keys, carried={
        "access_count": F.coalesce(F.col("_old.access_count"), F.lit(0).cast("bigint"))})
    return order_index(merged, last)


def upsert_embeddings(old: DataFrame, index: DataFrame, embed, depth: str | None = None) -> DataFrame:
    """Bring vectors up to date with the index, calling `embed` only for changed texts.

    `index` has `text_used`. A day run (`depth` None) looks at every row, a
    rollup run only at its own depth. `embed` takes a DataFrame with `text_used`
    and adds `embedding`.
    """
    keys = ["agent_id", "depth", "time_key"]
    wanted = index.select(*keys, "text_used").filter(F.col("text_used") != "")
    if depth is not None:
        wanted = wanted.filter(F.col("depth") == depth)
    changed = wanted.join(old.select(*keys, "text_used"), [*keys, "text_used"], "left_anti")
    return upsert(old, embed(changed).select(old.columns), keys)


def upsert_sessions(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """Register sessions per day once; the earliest sighting stays."""
    return (registry.unionByName(seen).groupBy("agent_id", "memory_date", "session_id")
            .agg(F.min("first_seen").alias("first_seen")))


def merge_session_archive(archive: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union dates and files of a session, keep the earliest sighting and the newest archive time."""
    old, new = F.col("_old"), F.col("_new")
    empty = F.array().cast("array<string>")
    files = F.concat(F.coalesce(old["archived_files"], empty), F.coalesce(new["archived_files"], empty))
    dates = F.concat(F.coalesce(old["dates"], F.array().cast("array<date>")),
                     F.coalesce(new["dates"], F.array().cast("array<date>")))
    return _paired(archive, incoming, ["agent_id", "session_id"]).select(
        "agent_id", "session_id",
        F.array_sort(F.array_distinct(dates)).alias("dates"),
        F.least(old["first_seen_min"], new["first_seen_min"]).alias("first_seen_min"),
        F.array_distinct(F.filter(files, lambda f: f != "")).alias("archived_files"),
        F.coalesce(new["archived_at"], old["archived_at"]).alias("archived_at"))


def merge_days(existing: DataFrame, incoming: DataFrame, add_stats: bool = False) -> DataFrame:
    """Fold newly extracted day rows into existing ones.

    Filled summary fields and the status of an existing day stay. Counts come
    from `incoming`, which is computed over the merged turns, so folding the same
    day in twice changes nothing; `add_stats` adds both counts instead, for
    callers whose `incoming` covers only the late turns.
    """
    keys = ["agent_id", "memory_date"]
    old, new = F.col("_old"), F.col("_new")
    columns = []
    for name in existing.columns:
        if name in keys:
            continue
        if name in STAT_FIELDS:
            total = F.coalesce(old[name], F.lit(0)) + F.coalesce(new[name], F.lit(0))
            columns.append((total if add_stats else F.coalesce(new[name], old[name])).alias(name))
        elif name in L1_FIELDS or name == "status":
            columns.append(F.coalesce(old[name], new[name]).alias(name))
        else:
            columns.append(F.coalesce(new[name], old[name]).alias(name))
    return _paired(existing, incoming, keys).select(*keys, *columns)


def restore_merge(live: DataFrame, archived: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """Bring archived rows back: `update` only adds, `overwrite` replaces."""
    if mode == "update":
        return live.unionByName(archived.join(live.select(keys), keys, "left_anti"))
    if mode == "overwrite":
        return archived.unionByName(live.join(archived.select(keys), keys, "left_anti"))
    if mode == "mirrored":
        return archived
    raise ValueError(f"unknown restore mode {mode!r}")


def prune(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(doomed.select(keys), keys, "left_anti")


def register_weeks(registered: DataFrame, weeks: DataFrame) -> DataFrame:
    """Weeks that wait for the next multi-week rollup, each once."""
    return registered.select("agent_id", "week").union(weeks.select("agent_id", "week")).distinct()


def without(df: DataFrame, *others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in none of the others."""
    return reduce(lambda left, right: left.join(right.select(keys), keys, "left_anti"), others, df)
