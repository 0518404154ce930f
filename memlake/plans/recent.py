"""The view of the last few days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import scores as sc, text as tx
from memlake.settings import DEFAULTS, Settings

# --- fixed values: headings and placeholders ----------------------------------------
OVERVIEW = "### 最近记忆概览"
NO_SUMMARY = "（无摘要）"
SUMMARY_LABEL = "摘要："
SECTION_LABELS = {"topics": "主题：", "key_items": "关键事项：", "decisions": "决策：", "todos": "待办："}
# --------------------------------------------------------------------------------------


def field_tier(days: int) -> set[str]:
    """Fields shown, by length of the view: all, topics only, or just the summary."""
    if days <= 0:
        raise ValueError("the number of days must be positive")
    if days <= 3:
        return {"summary", "topics", "decisions", "todos", "key_items"}
    return {"summary", "topics"} if days <= 7 else {"summary"}


def recent_days(agents: DataFrame, l1_days: DataFrame, days: int = DEFAULTS.recent_days) -> DataFrame:
    """The `days` days before each agent's `today`, newest first, with `missing` where no L1 row exists.

    `agents` has `agent_id` and `today`. Only the needed dates of L1 are joined.
    """
    shown = field_tier(days)
    wanted = agents.select("agent_id", "today", F.posexplode(F.sequence(
        F.date_sub("today", 1), F.date_sub("today", days), F.expr("interval -1 day"))).alias("offset", "memory_date"))
    empty = F.array().cast("array<string>")

    def lines(name: str, render) -> Column:
        if name not in shown:
            return empty.alias(name)
        texts = F.filter(F.transform(name, render), lambda t: t != "")
        return F.coalesce(texts, empty).alias(name)

    view = l1_days.select(
        "agent_id", "memory_date", F.coalesce(tx.strip(F.col("summary")), F.lit("")).alias("summary"),
        lines("topics", lambda t: sc.render_topic(tx.strip(t["name"]), tx.strip(t["detail"]))),
        lines("key_items", lambda k: sc.render_key_item(tx.strip(k["type"]), tx.strip(k["desc"]))),
        lines("decisions", lambda d: tx.strip(d)), lines("todos", lambda d: tx.strip(d)),
        F.lit(True).alias("_found"))
    joined = wanted.join(view, ["agent_id", "memory_date"], "left")
    return joined.withColumn("missing", F.col("_found").isNull()).drop("_found")


def _shortened(text: Column, room: Column) -> Column:
    """A text in at most `room` characters, with an ellipsis for what is missing."""
    head = F.regexp_replace(F.left(text, room - 1), r"(?U)\s+$", "")
    return (F.when(F.length(text) <= room, text).when(room > 1, F.concat(head, F.lit("…")))
            .otherwise(F.left(F.lit("…"), room)))


def _lines(days: Column) -> Column:
    """All lines of a page as (kind, text), days newest first."""
    def line(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    def about(day: Column) -> Column:
        return F.when(day["summary"] == "", F.lit(NO_SUMMARY)).otherwise(day["summary"])

    def details(day: Column) -> Column:
        head = F.array(line("detail", F.concat(F.lit("["), day["date"], F.lit("]"))),
                       line("summary", F.concat(F.lit(SUMMARY_LABEL), about(day))))
        parts = [F.when(F.size(day[name]) > 0, F.concat(
            F.array(line("detail", F.lit(label))),
            F.transform(day[name], lambda t: line("detail", F.concat(F.lit("- "), t)))))
            .otherwise(F.array().cast("array<struct<kind:string,text:string>>")) for name, label in SECTION_LABELS.items()]
        return F.concat(head, *parts)

    overview = F.transform(days, lambda d: line("overview", F.concat(F.lit("- "), d["date"], F.lit(": "), about(d))))
    return F.concat(F.array(line("title", F.lit(OVERVIEW))), overview, F.flatten(F.transform(days, details)))


def _page(lines: Column, limit: int) -> Column:
    """Lines that fit into `limit` characters.

    The overview and the details each end at their first line that does not fit;
    a title that does not fit ends the page. Of a title or a summary that does
    not fit, its beginning is shown.
    """
    def add(page: Column, line: Column) -> Column:
        empty = page["text"] == ""
        longer = F.when(empty, line["text"]).otherwise(F.concat_ws("\n", page["text"], line["text"]))
        room = F.when(empty, F.lit(limit)).otherwise(F.lit(limit - 1) - F.length(page["text"]))
        listed = line["kind"] == "overview"
        closed = F.when(listed, page["listed"]).otherwise(page["done"])
        fits = F.length(longer) <= limit
        short = _shortened(line["text"], room)
        partly = line["kind"].isin("title", "summary") & (room > 0)
        text = (F.when(closed, page["text"]).when(fits, longer)
                .when(partly, F.when(empty, short).otherwise(F.concat_ws("\n", page["text"], short))).otherwise(page["text"]))
        ended = ~closed & ~fits
        return F.struct(text.alias("text"),
                        (page["listed"] | ended & (listed | (line["kind"] == "title"))).alias("listed"),
                        (page["done"] | ended & ~listed).alias("done"))

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("listed"), F.lit(False).alias("done"))
    return F.aggregate(lines, start, add, lambda page: tx.strip(page["text"]))


def recall_recent(agents: DataFrame, l1_days: DataFrame, days: int = DEFAULTS.recent_days,
                  settings: Settings = DEFAULTS) -> DataFrame:
    """Recent view per agent: text, found and missing dates. An agent has `days` rows, set by the caller."""
    view = recent_days(agents, l1_days, days)
    day = F.struct("offset", F.col("memory_date").alias("day"), F.col("memory_date").cast("string").alias("date"), "summary",
                   *SECTION_LABELS, "missing")
    grouped = view.groupBy("agent_id").agg(F.array_sort(F.collect_list(day)).alias("_days"))
    found = F.filter("_days", lambda d: ~d["missing"])
    dates = lambda days: F.sort_array(F.transform(days, lambda d: d["day"]), asc=False)
    return grouped.select(
        "agent_id", dates(found).alias("found_dates"),
        dates(F.filter("_days", lambda d: d["missing"])).alias("missing_dates"),
        _page(_lines(found), max(1, settings.max_chars)).alias("assembled_text"))
