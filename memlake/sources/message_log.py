"""Message logs: one JSON document per line, one file per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from memlake.functions import text as tx
from memlake.functions.documents import parse_strict

BLOCKS = "array<struct<type:string,text:string,name:string,arguments:map<string,string>>>"


def _text(document: str | Column, path: str) -> Column:
    return F.try_variant_get(document, path, "string")


def _blocks(content: Column) -> Column:
    """Content as blocks: a list of blocks as it is, a plain text as one text block."""
    nothing = F.lit(None)
    as_list = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.struct(
        _text(b, "$.type").alias("type"), _text(b, "$.text").alias("text"), _text(b, "$.name").alias("name"),
        F.try_variant_get(b, "$.arguments", "map<string,string>").alias("arguments")))
    single = F.array(F.struct(
        F.lit("text").alias("type"), _text(content, "$").alias("text"), nothing.cast("string").alias("name"),
        nothing.cast("map<string,string>").alias("arguments")))
    kind = F.schema_of_variant(content)
    empty = F.array().cast("array<struct<type:string,text:string,name:string,arguments:map<string,string>>>")
    return F.when(kind.startswith("ARRAY"), as_list).when(kind == "STRING", single).otherwise(empty)


def check_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Every line with what it holds (`ts`, `role`, `blocks`) and its first `problem`.

    Problems: `blank`, `unparsable` (no JSON), `other_type` (no message record),
    `no_time` (unreadable timestamp), `tool_result`; null for messages. Other
    columns of `lines` and the line itself are kept.
    """
    rest = [c for c in lines.columns if c != value]
    parsed = lines.select(*rest, value, parse_strict(tx.strip(F.col(value))).alias("_d"))
    fields = parsed.select(
        *rest, value, F.col("_d").isNull().alias("_broken"), _text("_d", "$.type").alias("_type"),
        F.try_to_timestamp(_text("_d", "$.timestamp")).alias("ts"),
        F.coalesce(_text("_d", "$.message.role"), F.lit("unknown")).alias("role"),
        F.try_variant_get("_d", "$.message.content", "variant").alias("_content"))
    problem = (F.when(F.coalesce(tx.strip(F.col(value)), F.lit("")) == "", "blank").when(F.col("_broken"), "unparsable")
                .when(~F.coalesce(F.col("_type") == "message", F.lit(False)), "other_type")
                .when(F.col("ts").isNull(), "no_time").when(F.col("role") == "toolResult", "tool_result"))
    blocks = F.coalesce(_blocks(F.col("_content")), F.array().cast(BLOCKS))
    return fields.select(*rest, value, "ts", "role", blocks.alias("blocks"), problem.alias("problem"))


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Raw messages from JSON lines.

    Blank and broken lines, other record types, unreadable timestamps and tool
    results are skipped (`check_log_lines` says which). Other columns of `lines`
    are kept.
    """
    return check_log_lines(lines, value).filter("problem is null").drop(value, "problem")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the session files under `path`, laid out as `<agent>/<session file>`.

    Of several files of a session only the current version is read. Lines carry
    their file, the byte at which their block of the file begins (`file_block`)
    and `line_id`, which orders the lines of a block.
    """
    # Listing reads no file content: only the path column of the binary source is selected.
    paths = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name")))
    chosen = resolve_session_version(paths).select(
        "file_path", "session_id", F.element_at(F.split("file_path", "/"), -2).alias("agent_id"))
    lines = (spark.read.text(path, recursiveFileLookup=True)
             .select("value", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_block_start").alias("file_block"),
                     F.monotonically_increasing_id().alias("line_id")))
    return lines.join(chosen, "file_path")


def read_message_log(spark: SparkSession, path: str) -> DataFrame:
    """Messages of all session files under `path` (see `read_log_lines`).

    Their position (`file_block`, `line_id`) orders messages with equal timestamps.
    """
    return parse_log_lines(read_log_lines(spark, path)).drop("file_path")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The lines that `read_message_log` leaves out, with their problem and place.

    A line is found again by its file, the byte where its block begins and its
    number in the block, from 0. Messages and quarantined lines together are all
    lines.
    """
    checked = check_log_lines(read_log_lines(spark, path))
    first = checked.groupBy("file_path", "file_block").agg(F.min("line_id").alias("_first"))
    return checked.filter("problem is not null").join(first, ["file_path", "file_block"]).select(
        "agent_id", "session_id", "file_path", "file_block", (F.col("line_id") - F.col("_first")).alias("line_in_block"), "problem", "value")


def resolve_session_version(files: DataFrame) -> DataFrame:
    """Pick one file per session folder: `<id>.jsonl` if there is one, else the last-named reset version."""
    name = F.col("file_name")
    session = F.when(name.contains(".reset."), F.substring_index(F.substring_index(name, ".reset.", 1), ".jsonl", 1)) \
               .when(name.endswith(".jsonl"), F.regexp_replace(name, r"\.jsonl$", ""))
    folder = F.regexp_replace("file_path", r"/[^/]*$", "")
    known = files.withColumn("session_id", session).filter("session_id is not null").withColumn("_folder", folder)
    best = Window.partitionBy("_folder", "session_id").orderBy(F.desc(~name.contains(".reset.")), F.desc("file_name"))
    return known.withColumn("_pick", F.row_number().over(best)).filter("_pick = 1").drop("_pick", "_folder")


def clean_messages(messages: DataFrame) -> DataFrame:
    """Messages with text, as cleaned and redacted turns."""
    cleaned = messages.filter(F.col("role").isin("user", "assistant")).withColumn(
        "_c", tx.join_text_blocks(F.col("blocks"), F.col("role")))
    return (cleaned.filter(F.col("_c.content") != "")
            .select(*[c for c in messages.columns if c != "blocks"], "_c.content", "_c.message_type"))


def log_tool_calls(messages: DataFrame) -> DataFrame:
    """One row per tool call found in message blocks."""
    call = F.explode(F.filter("blocks", lambda b: b["type"] == "toolCall")).alias("_b")
    return messages.select(*[c for c in messages.columns if c != "blocks"], call).select(
        *[c for c in messages.columns if c != "blocks"],
        F.coalesce("_b.name", F.lit("")).alias("tool_name"), F.col("_b.arguments").alias("arguments"))


def sessions_for_day(registry: DataFrame, archive: DataFrame) -> DataFrame:
    """Sessions to read per agent and day: live rows where the day is registered, else archived ones."""
    live = registry.select("agent_id", "memory_date", "session_id", "first_seen", F.lit("live").alias("copy"))
    stored = archive.select("agent_id", F.explode("dates").alias("memory_date"), "session_id",
                            F.col("first_seen_min").alias("first_seen"), F.lit("archive").alias("copy"))
    days = registry.select("agent_id", "memory_date").distinct()
    return live.unionByName(stored.join(days, ["agent_id", "memory_date"], "left_anti"))


def unregistered_sessions(current: DataFrame, registry: DataFrame) -> DataFrame:
    """Current sessions missing from their day's registry, as alert rows."""
    keys = ["agent_id", "memory_date", "session_id"]
    return current.select(*keys).join(registry.select(*keys), keys, "left_anti")
