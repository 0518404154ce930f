"""Message tables: relational `messages` and `sessions` with epoch-second timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.functions import text as tx

# --- fixed value: start of the note that opens a compacted session -----------------
COMPACTION_MARKER = "[CONTEXT COMPACTION"
# --- fixed values: which tools count as what ----------------------------------------
READ_TOOLS = ("read", "read_file")
WRITE_TOOLS = ("write", "write_file", "edit")
COMMAND_TOOLS = ("terminal", "exec")
# -------------------------------------------------------------------------------------
COMMAND_LENGTH = 200


def read_tables(spark: SparkSession, messages_path: str, sessions_path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(messages_path), spark.read.parquet(sessions_path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str = "id", parts: int = 64,
              bounds: tuple[int, int] = (0, 1 << 40), properties: dict[str, str] | None = None) -> DataFrame:
    """A message table over JDBC, read in parallel ranges of its id."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
                           numPartitions=parts, properties=properties or {})


def join_messages(messages: DataFrame, sessions: DataFrame, start: float | None = None,
                  end: float | None = None) -> DataFrame:
    """User and assistant messages with text, joined to their session.

    `messages`: id, session_id, role, content, timestamp (epoch seconds).
    `sessions`: id, source, title, parent_session_id. The range is half open.
    """
    kept = messages.filter(F.col("role").isin("user", "assistant") & F.col("content").isNotNull()
                           & (F.trim("content") != ""))
    if start is not None:
        kept = kept.filter(F.col("timestamp") >= start)
    if end is not None:
        kept = kept.filter(F.col("timestamp") < end)
    facts = sessions.select(F.col("id").alias("session_id"), F.col("source").alias("session_source"),
                            F.col("title").alias("session_title"), "parent_session_id")
    return kept.join(facts, "session_id").withColumnRenamed("id", "message_id")


def drop_compaction_replay(messages: DataFrame) -> DataFrame:
    """In continued sessions, drop everything up to and including the first compaction note.

    The note's place is a small aggregate per session, joined back, so a long
    session is never ordered in one task.
    """
    marked = messages.filter(
        (F.coalesce(F.trim("parent_session_id"), F.lit("")) != "") & (F.col("role") == "assistant")
        & F.ltrim(F.col("content"), F.lit(tx.WHITESPACE)).startswith(COMPACTION_MARKER))
    notes = marked.groupBy("session_id").agg(F.min(F.struct("timestamp", "message_id")).alias("_note"))
    return (messages.join(notes, "session_id", "left")
            .filter(F.col("_note").isNull() | (F.struct("timestamp", "message_id") > F.col("_note")))
            .drop("_note"))


def clean_messages(messages: DataFrame) -> DataFrame:
    return (messages.withColumn("content", tx.redact(tx.strip(F.col("content"))))
            .filter(F.col("content") != "")
            .withColumn("ts", F.timestamp_seconds("timestamp"))
            .withColumn("message_type", F.lit("text")))


def tool_calls(messages: DataFrame) -> DataFrame:
    """One row per named tool call in the `tool_calls` JSON (an object or a list) of assistant rows."""
    parsed = F.try_parse_json("tool_calls")
    kind = F.schema_of_variant(parsed)
    calls = (F.when(kind.startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>"))
              .when(kind.startswith("OBJECT"), F.array(parsed)))
    rest = [c for c in messages.columns if c != "tool_calls"]
    exploded = (messages.filter((F.col("role") == "assistant") & F.col("tool_calls").isNotNull())
                .select(*rest, F.posexplode(calls).alias("call_pos", "_call")))

    def get(path: str) -> Column:
        return F.try_variant_get("_call", path, "string")

    name = F.coalesce(F.nullif(tx.strip(get("$.name")), F.lit("")), tx.strip(get("$.function.name")), F.lit(""))
    raw = F.coalesce(F.try_variant_get("_call", "$.arguments", "variant"),
                     F.try_variant_get("_call", "$.function.arguments", "variant"))
    unpacked = F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(
        F.try_variant_get(raw, "$", "string"))).otherwise(raw)
    arguments = F.try_variant_get(unpacked, "$", "map<string,string>")
    return (exploded.select(*rest, "call_pos", name.alias("tool_name"), arguments.alias("arguments"))
            .filter("tool_name != ''"))


def classify_tool_call(calls: DataFrame, from_log: bool = False) -> DataFrame:
    """Add `kind` (files_read, files_written, commands_run) and the `item` it touched.

    Message logs know fewer tool names, and their commands are redacted.
    """
    tool = F.lower("tool_name")
    readers, writers, runners = (("read",), ("write", "edit"), ("exec",)) if from_log else (
        READ_TOOLS, WRITE_TOOLS, COMMAND_TOOLS)

    def argument(name: str) -> Column:
        return F.nullif(F.try_element_at("arguments", F.lit(name)), F.lit(""))

    path = F.coalesce(argument("file_path"), argument("path"))
    command = argument("command") if from_log else F.nullif(tx.strip(argument("command")), F.lit(""))
    short = F.when(F.length(command) > COMMAND_LENGTH,
                   F.concat(F.left(command, F.lit(COMMAND_LENGTH)), F.lit("..."))).otherwise(command)
    if from_log:
        short = tx.redact(short)
    kind = (F.when(tool.isin(*readers) & path.isNotNull(), "files_read")
             .when(tool.isin(*writers) & path.isNotNull(), "files_written")
             .when(tool.isin(*runners) & command.isNotNull(), "commands_run"))
    return calls.withColumn("kind", kind).withColumn(
        "item", F.when(kind == "commands_run", short).when(kind.isNotNull(), path))
