"""The daily write: chunks, per-chunk and per-day summaries, index rows and counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from memlake import schemas
from memlake.functions import documents, let, text as tx
from memlake.operators.landmarks import count_documents
from memlake.operators.merging import upsert
from memlake.operators.ranking import top_k
from memlake.session import materialize, plain_unions
from memlake.settings import DEFAULTS, Settings

DAY = ["agent_id", "memory_date"]
CHUNK = [*DAY, "chunk_id"]

# --- fixed values ---------------------------------------------------------------------
LOW_SIGNAL_MAX_TURNS = 8
LOW_SIGNAL_SUMMARY = "当天有对话，但缺乏可沉淀的实质内容，不生成正式记忆。"
# Limits of one day summary: characters of a text, and counts of topics and tags. Decisions, todos, key items, peaks and
# source turns have no count limit.
LIMITS = {"topics": 8, "topic_name": 20, "topic_detail": 120, "decisions": 100, "todos": 100, "summary": 120,
          "key_item": 150, "tags": 10, "mood": 20, "peak": 100}
# -----------------------------------------------------------------------------------------

# Words by which the built-in extractive summariser tells sentences apart.
CUES = {
    "decision": r"(?iU)\b(decided?|agreed|we will|let's use)\b|决定|确定",
    "todo": r"(?iU)\b(todo|to-do|need to|must|should)\b|待办|需要",
    "milestone": r"(?iU)\b(released?|launched|completed|shipped)\b|完成|发布",
    "bug_fix": r"(?iU)\b(fixed|bug|patch(ed)?)\b|修复",
    "config_change": r"(?iU)\b(config(ured)?|setting|enabled|disabled)\b|配置",
    "incident": r"(?iU)\b(outage|incident|crash(ed)?|failure)\b|故障",
}

Summariser = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def l1_skeleton(stats: DataFrame) -> DataFrame:
    """L1 rows before they are summarised: counts, an initial status and empty fields."""
    from memlake.plans.extract import initial_status

    filled = {"memory_signal": F.lit("normal"), "status": initial_status()}
    have = set(stats.columns)
    fields = []
    for part in _columns(stats.sparkSession, schemas.L1_DAYS):
        if part.name in have:
            fields.append(F.col(part.name))
        else:
            fields.append(filled.get(part.name, F.lit(None)).cast(part.dataType).alias(part.name))
    return stats.select(*fields)


def _columns(spark, ddl: str):
    return spark.createDataFrame([], ddl).schema.fields


# --- per-chunk summaries ------------------------------------------------------------------

def sentences(fragments: DataFrame) -> DataFrame:
    """One row per sentence of each fragment."""
    parts = F.posexplode(F.split("text", r"(?<=[.!?。！？])\s*|\n+")).alias("sentence_pos", "sentence")
    return (fragments.select(*CHUNK, "turn_index", "from_char", "role", parts)
            .withColumn("sentence", tx.strip(F.col("sentence"))).filter("sentence != ''"))


def infer_map(fragments: DataFrame, summariser: Summariser | None = None, parallel: int | None = None) -> DataFrame:
    """A structured summary per chunk.

    With `summariser`, chunks go to it in Arrow batches: each row has the chunk
    key and `fragments`, an array that the token budget bounds; it returns the
    key and `raw`, the JSON text the model wrote. Without one, summaries are
    extracted by word statistics and cue words.
    """
    if summariser is None:
        return extract_summaries(fragments)
    packed = fragments.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(
        F.struct("turn_index", "from_char", "hhmm", "role", "text"))).alias("fragments"))
    if parallel:
        packed = packed.repartition(parallel, *CHUNK)
    return packed.mapInPandas(summariser, "agent_id string, memory_date date, chunk_id bigint, raw string")


def extract_summaries(fragments: DataFrame) -> DataFrame:
    """Extractive summary rows: one row per found item, with its `kind` and order.

    Kept as rows so that nothing is collected before limits are applied.
    """
    spoken = sentences(fragments)
    def at(sentence: Column) -> Column:
        return F.struct(F.col("turn_index").cast("bigint").alias("turn"), F.coalesce("from_char", F.lit(0)).cast("bigint").alias("char"),
                        sentence.cast("bigint").alias("sentence"))

    cut = lambda n: F.left(F.col("sentence"), F.lit(n))
    cue = {name: F.col("sentence").rlike(pattern).alias(f"_{name}") for name, pattern in CUES.items()}
    # Each pattern is tried once on a sentence, and all that is found in it comes of the same pass.
    marked = spoken.select(*CHUNK, "turn_index", "from_char", "sentence_pos", "sentence", F.struct(*cue.values()).alias("_cue"),
                           F.regexp_count("sentence", F.lit("[!！]")).alias("_calls"))
    hit = lambda name: F.col(f"_cue._{name}")
    item_type = F.coalesce(*[F.when(hit(t), F.lit(t)) for t in
                             ("milestone", "bug_fix", "config_change", "incident", "decision")],
                           F.when(F.col("sentence").rlike("[?？]"), F.lit("question")))

    def found(kind: Column | str, value: Column, weight: Column, when: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.when(when, F.struct(kind.alias("kind"), value.alias("value"), weight.cast("bigint").alias("weight")))

    findings = F.filter(F.array(
        found("summary", cut(LIMITS["summary"]), F.lit(0), F.col("sentence_pos") == 0),
        found("decision", cut(LIMITS["decisions"]), F.lit(0), hit("decision")),
        found("todo", cut(LIMITS["todos"]), F.lit(0), hit("todo")),
        found("peak", cut(LIMITS["peak"]), F.least(F.lit(5), F.lit(2) + F.col("_calls")), F.col("_calls") > 0),
        found(F.concat(F.lit("item:"), item_type), cut(LIMITS["key_item"]), F.lit(0), item_type.isNotNull())), lambda x: x.isNotNull())
    rows = marked.select(*CHUNK, "turn_index", F.explode(findings).alias("_x"), at(F.col("sentence_pos")).alias("place")).select(
        *CHUNK, "turn_index", "_x.*", "place")
    words = spoken.select(*CHUNK, "turn_index", "from_char", "sentence_pos", "sentence",
                          F.explode(tx.match_tokens(F.col("sentence"))).alias("word")).filter(F.length("word") >= 4)
    # One row per word of a chunk, with its count and the first turn that has it.
    first = F.min(F.struct(at(F.lit(0)).alias("place"), "turn_index", cut(LIMITS["topic_detail"]).alias("detail"))).alias("_f")
    counted = words.groupBy(*CHUNK, "word").agg(F.count(F.lit(1)).alias("weight"), first)
    topics = counted.select(*CHUNK, F.col("_f.turn_index").alias("turn_index"), F.lit("topic").alias("kind"),
                            F.concat_ws("\n", F.left("word", F.lit(LIMITS["topic_name"])), "_f.detail").alias("value"),
                            "weight", F.col("_f.place").alias("place"))
    return topics.unionByName(rows)


# --- per-day summaries ------------------------------------------------------------------------

def low_signal_context(fragments: DataFrame) -> DataFrame:
    """Chunk, turn and user-turn counts per day and whether a low signal is allowed or forced."""
    counts = fragments.groupBy(*DAY).agg(
        F.max("total_chunks").alias("chunks"), F.count(F.lit(1)).alias("turns"),
        F.count_if(F.lower(F.trim("role")) == "user").alias("user_turns"))
    allowed = (F.col("chunks") == 1) & (F.col("turns") <= LOW_SIGNAL_MAX_TURNS)
    return counts.withColumn("low_allowed", allowed).withColumn("low_forced", F.col("user_turns") == 0)


def infer_reduce(found: DataFrame, context: DataFrame) -> DataFrame:
    """Merge chunk findings into one valid summary per day.

    Findings are deduplicated by kind and text with partial aggregation. Topics
    and the summary keep their best few rows per day (a top-k that Spark cuts per
    task before the shuffle); decisions, todos, key items and peaks are all kept,
    as trimming later deletes every turn that no finding points to.
    """
    plain_unions(found.sparkSession)
    name = F.when(F.col("kind") == "topic", F.substring_index("value", "\n", 1)).otherwise(F.col("value"))
    merged = found.groupBy(*DAY, "kind", name.alias("name")).agg(
        F.sum("weight").alias("weight"), F.max("weight").alias("highest"),
        F.min(F.struct("place", "turn_index", "value")).alias("_f"))
    family = F.when(F.col("kind").startswith("item:"), "item").otherwise(F.col("kind"))
    merged = merged.withColumn("family", family)
    ranked = F.col("kind").isin("topic", "summary")
    best = top_k(merged.where(ranked), [*DAY, "family"],
                 [F.desc("weight"), F.col("_f.place"), F.col("kind"), F.col("name")], LIMITS["tags"])
    best = best.drop("rank").unionByName(merged.where(~ranked))
    item = F.struct((-F.col("weight")).alias("order"), F.col("_f.place").alias("place"), "kind", "name", "highest",
                    F.col("_f.value").alias("value"), F.col("_f.turn_index").alias("turn"))

    def family_items(which: str) -> Column:
        items = F.array_sort(F.collect_list(F.when(F.col("family") == which, item)))
        return F.slice(items, 1, 1) if which == "summary" else items

    gathered = best.groupBy(*DAY).agg(*[
        family_items(which).alias(which) for which in ("topic", "summary", "decision", "todo", "item", "peak")])
    texts = lambda c: F.transform(c, lambda x: x["value"])
    detail = lambda v: F.regexp_extract(v, r"(?s)^[^\n]*\n(.*)$", 1)
    topics = F.transform(F.slice("topic", 1, LIMITS["topics"]),
                         lambda x: F.struct(x["name"].alias("name"), detail(x["value"]).alias("detail")))
    peaks = F.transform("peak", lambda x: F.struct(
        x["turn"].alias("turn"), F.lit("emphasis").alias("emotion"), x["highest"].cast("int").alias("intensity"),
        x["value"].alias("context")))
    turns = F.array_sort(F.array_distinct(F.flatten(F.array(*[
        F.transform(c, lambda x: x["turn"]) for c in ("topic", "summary", "decision", "todo", "item", "peak")]))))
    full = {
        "memory_signal": F.lit("normal"), "topics": topics, "decisions": texts("decision"), "todos": texts("todo"),
        "summary": F.coalesce(F.try_element_at("summary", F.lit(1))["value"], F.lit("")),
        "key_items": F.transform("item", lambda x: F.struct(
            F.substring(x["kind"], 6, 20).alias("type"), x["value"].alias("desc"))),
        "tags": F.transform("topic", lambda x: x["name"]),
        "day_mood": F.when(F.size("peak") > 0, "emphatic").otherwise(""),
        "emotional_peaks": peaks, "source_turns": turns}
    joined = context.join(gathered, DAY, "left")
    low = F.col("low_forced") | (F.col("low_allowed") & (F.coalesce(F.size("topic"), F.lit(0)) == 0))
    empty = {"memory_signal": F.lit("low"), "summary": F.lit(LOW_SIGNAL_SUMMARY), "day_mood": F.lit("")}
    fields = _columns(found.sparkSession, schemas.DAY_SUMMARY)
    return joined.select(*DAY, *[
        F.when(low, empty.get(f.name, F.array()).cast(f.dataType)).otherwise(full[f.name].cast(f.dataType)).alias(f.name)
        for f in fields])


def read_model_output(raw: DataFrame, problem: Callable[[Column], Column] = documents.day_summary_problem,
                      column: str = "raw") -> DataFrame:
    """Repair, parse and check model output; adds `method`, `document`, `problem`, `valid`."""
    def checked(repaired: Column) -> Column:
        issue = F.when(repaired["document"].isNull(), "unparsable").otherwise(let(repaired["document"], problem))
        return F.struct(repaired["method"].alias("method"), repaired["document"].alias("document"), issue.alias("problem"))

    parsed = raw.withColumn("_c", let(documents.repair_json(F.col(column)), checked))
    return parsed.select(*raw.columns, "_c.method", "_c.document", "_c.problem").withColumn("valid", F.col("problem").isNull())


def summaries_from_documents(checked: DataFrame) -> DataFrame:
    """Typed day-summary columns of valid documents."""
    keys = [c for c in checked.columns if c in CHUNK]
    shape = checked.sparkSession.createDataFrame([], schemas.DAY_SUMMARY).schema.simpleString()
    whole = F.try_variant_get("document", "$", shape)
    return checked.filter("valid").select(*keys, whole.alias("_s")).select(*keys, "_s.*")


def retry_failed(rows: DataFrame, run: Callable[[DataFrame], DataFrame], retries: int = DEFAULTS.retries) -> DataFrame:
    """Run an inference step, then only its failures again, up to `retries` times.

    `run` returns the key columns of `rows` with `valid`. Every attempt is
    written out, so an attempt that succeeded is never paid for twice.
    """
    keys = [c for c in rows.columns if c in CHUNK]
    result = materialize(run(rows))
    for _ in range(retries):
        failed = result.filter(~F.col("valid")).select(*keys)
        if failed.isEmpty():
            break
        again = materialize(run(rows.join(failed, keys, "left_semi")))
        result = result.filter("valid").unionByName(again)
    return result


def run_outcome(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Per agent-day: failed chunks and verdict. Days with a failed chunk go no further."""
    ok = F.coalesce("valid", F.lit(False))
    joined = plan.select(*CHUNK, "total_chunks").join(results.select(*CHUNK, "valid"), CHUNK, "left")
    return joined.groupBy(*DAY).agg(
        F.max("total_chunks").alias("total_chunks"), F.count_if(~ok).alias("failed_chunks"),
        F.bool_and(ok).alias("succeeded"))


def failed_chunks(plan: DataFrame, results: DataFrame) -> DataFrame:
    return (plan.select(*CHUNK, "total_chunks").join(
        results.filter("valid").select(*CHUNK), CHUNK, "left_anti"))


def run_verdict(outcome: DataFrame) -> DataFrame:
    """Over a run: days, failures, and success unless every day failed."""
    return outcome.groupBy("memory_date").agg(
        F.count(F.lit(1)).alias("agents"), F.count_if(~F.col("succeeded")).alias("failed_agents"),
        F.bool_or("succeeded").alias("success"))


def finalize_days(skeletons: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L1 rows filled from summaries, and `nocontent` markers for low-signal days, whose L1 row is dropped."""
    low = summaries.filter("memory_signal = 'low'")
    normal = summaries.filter("memory_signal = 'normal'").withColumnRenamed("source_turns", "compress_hints")
    fields = [c for c in normal.columns if c not in DAY]
    joined = skeletons.join(low.select(*DAY), DAY, "left_anti").alias("s").join(normal.alias("n"), DAY, "left")
    hit = F.col("n.memory_signal").isNotNull()
    out = []
    for name in skeletons.columns:
        if name in DAY:
            out.append(F.col(name))
        elif name in fields:
            out.append(F.when(hit, F.col(f"n.{name}")).otherwise(F.col(f"s.{name}")).alias(name))
        elif name == "status":
            filled = (F.col("s.status").withField("filled", F.lit(True))
                      .withField("filled_at", F.current_timestamp()))
            out.append(F.when(hit, filled).otherwise(F.col("s.status")).alias(name))
        else:
            out.append(F.col(f"s.{name}").alias(name))
    return joined.select(*out), low.select(*DAY, F.lit("nocontent").alias("marker"))


# --- index, vectors, counts ----------------------------------------------------------------------

def index_rows(l1_days: DataFrame) -> DataFrame:
    """Surface index rows of filled days."""
    return l1_days.filter(F.coalesce("summary", F.lit("")) != "").select(
        "agent_id", F.lit("surface").alias("depth"), F.col("memory_date").cast("string").alias("time_key"),
        "summary", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("day_mood", F.lit("")).alias("mood"), F.lit(None).cast("string").alias("window_date_start"),
        F.lit(0).cast("bigint").alias("access_count"))


def with_embed_text(index: DataFrame) -> DataFrame:
    return index.withColumn("text_used", tx.embed_text(F.col("summary"), F.col("tags"), F.col("mood")))


def hashed_embedding(dimensions: int = 64) -> Callable[[DataFrame], DataFrame]:
    """Offline vectors: signed word counts hashed into a fixed number of slots, unit length."""
    def embed(rows: DataFrame) -> DataFrame:
        slots = F.transform(tx.match_tokens(F.col("text_used")), lambda w: F.struct(
            F.pmod(F.xxhash64(w), F.lit(dimensions)).alias("slot"),
            F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
        # Words are split and hashed once for a row, not once for each slot.
        raw = let(slots, lambda words: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.aggregate(
            F.filter(words, lambda s: s["slot"] == i), F.lit(0.0), lambda total, s: total + s["sign"])))
        length = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda total, v: total + v * v))
        return rows.withColumn("_raw", raw).withColumn("embedding", let(length, lambda size: F.when(
            size > 0, F.transform("_raw", lambda v: v / size)).otherwise(F.col("_raw")))).drop("_raw")

    return embed


def model_embedding(model: Callable[[list[str]], list[list[float]]]) -> Callable[[DataFrame], DataFrame]:
    """Vectors from a model that takes a batch of texts; runs in Arrow batches on the executors."""
    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(model(list(texts)))

    return lambda rows: rows.withColumn("embedding", vectors("text_used"))


def record_counts(counts: DataFrame, l1_days: DataFrame) -> DataFrame:
    """Landmark counts with the given days counted anew."""
    return upsert(counts, count_documents(l1_days), DAY)


def summarise_days(turns: DataFrame, bounds: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks to day summaries with the built-in summariser."""
    from memlake.operators.chunking import chunk_fragments

    fragments = chunk_fragments(turns, bounds, settings)
    return infer_reduce(infer_map(fragments), low_signal_context(fragments))
