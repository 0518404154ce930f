"""Batch recall: from query texts to ranked memories and an answer text.

Inputs
  queries     query_id, agent_id, query; optional today, window_start, window_end
              (dates) and prefer_l2_ratio
  l0_index    agent_id, depth, time_key, ord_key, text (from `flatten_entry_text`)
  embeddings  agent_id, depth, time_key, embedding (doubles); optional
  vectors     query_id, embedding (doubles); optional
  documents   agent_id, depth, time_key and the L1 / rollup fields
  turns       agent_id, time_key, turn_index, role, hhmm, content

`documents` and `turns` may be functions that give the rows of some keys
(agent_id, depth, time_key): rows that are derived, as the test tables' are, are
then made for the anchored keys only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.functions import let, scores as sc, text as tx
from memlake.functions.timeaxis import characterized_date
from memlake.operators.diversity import assemble, diversify
from memlake.operators.lexical import score_rows
from memlake.operators.prefix import id_bucket
from memlake.operators.ranking import calibrate, top_k
from memlake.session import materialize
from memlake.settings import DEFAULTS, Settings

ROW = ["agent_id", "depth", "time_key"]


Rows = DataFrame | Callable[[DataFrame], DataFrame]
DEPTHS = ("surface", "shallow", "deep")


def entry_depth(depth: Column, granularity: Column) -> Column:
    """Depth of an index entry; a daily granularity or none at all stands for a day, an unknown depth stays as it is."""
    known, fine = F.lower(tx.strip(F.coalesce(depth, F.lit("")))), F.lower(tx.strip(F.coalesce(granularity, F.lit(""))))
    return F.when(known.isin(*DEPTHS), known).when(fine.isin("daily", "surface"), "surface").when(known == "", "surface").otherwise(known)


def entry_time_key(depth: Column, day: Column, week: Column, window: Column) -> Column:
    """The key that fits the depth; of an unknown depth the first that there is."""
    day, week, window = (tx.strip(F.coalesce(c, F.lit(""))) for c in (day, week, window))
    return (F.when(depth == "surface", day).when(depth == "shallow", week).when(depth == "deep", window)
             .when(day != "", day).when(week != "", week).otherwise(window))


def index_entries(entries: DataFrame) -> DataFrame:
    """Index entries as recall searches them: depth, time key and one text over all fields.

    Entries have `depth` or `granularity`, a `time_key` or one of `date`, `week`
    and `window`, and any of the fields of `text.flatten_entry_text`. Those that the
    jobs write (`write.index_rows`, `decay.rollup_index_rows`) have depth and key.
    """
    column = lambda name: F.col(name).cast("string") if name in entries.columns else F.lit(None).cast("string")
    fields = {n: F.col(n) for n in ("summary", "tags", "mood", "day_mood", "topics", "decisions", "todos", "key_items", "emotional_peaks") if n in entries.columns}
    placed = entries.withColumns({"text": tx.flatten_entry_text(fields), "depth": entry_depth(column("depth"), column("granularity"))})
    key = entry_time_key(F.col("depth"), column("date"), column("week"), column("window"))
    return placed.withColumn("time_key", F.coalesce(F.nullif(column("time_key"), F.lit("")), key))


def query_terms(queries: DataFrame) -> DataFrame:
    """Queries that have at least one term, with their terms and the parts of these."""
    return (queries.withColumn("terms", tx.match_tokens(F.col("query"))).filter(F.size("terms") > 0)
            .withColumn("parts", sc.term_parts(F.col("terms"))))


def searchable(df: DataFrame, text: str) -> DataFrame:
    """Add the token set and the text of tokens that `lexical_score` reads, once per row."""
    return (df.withColumn("tokens", F.array_distinct(tx.match_tokens(F.col(text))))
            .withColumn("haystack", F.array_join("tokens", " ")))


def _lexical() -> Column:
    return sc.lexical_score(F.col("terms"), F.col("parts"), F.col("tokens"), F.col("haystack"))


def score_index(queries: DataFrame, l0_index: DataFrame, embeddings: DataFrame | None = None,
                vectors: DataFrame | None = None) -> DataFrame:
    """Raw lexical and vector scores of every index row of the query's agent.

    The join with the agent's queries is where an agent with much data shows:
    AQE splits its partition when both sides are large and broadcasts the
    queries when they are measured to be small. Rows meet blocks of queries, not
    single ones, and vectors only after their texts are scored.
    """
    known = materialize(query_terms(queries).select("query_id", "agent_id", "terms"))
    rows = l0_index.filter(F.col("depth").isin("surface", "shallow", "deep") & (F.col("time_key") != "")).select(
        *ROW, "ord_key", F.lower("text").alias("tokens"))  # split where they are scored
    numbered, found = score_rows(known, rows, [*ROW, "ord_key"])
    numbered = materialize(numbered.drop("terms"))
    hybrid = vectors is not None and embeddings is not None
    if hybrid:
        covered = embeddings.select("agent_id").distinct().withColumn("_has_rows", F.lit(True))
        asked = vectors.select("query_id", F.col("embedding").alias("_q"), sc.norm(F.col("embedding")).alias("_qn"))
        keyed = embeddings.select(*ROW, F.col("embedding").alias("_v"), sc.norm(F.col("embedding")).alias("_vn"))
        numbered = numbered.join(asked, "query_id", "left").join(covered, "agent_id", "left")
        found = found.join(keyed, ROW, "left")
    pairs = found.select("*", F.posexplode("_scores").alias("_pos", "lexical_raw")).join(numbered, ["agent_id", "_block", "_pos"])
    if not hybrid:
        return pairs.select("query_id", *ROW, "ord_key", "lexical_raw", F.lit(0.0).alias("embedding_raw"), F.lit(False).alias("hybrid"))
    similarity = sc.cosine(F.col("_q"), F.col("_v"), F.col("_qn"), F.col("_vn"))
    return pairs.select(
        "query_id", *ROW, "ord_key", "lexical_raw",
        F.greatest(F.lit(0.0), F.coalesce(similarity, F.lit(0.0))).alias("embedding_raw"),
        (F.col("_q").isNotNull() & F.coalesce("_has_rows", F.lit(False))).alias("hybrid"))


def _key_month(key: Column) -> Column:
    """Numeric, order-preserving bucket of `ord_key`: its year and month, 0 for rows without a date."""
    return F.coalesce(F.regexp_extract(key, r"^(\d{4})-W?(\d{2})", 1).try_cast("bigint") * 100
                      + F.regexp_extract(key, r"^(\d{4})-W?(\d{2})", 2).try_cast("bigint"), F.lit(0).cast("bigint"))


def recall_anchors(scored: DataFrame, limit: int = DEFAULTS.l0_limit) -> DataFrame:
    """Best index rows per query.

    Zero raw scores still take part, because their rank gives them a small
    score; weak rows fill the limit. `scored` is read by several aggregates, so
    pass a written table (see `recall`).
    """
    bucket = [_key_month(F.col("ord_key"))] if dict(scored.dtypes)["ord_key"] == "string" else [id_bucket("ord_key")]
    calibrated = calibrate(scored, ["query_id"], {"lexical_raw": "lexical_score", "embedding_raw": "embedding_score"},
                           ["ord_key"], bucket)
    fused = calibrated.withColumn("score", sc.gated_fuse(
        F.col("lexical_score"), F.when(F.col("hybrid"), F.col("embedding_score")).otherwise(0.0), F.col("hybrid")))
    best = (fused.filter("score > 0").groupBy("query_id", *ROW)
            .agg(F.max(F.struct("score", "lexical_score", "embedding_score")).alias("_b")))
    ranked = top_k(best.select("query_id", *ROW, "_b.*"), ["query_id"],
                   [F.desc("score"), F.desc("lexical_score"), F.desc("embedding_score"), "depth", "time_key"],
                   limit, name="anchor_rank")
    return ranked.withColumn("score", F.round("score", 6))


# Positions of the field families inside a document, in scan order.
def _document_items() -> Column:
    def item(field: Column | str, order: int, pos: Column, text: Column, kind=None, emotion=None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            (F.lit(field) if isinstance(field, str) else field).alias("field"), F.lit(order).alias("field_no"),
            pos.cast("int").alias("pos"), tx.strip(text).alias("information"),
            (kind if kind is not None else none).alias("key_item_type"),
            (emotion if emotion is not None else none).alias("emotion"))

    zero = F.lit(0)
    mood = F.when(F.col("depth") == "surface", "day_mood").when(F.col("depth") == "shallow", "week_mood").otherwise("window_mood")
    topics = F.flatten(F.transform("topics", lambda t, i: F.array(
        item("topic_name", 2, i * 2, t["name"]), item("topic_detail", 2, i * 2 + 1, t["detail"]))))
    return F.concat(
        F.array(item("summary", 0, zero, F.col("summary")), item(mood, 1, zero, F.col("mood"))),
        F.coalesce(topics, F.array()),
        F.coalesce(F.transform("decisions", lambda d, i: item("decision", 3, i, d)), F.array()),
        F.coalesce(F.transform("todos", lambda d, i: item("todo", 4, i, d)), F.array()),
        F.coalesce(F.transform("key_items", lambda k, i: item("key_item", 5, i, k["desc"], kind=tx.strip(k["type"]))),
                   F.array()),
        F.coalesce(F.transform("emotional_peaks", lambda p, i: item(
            "emotional_peak_context", 6, i, p["context"], emotion=tx.strip(p["emotion"]))), F.array()))


def summary_candidates(documents: DataFrame) -> DataFrame:
    """All searchable pieces of L1 documents and rollups; tags are not among them."""
    pieces = documents.select(*ROW, F.explode(_document_items()).alias("_i")).select(*ROW, "_i.*")
    return pieces.filter("information != ''")


def _ranked(candidates: DataFrame, coarse: list[Column], tie_order: list[str], identity: list[str],
            order: list[Column], limit: int) -> DataFrame:
    # Unnesting drops rows without a hit. A filter on the score would be pushed below
    # the projection and compute every score twice.
    hit = let(_lexical(), lambda score: F.when(score > 0, F.array(score)))
    kept = [c for c in candidates.columns if c not in ("terms", "parts", "tokens", "haystack")]
    scored = materialize(candidates.select(*kept, F.explode(hit).alias("raw_score")))
    calibrated = calibrate(scored, ["query_id"], {"raw_score": "score"}, tie_order, coarse).filter("score > 0")
    rest = [c for c in calibrated.columns if c not in ("query_id", *identity, "score", "raw_score")]
    # Equal pieces: the best placed one stays; placement decides only fields that are not compared.
    unique = calibrated.groupBy("query_id", *identity).agg(
        F.min(F.struct((-F.col("score")).alias("_s"), *tie_order, *[c for c in rest if c not in tie_order],
                       "score", "raw_score")).alias("_u"))
    flat = unique.select("query_id", *identity, *[F.col(f"_u.{c}").alias(c) for c in rest], "_u.score", "_u.raw_score")
    return top_k(flat, ["query_id"], order, limit, name="layer_rank").withColumn("score", F.round("score", 6))


def _wanted(rows: Rows, keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the keys; Spark does not move the join below what derives the rows, a function does."""
    keys = keys.select(*ROW).distinct()
    rows = rows(keys) if callable(rows) else rows
    return rows.join(keys.select(*by).distinct(), by, "left_semi")


def recall_summaries(queries: DataFrame, anchors: DataFrame, documents: Rows,
                     limit: int = DEFAULTS.l1_limit) -> DataFrame:
    """Best pieces of the anchored documents per query."""
    terms = query_terms(queries).select("query_id", "terms", "parts")
    # Only anchored documents are taken apart.
    wanted = _wanted(documents, anchors, ROW)
    pieces = searchable(summary_candidates(wanted), "information")
    hits = (anchors.select("query_id", *ROW, "anchor_rank").join(pieces, ROW).join(terms, "query_id"))
    spread = F.col("anchor_rank") * 10 + F.col("field_no")
    return _ranked(hits, [spread.cast("bigint"), id_bucket("pos")], ["anchor_rank", "field_no", "pos"],
                   ["depth", "time_key", "field", "information"],
                   [F.desc("score"), F.desc("raw_score"), "depth", "time_key", "field", "information"], limit)


def recall_turns(queries: DataFrame, anchors: DataFrame, turns: Rows,
                 limit: int = DEFAULTS.l2_limit) -> DataFrame:
    """Best transcript turns of the anchored days per query."""
    terms = query_terms(queries).select("query_id", "terms", "parts")
    days = anchors.filter("depth = 'surface'").select("query_id", *ROW, "anchor_rank")
    wanted = _wanted(turns, days, ["agent_id", "time_key"])
    spoken = searchable(wanted.select(
        "agent_id", "time_key", "turn_index", F.coalesce(tx.strip(F.col("role")), F.lit("")).alias("role"),
        F.coalesce(tx.strip(F.col("hhmm")), F.lit("")).alias("hhmm"),
        tx.strip(F.col("content")).alias("information")).filter("information != ''"), "information")
    hits = days.join(spoken, ["agent_id", "time_key"]).join(terms, "query_id")
    ranked = _ranked(hits, [F.col("anchor_rank").cast("bigint"), id_bucket("turn_index")],
                     ["anchor_rank", "turn_index"], ["time_key", "role", "hhmm", "information"],
                     [F.desc("score"), F.desc("raw_score"), "time_key", "hhmm", "role", "information"], limit)
    return ranked.withColumn("field", F.lit("conversation_excerpt"))


def weigh_candidates(queries: DataFrame, summaries: DataFrame, turns: DataFrame, today: Column | None = None,
                     settings: Settings = DEFAULTS) -> DataFrame:
    """One list of both layers with layer weight, recency and runtime-text penalty applied."""
    none = F.lit(None)
    l1 = summaries.select(
        "query_id", "depth", "time_key", "field", "information", "score", "layer_rank", F.lit("l1").alias("source_layer"),
        sc.render_summary_line(F.col("depth"), F.col("time_key"), F.col("field"), F.col("information"),
                               F.col("key_item_type"), F.col("emotion")).alias("rendered"))
    l2 = turns.select(
        "query_id", "depth", "time_key", "field", "information", "score", "layer_rank", F.lit("l2").alias("source_layer"),
        sc.render_turn_line(F.col("depth"), F.col("time_key"), F.col("role"), F.col("hhmm"),
                            F.col("information")).alias("rendered"))
    columns = queries.columns

    def given(name: str, kind: str, default: Column) -> Column:
        return F.coalesce(F.col(name).cast(kind), default) if name in columns else default

    options = queries.select(
        "query_id", given("today", "date", F.current_date() if today is None else today).alias("_today"),
        given("window_start", "date", none.cast("date")).alias("_from"),
        given("window_end", "date", none.cast("date")).alias("_to"),
        given("prefer_l2_ratio", "double", none.cast("double")).alias("_ratio"))
    first, last = F.least("_from", "_to"), F.greatest("_from", "_to")
    weighted = sc._unit(F.col("score")) * sc._unit(sc.layer_weight(F.col("source_layer"), F.col("_ratio"), settings))
    rows = (l1.unionByName(l2).join(options, "query_id")
            .withColumn("characterized_date", characterized_date(F.col("depth"), F.col("time_key")))
            .withColumn("weighted_score", weighted)
            .withColumn("recency_score", sc.recency_score(F.col("characterized_date"), F.col("_today"), first, last, settings)))
    modulated = sc.recency_modulate(F.col("weighted_score"), F.col("recency_score"), settings.recency_alpha)
    final = sc.runtime_penalty(modulated, F.concat_ws("\n", "information", "rendered"))
    return (rows.withColumn("final_score", F.round(final, 6))
            .withColumn("weighted_score", F.round("weighted_score", 6))
            .withColumn("recency_score", F.round("recency_score", 6))
            .withColumn("normalized", tx.dedupe_text(F.col("information")))
            .drop("_today", "_from", "_to", "_ratio"))


def recall_candidates(queries: DataFrame, l0_index: DataFrame, documents: Rows, turns: Rows,
                      embeddings: DataFrame | None = None, vectors: DataFrame | None = None,
                      today: Column | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Weighed candidates of both layers, before selection."""
    scored = materialize(score_index(queries, l0_index, embeddings, vectors))
    anchors = materialize(recall_anchors(scored, settings.l0_limit))
    summaries = recall_summaries(queries, anchors, documents, settings.l1_limit)
    excerpts = recall_turns(queries, anchors, turns, settings.l2_limit)
    return weigh_candidates(queries, summaries, excerpts, today, settings)


def recall(queries: DataFrame, l0_index: DataFrame, documents: Rows, turns: Rows,
           embeddings: DataFrame | None = None, vectors: DataFrame | None = None,
           today: Column | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Answer text and ranked memories for every query with a text.

    Blank queries are answered by `recent.recall_recent`.
    """
    candidates = recall_candidates(queries, l0_index, documents, turns, embeddings, vectors, today, settings)
    chosen = materialize(diversify(candidates, settings.final_limit))
    ranked = chosen.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "source_layer", "depth", "time_key", "field", "final_score", "rendered"))).alias("ranked_items"))
    texts = assemble(chosen, settings.max_chars)
    return (query_terms(queries).select("query_id", "agent_id", "query")
            .join(ranked, "query_id", "left").join(texts, "query_id", "left")
            .withColumn("assembled_text", F.coalesce("assembled_text", F.lit(""))))
