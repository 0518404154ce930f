"""Selection of varied recall results and assembly of the answer text."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

TIME_KEY_LIMIT = 3
OVERLAP_LIMIT = 0.75


def _select(rows: pd.DataFrame, limit: int) -> list[int]:
    """Walk candidates from best to worst and keep those that add something new."""
    kept: list[int] = []
    words = [set(text.split(" ")) for text in rows["normalized"]]
    taken = {}
    for here, (moment, field, layer) in enumerate(zip(rows["time_key"], rows["field"], rows["source_layer"])):
        if len(kept) == limit:
            break
        peers = taken.setdefault(moment, [])
        if len(peers) == TIME_KEY_LIMIT or any(rows["field"].iat[p] == field for p in peers):
            continue
        layers = Counter(rows["source_layer"].iat[p] for p in peers)
        first_turn = layer == "l2" and not layers["l2"]
        redundant = any(len(words[here] & words[p]) >= OVERLAP_LIMIT * min(len(words[here]), len(words[p]))
                        for p in peers)
        if redundant and not first_turn:
            continue
        peers.append(here)
        kept.append(here)
    return kept


def diversify(candidates: DataFrame, limit: int) -> DataFrame:
    """Keep up to `limit` varied candidates per query.

    Input per query is at most the two recall limits together, so each group of
    the Python step holds a few dozen rows whatever the data size. Of equal
    normalized texts the best stays.
    """
    best_first = [F.desc("final_score"), F.desc("weighted_score"), "source_layer", "time_key", "layer_rank"]
    same_text = Window.partitionBy("query_id", "normalized").orderBy(*best_first)
    distinct = (candidates.filter(F.col("normalized") != "")
                .withColumn("_copy", F.row_number().over(same_text)).filter("_copy = 1").drop("_copy"))
    ordered = distinct.withColumn("_place", F.row_number().over(
        Window.partitionBy("query_id").orderBy(*best_first)))
    choice_in = ordered.select("query_id", "_place", "time_key", "field", "source_layer", "normalized")
    id_type = candidates.schema["query_id"].dataType.simpleString()

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_place", ignore_index=True)
        kept = group.loc[_select(group, max(1, limit)), ["query_id", "_place"]]
        return kept.assign(rank=range(1, len(kept) + 1))

    chosen = choice_in.groupBy("query_id").applyInPandas(
        choose, schema=f"query_id {id_type}, _place int, rank int")
    return ordered.join(chosen, ["query_id", "_place"]).drop("_place")


# --- fixed values: section headings ------------------------------------------------
SECTIONS = ("### 相关摘要", "### 相关对话摘录")
# ------------------------------------------------------------------------------------


def capped_text(sections: list[tuple[str, Column]], max_chars: int) -> Column:
    """Join sections of lines without exceeding `max_chars`.

    Each section has a heading and an array of lines. A section ends at its
    first line that does not fit; the next section is still tried.
    """
    cap = max(1, max_chars)
    state = F.lit("")
    for heading, lines in sections:
        def append(text: Column, line: Column) -> Column:
            return F.when(text == "", line).otherwise(F.concat(text, F.lit("\n"), line))

        def step(acc: Column, line: Column) -> Column:
            longer = append(acc["text"], F.concat(F.lit("- "), line))
            fits = acc["open"] & (F.length(longer) <= cap)
            return F.struct(F.when(fits, longer).otherwise(acc["text"]).alias("text"), fits.alias("open"))

        headed = append(state, F.lit(heading))
        begin = F.struct(headed.alias("text"), F.lit(True).alias("open"))
        filled = F.aggregate(lines, begin, step, lambda acc: acc["text"])
        state = F.when((F.size(lines) > 0) & (F.length(headed) <= cap), filled).otherwise(state)
    return F.trim(state)


def assemble(selected: DataFrame, max_chars: int) -> DataFrame:
    """Answer text per query from its selected lines."""
    def lines(layer: str) -> Column:
        ranked = F.array_sort(F.collect_list(F.when(F.col("source_layer") == layer, F.struct("rank", "rendered"))))
        return F.transform(ranked, lambda item: item["rendered"])

    per_query = selected.groupBy("query_id").agg(lines("l1").alias("_l1"), lines("l2").alias("_l2"))
    return per_query.select("query_id", capped_text(
        list(zip(SECTIONS, (F.col("_l1"), F.col("_l2")))), max_chars).alias("assembled_text"))
