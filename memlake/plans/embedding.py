"""Index rows and their vectors, of days, weeks and windows alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from memlake.operators.merging import upsert, upsert_index
from memlake.plans.write import with_embed_text

L0 = ["agent_id", "depth", "time_key"]
EMBEDDINGS = "agent_id string, depth string, time_key string, text_used string, model string, fingerprint string, embedding array<double>"

Embed = Callable[[DataFrame], DataFrame]


def fingerprint(text: Column, model: Column) -> Column:
    """Of what a vector is made: the text and the model's version."""
    return F.sha2(F.concat_ws("\n", model, text), 256)


def stale(index: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Index rows with a text whose vector is missing or was made of another text or by another model."""
    wanted = with_embed_text(index).select(*L0, "text_used").where("text_used != ''")
    wanted = wanted.withColumns({"model": F.lit(model), "fingerprint": fingerprint(F.col("text_used"), F.lit(model))})
    return wanted.join(embeddings.select(*L0, "fingerprint"), [*L0, "fingerprint"], "left_anti")


def index_and_embed(index: DataFrame, embeddings: DataFrame, fresh: DataFrame, embed: Embed, model: str,
                    last: str = "surface") -> tuple[DataFrame, DataFrame]:
    """The index with fresh rows of any depth, and the vectors brought up to date with it.

    `fresh` holds each key once. Only fresh rows are looked at; `embed` gets those
    whose fingerprint is not stored, so that a row whose text and model are the
    same costs no call. Vectors of keys that are no longer in the index stay;
    `operators.merging.prune` removes them with their rows.
    """
    computed = embed(stale(fresh, embeddings, model)).select(embeddings.columns)
    columns = [c for c in index.columns if c != "ord_key"]
    return upsert_index(index, fresh, last).select(columns), upsert(embeddings, computed, L0)
