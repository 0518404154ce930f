"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
every stage's result as Parquet and reads it again as the next one's documents.
All stages but the last return the columns of `documents`. Empty tables stay
empty; columns beyond those of `documents` travel along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.llm import decontaminate, jaccard, langid, lines, mixing
from memlake.llm.common import materialize, read
from memlake.session import small_batches

#: The least closeness to a language if no language has held-out rows to take it from.
LEAST_CLOSENESS = 0.1
#: Near copies: word shingles of this size, and the least percentage of the union that two documents share.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts that are null, without a letter, or like no language go."""
    found = langid.identify(docs, langid.learn(docs, rows_per_language=None))
    least = langid.least_closeness(docs, rows_per_language=None)
    enough = F.lit(min(least.values(), default=LEAST_CLOSENESS))
    if least:
        by_lang = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair])
        enough = F.coalesce(F.try_element_at(by_lang, F.col("lang_pred")), enough)
    kept = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= enough)
    return found.where(kept).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier; `n_chars` follows. Those of which nothing is left go."""
    found = lines.dedup(docs, least_chars=None).where(F.length(F.trim("kept_text")) > 0)
    changed = F.size("removed_lines") > 0
    found = found.withColumns({"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")),
                               "n_chars": F.when(changed, F.char_length("kept_text").cast("long")).otherwise(
                                   F.col("n_chars"))})
    return found.select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id; rows without an id stay."""
    found = jaccard.join(docs, size=SHINGLE, percent=PERCENT)
    return found.where("doc_id is null or component_id = doc_id").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.find(docs, read(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered by `copy`, with their source's size and target."""
    return mixing.emit(mixing.plan(docs)).drop("copies")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [(name, _in_small_batches(stage)) for name, stage in (
    ("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination), ("mixing", mixture))]
ORACLE_SQL = None  # no SQL for language profiles and edit distance; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
