"""Mixing sources to target weights; DataFrame operations only.

Sizes are added up per source, targets share them by weight with a ceiling on
how often a source may repeat, and a document is taken floor(rate) times plus
once more with the probability of the remainder, drawn from a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.llm import common

MOST_REPEATS = 3
SEED = "mix-1"


def n_words(text_col: str) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    parts = F.split(F.col(text_col), r"[\x20\x09-\x0D]+")
    return F.coalesce(F.size(F.array_remove(parts, "")), F.lit(0)).cast("long")


def uniform(id_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id as text; the same on every run."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def targets(sizes: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """Add `weight` and `target` to sources (`source`, `source_size`).

    Sources in order of code points, null last, weigh 1, 2, 3, 1, 2, 3, ... and
    share the sum of all sizes by weight. No target is above `most` times its
    source's size; what is above is shared again by the others. This ends where
    the sources that reach their ceiling first, by ceiling over weight, have it
    and the rest share what is left: one pass over the sources in that order.
    The windows run over sources, one row each, not over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    rows = rows.withColumn("_ceiling", (F.col("source_size") * most).cast("long"))
    by_need = Window.orderBy(F.col("_ceiling") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("_ceiling").over(before), F.lit(0)),
        "_heavy": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    rows = rows.withColumn("_full", F.col("_left") * F.col("weight") > F.col("_ceiling") * F.col("_heavy"))
    level = F.first(F.when(~F.col("_full"), F.struct("_left", "_heavy")), ignorenulls=True).over(
        by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_level", level)
    share = F.col("_level._left").cast("double") / F.col("_level._heavy") * F.col("weight")
    target = F.when(F.col("_full") | F.col("_level").isNull(), F.col("_ceiling").cast("double")).otherwise(
        F.least(share, F.col("_ceiling").cast("double")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """Add `size`, `source_size`, `target` and `copies` to every row.

    Null and empty texts have size 0; a source of empty texts only has target
    and copies 0. Rows that repeat an id are drawn alike. A null id is drawn as
    an empty one. Columns named as the new ones are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    source, name = common.fresh(docs, "_source"), common.fresh(docs, "_name")
    sized = docs.withColumns({"size": n_words(text_col), source: F.col(source_col).cast("string")})
    sizes = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, most).select(F.col("source").alias(name), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (uniform(id_col, seed) < rate - F.floor(rate)).cast("long")
    return sized.join(goals, F.col(source).eqNullSafe(F.col(name))).withColumn("copies", copies).drop(
        source, name)


def emit(planned: DataFrame) -> DataFrame:
    """Every document as many times as planned, with `copy` counting from 1."""
    return planned.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
