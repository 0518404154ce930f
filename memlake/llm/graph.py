"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memlake.llm.common import materialize


def near_labels(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """`node, label`: the least node within two links. Joins stars whole and longer chains in part, in one round."""
    both = links.select(F.col(left).alias("u"), F.col(right).alias("v"))
    both = both.union(both.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    seen = both.join(least.withColumnRenamed("u", "v"), "v").select("u", "m").union(least)
    return seen.groupBy(F.col("u").alias("node")).agg(F.min("m").alias("label"))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """`node, label` for every node of a link, the label being the least node that links reach.

    Each round points the larger neighbours of a node, then the node itself, at
    its least neighbour; the number of rounds grows with the logarithm of the
    longest chain. Links stay a distributed table throughout; null ends and
    links of a node to itself are left out.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = materialize(edges.where("u is not null and v is not null and u <> v").distinct())
    mark = None
    while True:
        new = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_if(F.col("u").isNull()))
        seen = tuple(edges.agg(new.alias("s")).first().s)
        if seen == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                edges.select("v", "v")).groupBy("node").agg(F.min("label").alias("label"))
        mark = seen
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct())
