"""Counting, scoring and distribution of landmark days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.functions.documents import KEY_ITEM_TYPES
from memlake.settings import DEFAULTS, Settings

DAY = ["agent_id", "memory_date"]


def count_documents(l1_days: DataFrame) -> DataFrame:
    """Key items per type and a histogram of intensities, straight from day summaries."""
    def occurrences(kind: str) -> Column:
        return F.size(F.filter(F.coalesce("key_items", F.array()), lambda k: k["type"] == kind)).cast("bigint")

    kinds = F.map_from_arrays(F.array(*[F.lit(t) for t in KEY_ITEM_TYPES]), F.array(*map(occurrences, KEY_ITEM_TYPES)))
    levels = F.filter(F.transform(F.coalesce("emotional_peaks", F.array()), lambda p: p["intensity"].cast("int")),
                      lambda x: x >= 0)
    histogram = F.map_from_entries(F.transform(
        F.array_sort(F.array_distinct(levels)),
        lambda x: F.struct(x.alias("key"), F.size(F.filter(levels, lambda y: y == x)).cast("bigint").alias("value"))))
    return l1_days.select(*DAY, kinds.alias("key_items"), histogram.alias("intensities"))


def count_items(items: DataFrame) -> DataFrame:
    """The same counts from a table with one `item_type` and one `intensity` per row."""
    kinds = [F.count_if(F.col("item_type") == t).alias(t) for t in KEY_ITEM_TYPES]
    level = F.when(F.col("intensity") >= 0, F.col("intensity"))
    by_level = items.groupBy(*DAY, level.alias("_level")).agg(F.count(F.lit(1)).alias("_hits"), *kinds)
    pairs = F.array_sort(F.collect_list(F.when(F.col("_level").isNotNull(), F.struct("_level", "_hits"))))
    return (by_level.groupBy(*DAY).agg(*[F.sum(t).alias(t) for t in KEY_ITEM_TYPES], pairs.alias("_pairs"))
            .select(*DAY,
                    F.map_from_arrays(F.array(*[F.lit(t) for t in KEY_ITEM_TYPES]),
                                      F.array(*KEY_ITEM_TYPES)).alias("key_items"),
                    F.map_from_entries("_pairs").alias("intensities")))


def _over(histogram: Column, term) -> Column:
    return F.aggregate(F.map_entries(histogram), F.lit(0).cast("bigint"),
                       lambda total, e: total + term(e["key"].cast("bigint"), e["value"]))


def analyze_counts(counts: DataFrame) -> DataFrame:
    """Intensity statistics of each day; all are 0 for a day without peaks."""
    histogram = F.map_filter(F.coalesce("intensities", F.create_map().cast("map<int,bigint>")),
                             lambda k, v: (k >= 0) & (v > 0))
    n = _over(histogram, lambda x, c: c)
    total = _over(histogram, lambda x, c: x * c)
    squares = _over(histogram, lambda x, c: x * x * c)
    wide = [F.coalesce(F.try_element_at("key_items", F.lit(t)), F.lit(0)).cast("bigint").alias(t)
            for t in KEY_ITEM_TYPES]
    return counts.select(*DAY, *wide, *_statistics(
        n, total, squares, F.coalesce(F.array_max(F.map_keys(histogram)), F.lit(0)),
        F.coalesce(F.try_element_at(histogram, F.lit(5)), F.lit(0))))


def analyze_items(items: DataFrame) -> DataFrame:
    """`analyze_counts(count_items(...))` in one aggregation, for whole-table runs."""
    x = F.when(F.col("intensity") >= 0, F.col("intensity").cast("bigint"))
    zero = F.lit(0)
    sums = items.groupBy(*DAY).agg(
        *[F.count_if(F.col("item_type") == t).alias(t) for t in KEY_ITEM_TYPES],
        F.count(x).alias("_n"), F.coalesce(F.sum(x), zero).alias("_sum"),
        F.coalesce(F.sum(x * x), zero).alias("_squares"), F.coalesce(F.max(x), zero).alias("_max"),
        F.count_if(x == 5).alias("_fives"))
    return sums.select(*DAY, *KEY_ITEM_TYPES, *_statistics(
        F.col("_n"), F.col("_sum"), F.col("_squares"), F.col("_max"), F.col("_fives")))


def _statistics(n: Column, total: Column, squares: Column, highest: Column, fives: Column) -> list[Column]:
    return [n.alias("peak_count"),
            F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("simple_mean"),
            F.when(total > 0, squares / total).otherwise(F.lit(0.0)).alias("weighted_mean"),
            highest.cast("bigint").alias("max_intensity"),
            fives.cast("bigint").alias("intensity5_count")]


def score_days(analyzed: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Landmark score and verdict. The verdict uses the score before rounding."""
    def steps(column: str, one: float, more: float) -> Column:
        return F.when(F.col(column) >= 2, more).when(F.col(column) == 1, one).otherwise(0.0)

    items = steps("milestone", 0.5, 1.5) + steps("bug_fix", 2.0, 2.0) + steps("incident", 1.0, 1.5)
    emotion = (F.when(F.col("weighted_mean") >= 3.6, F.col("weighted_mean") - 3.6).otherwise(0.0)
               + steps("intensity5_count", 0.5, 1.0))
    return (analyzed.withColumn("key_item_score", items).withColumn("emotion_score", emotion)
            .withColumn("score_exact", F.col("key_item_score") + F.col("emotion_score"))
            .withColumn("score", F.round("score_exact", 3))
            .withColumn("landmark", F.col("score_exact") >= settings.landmark_threshold))


def judge(analyzed: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return score_days(analyzed, settings).select(*DAY, "score", "landmark")


def landmark_threshold(scored: DataFrame, ratio: float) -> DataFrame:
    """Score that about `ratio` of the days reach: a discrete percentile, so an actual score."""
    p = max(0.0, min(1.0, 1.0 - ratio))
    # Scores have three decimals and a small range, so there are few distinct ones:
    # the percentile is read off running counts per score, however many days there are.
    counts = scored.groupBy("score").agg(F.count(F.lit(1)).alias("days"))
    ascending = Window.orderBy("score")
    upto = ascending.rowsBetween(Window.unboundedPreceding, 0)
    everything = ascending.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    walked = counts.withColumn("_upto", F.sum("days").over(upto)).withColumn("_all", F.sum("days").over(everything))
    position = F.greatest(F.lit(1), F.least(F.col("_all"), F.ceil(F.col("_all") * p)))
    return walked.filter(F.col("_upto") >= position).agg(
        F.min("score").alias("analysis_threshold"), F.max("_all").alias("files_analyzed"))


def histograms(items: DataFrame, scored: DataFrame) -> DataFrame:
    """All binned distributions of a landmark analysis, one row per bin.

    `intensity`: one bin per level from the lowest to the highest seen.
    `simple_mean`, `weighted_mean`, `score`: ten equal bins over the value range.
    `item_type`: how often each type occurs. `per_day`: for each type, how many
    days have how many items.
    """
    levels = (items.filter(F.col("intensity") >= 0).groupBy("intensity").agg(F.count(F.lit(1)).alias("n"))
              .select(F.lit("intensity").alias("chart"), F.lit("").alias("series"),
                      F.col("intensity").cast("double").alias("bin"), "n"))
    measures = ["simple_mean", "weighted_mean", "score"]
    long = scored.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("chart"), F.round(F.col(m), 6).alias("value")) for m in measures])).alias("_m")).select("_m.*")
    distinct = long.groupBy("chart", "value").agg(F.count(F.lit(1)).alias("n"))
    spans = long.groupBy("chart").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    low, high = F.col("low"), F.col("high")
    width = F.when(high > low, (high - low) / 10)
    number = F.when(width.isNull(), F.lit(5)).otherwise(
        F.least(F.lit(9), F.floor((F.col("value") - low) / width)))
    binned = (distinct.join(F.broadcast(spans), "chart")  # three rows
              .withColumn("bin", number.cast("double")).groupBy("chart", "bin").agg(F.sum("n").alias("n"))
              .select("chart", F.lit("").alias("series"), "bin", "n"))
    per_day = scored.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("series"), F.col(t).alias("count")) for t in KEY_ITEM_TYPES])).alias("_t")).select("_t.*")
    day_bins = per_day.groupBy("series", "count").agg(F.count(F.lit(1)).alias("n"))
    by_day = day_bins.select(F.lit("per_day").alias("chart"), "series", F.col("count").cast("double").alias("bin"), "n")
    totals = (day_bins.groupBy("series").agg(F.sum(F.col("count") * F.col("n")).alias("n"))
              .select(F.lit("item_type").alias("chart"), "series", F.lit(0.0).alias("bin"), "n"))
    return levels.unionByName(binned).unionByName(by_day).unionByName(totals)
