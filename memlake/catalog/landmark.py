"""Landmark counting, scoring and analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.catalog import fixtures as fx
from memlake.catalog.registry import query
from memlake.functions import timeaxis
from memlake.functions.documents import KEY_ITEM_TYPES
from memlake.operators import landmarks


def _date():
    return F.col("memory_date").cast("string").alias("memory_date")

_KINDS = ", ".join(f"count(*) FILTER (item_type = '{t}') AS {t}" for t in KEY_ITEM_TYPES)
_STATS = f"""
SELECT agent_id, memory_date, {_KINDS}, count(*) AS peak_count, avg(intensity) AS simple_mean,
       sum(intensity * intensity)::DOUBLE / sum(intensity) AS weighted_mean, max(intensity) AS max_intensity,
       count(*) FILTER (intensity = 5) AS intensity5_count
FROM fx_day_items GROUP BY agent_id, memory_date"""
_SCORED = f"""
SELECT *, CASE WHEN milestone >= 2 THEN 1.5::DOUBLE WHEN milestone = 1 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN bug_fix >= 1 THEN 2.0::DOUBLE ELSE 0 END
          + CASE WHEN incident >= 2 THEN 1.5::DOUBLE WHEN incident = 1 THEN 1.0::DOUBLE ELSE 0 END
          + CASE WHEN weighted_mean >= 3.6 THEN weighted_mean - 3.6 ELSE 0 END
          + CASE WHEN intensity5_count >= 2 THEN 1.0::DOUBLE WHEN intensity5_count = 1 THEN 0.5::DOUBLE ELSE 0 END AS score
FROM ({_STATS})"""


@query("landmark_counts", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, {_KINDS},
       string_agg(intensity || ':' || n, ',' ORDER BY intensity) AS intensities
FROM fx_day_items JOIN (SELECT agent_id, memory_date, intensity, count(*) AS n FROM fx_day_items GROUP BY ALL) h USING (agent_id, memory_date, intensity)
GROUP BY agent_id, memory_date""".replace("string_agg(intensity || ':' || n, ',' ORDER BY intensity)",
                                          "array_to_string(list_sort(list_distinct(list(intensity || ':' || n))), ',')"), ("fx_day_items",))
def landmark_counts(spark, sf):
    counts = landmarks.count_items(fx.day_items(spark, sf))
    levels = F.transform(F.array_sort(F.map_entries("intensities")), lambda e: F.concat_ws(
        ":", e["key"].cast("string"), e["value"].cast("string")))
    return counts.select("agent_id", _date(), *[F.element_at("key_items", t).alias(t) for t in KEY_ITEM_TYPES],
                         F.array_join(levels, ",").alias("intensities"))


@query("intensity_stats", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, peak_count, floor((simple_mean)::DOUBLE * 10000 + 0.5) / 10000 AS simple_mean,
       floor((weighted_mean)::DOUBLE * 10000 + 0.5) / 10000 AS weighted_mean, CAST(max_intensity AS BIGINT) AS max_intensity, intensity5_count FROM ({_STATS})""", ("fx_day_items",))
def intensity_stats(spark, sf):
    analyzed = landmarks.analyze_counts(landmarks.count_items(fx.day_items(spark, sf)))
    return analyzed.select("agent_id", _date(), "peak_count", fx.four_digits(F.col("simple_mean")).alias("simple_mean"),
                           fx.four_digits(F.col("weighted_mean")).alias("weighted_mean"), "max_intensity", "intensity5_count")


@query("landmark_judge", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, round(score, 3) AS score, score >= 5.5 AS landmark FROM ({_SCORED})""", ("fx_day_items",))
def landmark_judge(spark, sf):
    return landmarks.judge(landmarks.analyze_items(fx.day_items(spark, sf))).withColumn("memory_date", _date())


@query("landmark_range", f"""
SELECT agent_id, CAST(memory_date AS VARCHAR) AS memory_date, round(score, 3) AS score, score >= 5.5 AS landmark FROM ({_SCORED})
WHERE memory_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'""", ("fx_day_items",))
def landmark_range(spark, sf):
    """Verdicts of one week."""
    from datetime import date
    items = fx.day_items(spark, sf).filter(timeaxis.date_in_range(
        F.col("memory_date"), start=date(2024, 1, 8), end=date(2024, 1, 14)))
    return landmarks.judge(landmarks.analyze_items(items)).withColumn("memory_date", _date())


@query("landmark_threshold", f"""
SELECT quantile_disc(round(score, 3), 0.9) AS analysis_threshold, count(*) AS files_analyzed FROM ({_SCORED})""", ("fx_day_items",))
def landmark_threshold(spark, sf):
    return landmarks.landmark_threshold(landmarks.score_days(landmarks.analyze_items(fx.day_items(spark, sf))), 0.1)


_PER_DAY = " UNION ALL ".join(f"SELECT '{t}' AS series, {t} AS c FROM s" for t in KEY_ITEM_TYPES)


@query("landmark_histograms", f"""
, s AS (SELECT *, round(score, 3) AS final FROM ({_SCORED})),
m AS (SELECT 'simple_mean' AS chart, round(simple_mean, 6) AS v FROM s UNION ALL SELECT 'weighted_mean', round(weighted_mean, 6) FROM s
      UNION ALL SELECT 'score', final FROM s),
per_day AS ({_PER_DAY})
SELECT 'intensity' AS chart, '' AS series, intensity::DOUBLE AS bin, count(*) AS n FROM fx_day_items GROUP BY intensity
UNION ALL SELECT chart, '', bin, count(*) FROM (
  SELECT chart, CASE WHEN hi > lo THEN least(9, floor((v - lo) / ((hi - lo) / 10))) ELSE 5 END::DOUBLE AS bin
  FROM m JOIN (SELECT chart, min(v) AS lo, max(v) AS hi FROM m GROUP BY chart) USING (chart)) GROUP BY chart, bin
UNION ALL SELECT 'per_day', series, c::DOUBLE, count(*) FROM per_day GROUP BY series, c
UNION ALL SELECT 'item_type', series, 0.0::DOUBLE, CAST(sum(c) AS BIGINT) FROM per_day GROUP BY series""", ("fx_day_items",))
def landmark_histograms(spark, sf):
    items = fx.day_items(spark, sf)
    return landmarks.histograms(items, landmarks.score_days(landmarks.analyze_items(items)))
