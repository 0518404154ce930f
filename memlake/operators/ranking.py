"""Score calibration and top-k per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.operators.prefix import ordinal

GRID = 1024.0


def minmax_norm(value: Column, low: Column, high: Column) -> Column:
    close = F.abs(high - low) <= F.greatest(F.abs(high), F.abs(low)) * 1e-9
    return (F.when(close, F.when(high > 0, 1.0).otherwise(0.0))
             .otherwise((value - low) / (high - low)))


def rank_norm(value: Column, position: Column, count: Column) -> Column:
    return (F.when(count == 1, F.when(value > 0, 1.0).otherwise(0.0))
             .otherwise(1 - position / (count - 1)))


def sigmoid_norm(value: Column, center: Column) -> Column:
    spread = F.greatest(center, F.lit(1e-6))
    return F.when(value > 0, 1 / (1 + F.exp(-(value - center) / spread))).otherwise(0.0)


def calibrate(df: DataFrame, key: list[str], scores: dict[str, str], order: list[str],
              coarse: list[Column]) -> DataFrame:
    """Bring raw scores of one query onto a comparable scale.

    `scores` maps each raw column to the calibrated column to add. `order` breaks
    rank ties, `coarse` are numeric buckets that follow it. The result mixes min-max
    (0.4), rank (0.4) and sigmoid (0.2) views of the raw score.

    Equal raw scores are common (word-overlap scores come in halves, missing
    vectors score 0), so rank positions use buckets of the score grid and, on
    the grid itself, buckets of the tie order: no bucket grows with a query's
    share of the data.
    """
    stats = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[a for raw in scores for a in (
            F.min(raw).alias(f"_lo_{raw}"), F.max(raw).alias(f"_hi_{raw}"),
            F.avg(F.when(F.col(raw) > 0, F.col(raw))).alias(f"_mid_{raw}"))])
    ranked = df
    for raw in scores:
        cell = F.floor(F.col(raw) * GRID).cast("bigint")
        on_grid = F.col(raw) * GRID == cell
        ties = [F.when(on_grid, bucket).otherwise(F.lit(0)) for bucket in coarse]
        ranked = ordinal(ranked, key, [(cell,), on_grid.cast("int"), *ties],
                         [F.col(raw).desc(), *[F.col(c) for c in order]], name=f"_pos_{raw}")
    out = ranked.join(stats, key)
    for raw, name in scores.items():
        value = F.col(raw)
        out = out.withColumn(name, (
            minmax_norm(value, F.col(f"_lo_{raw}"), F.col(f"_hi_{raw}")) * 0.4
            + rank_norm(value, F.col(f"_pos_{raw}"), F.col("_n")) * 0.4
            + sigmoid_norm(value, F.coalesce(F.col(f"_mid_{raw}"), F.lit(0.0))) * 0.2))
    return out.select(*df.columns, *scores.values())


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First `k` rows per key. Spark keeps at most `k` rows per key and task before it shuffles."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= max(1, k))
