"""Folds, samples and frames shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from memlake.session import checkpoint_dir, materialize


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % parts


def held_out(column: str, parts: int, part: int) -> Column:
    """Whether the id falls into the held-out part; a null id does not."""
    return F.coalesce(fold(column, parts) == part, F.lit(False))


def bounded_sample(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """Up to `most` rows of each value of `by`, those whose hashed `order` is least; cut per task before the shuffle."""
    window = Window.partitionBy(by).orderBy(F.xxhash64(order), F.col(order))
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= most).drop("_rank")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def write_blobs(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """`materialize` for rows of many MB: small row groups, so that a writer holds few rows at once."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid4().hex}"
    df.write.option("parquet.block.size", 8 << 20).option("parquet.enable.dictionary", "false").option(
        "compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def by_batch(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]
             ) -> DataFrame:
    """Apply per Arrow batch a function that `start` makes once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


__all__ = ["bounded_sample", "by_batch", "fold", "fresh", "held_out", "materialize", "read", "write_blobs"]
