"""Positions and running sums that survive one group holding much of the data.

A window partitioned by a hot key runs in one task. Here each group is cut into
buckets that follow its order, bucket totals are added up first (a small
aggregate), and only the rows of one bucket are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_ROWS = 1024


def id_bucket(column: str | Column) -> Column:
    """Order-preserving bucket of an integer order column."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column / BUCKET_ROWS).cast("bigint")


def time_bucket(column: str | Column) -> Column:
    """Order-preserving bucket of a timestamp order column: its minute."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(F.unix_timestamp(column.cast("timestamp")) / 60).cast("bigint")


def running(df: DataFrame, keys: list[str], buckets: list[Column | tuple[Column]], order: list[Column],
            sums: dict[str, Column]) -> DataFrame:
    """Add running totals, the current row excluded.

    `sums` maps an output column to the value that is summed over all rows that
    come before the row in its group. `buckets` are non-null columns that never
    decrease along `order`; wrap one in a tuple if it never increases instead.
    Keys must not be null.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    plain, directed = [], []
    for name, bucket in zip(names, buckets):
        descending = isinstance(bucket, tuple)
        plain.append((bucket[0] if descending else bucket).alias(name))
        directed.append(F.col(name).desc() if descending else F.col(name).asc())
    rows = df.select("*", *plain)
    inside = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(*directed).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, *names).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    offsets = totals.select(*keys, *names, *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    keyed = rows.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_i_{n}")
                               for n, v in sums.items()])
    return keyed.join(offsets, [*keys, *names]).select(
        *df.columns, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def ordinal(df: DataFrame, keys: list[str], buckets: list[Column], order: list[Column],
            name: str = "turn_index") -> DataFrame:
    """Number the rows of each group from 0."""
    return running(df.drop(name), keys, buckets, order, {name: F.lit(1).cast("bigint")})
