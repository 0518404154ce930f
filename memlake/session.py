"""Spark session defaults and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    # All calendar arithmetic converts to the configured zone explicitly.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small shuffles, split hot join keys, switch
    # to broadcast only once the measured side is below the threshold.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.unionOutputPartitioning": "false",
}


def plain_unions(spark: SparkSession) -> None:
    """A union that keeps its inputs' partitioning fails where the adaptive plan coalesces the inputs differently."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def small_batches(spark: SparkSession) -> None:
    """Batches that tasks hand to Python hold about 4 MB. The default of 64 MB is held several times over, rounded up to
    powers of two, beside the heap: by each task and by its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def build_session(app: str = "memlake", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own; on a local master a fresh one where none is named.

    Executors of a cluster do not see the driver's disk, so that a cluster
    without `spark.checkpoint.dir` is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="memlake-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as a table under the shared checkpoint folder and continue from the written rows.

    Used where several branches read one expensive result, in loops, and before
    a table that is being read gets overwritten. A written table is computed
    once, where `checkpoint()` runs the last stage twice; it survives the loss
    of executors and is read back with column pruning and known sizes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
