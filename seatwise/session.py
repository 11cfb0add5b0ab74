"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster a
    machine-local folder would be lost with its machine, so there the setting is required.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@lru_cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"seatwise-{application}-")


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The result has no lineage to recompute, exact size statistics for the planner and column
    pruning on every later read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        # a partition's rows meet in few tasks, and Spark splits those that are large
        writer = df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """Number of tasks for work that is heavy per input row."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        3 * spark.sparkContext.defaultParallelism,
    )
