"""What the operators of this folder share: tables, the shared folder, files in it."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.session import shared_folder


_WORKER_CACHES = []


def worker_cache(function):
    """``lru_cache`` for what a Python worker keeps from task to task, until a task calls ``drop_worker_caches``."""
    cached = lru_cache(function)
    _WORKER_CACHES.append(cached)
    return cached


def drop_worker_caches() -> None:
    """Lets go what tasks of other operators left in this Python worker; it would stay as long as the worker."""
    for cached in _WORKER_CACHES:
        cached.cache_clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder in the shared folder of the session."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written in the shared folder and read back: no lineage is left to recompute."""
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in(df: DataFrame, path: str) -> DataFrame:
    """As ``stored``, in a folder that ``discard`` removes later; frees what led to it."""
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Rows go to Python in batches of ``size`` in the jobs run here, however many a task has; a task holds a batch
    several times over, in the JVM and in Python. A setting of the session, put back at the end.
    """
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def release(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage: Spark then removes the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes stored tables that no later step reads."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def whole_text(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def open_store(path: str):
    """The pyarrow file system and the path in it, for any scheme that pyarrow can reach."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)
