"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    # All day, week and month buckets are UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # What a task gets after a shuffle: small enough to be joined, grouped and sorted in some hundred MB.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # What a task reads of a file: beyond 200 partitions it holds its rows in memory until they are sorted by partition.
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Let a hot join key be split even where a later grouping then needs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Bytes of stored tables (compressed, columns) for each partition that a shuffle starts with.
PARTITION_BYTES = 2 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the run-time settings the library relies on; cluster sizing is left to the cluster.

    With the size of the tables, shuffles start with partitions in proportion to it, at least
    ``spark.sql.shuffle.partitions``, and small ones are merged at run time. So a task's share does not
    grow with the tables.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if input_bytes is not None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(_INITIAL, max(least, math.ceil(input_bytes / PARTITION_BYTES)))
    return spark


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside it the shuffle files of an action go when the action ends; else they stay until the driver collects garbage.

    A stream takes the setting over when it starts. A frame that is run again makes its shuffles again.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of written files that nothing reads any more, on whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes of the files below these paths, on whatever file system they lie; none for what is not there."""
    total = 0
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(place):
            total += system.getContentSummary(place).getLength()
    return total


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for this run, below the folder named in ``spark.checkpoint.dir``.

    Without that setting a machine-local folder is used in local mode only, since the executors
    of a cluster could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="merchlake-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
