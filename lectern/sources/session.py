"""Checkpoints in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the checkpoint folder. Where none is named, a temporary one in local mode, and an error on a
    cluster, whose machines wouldn't see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    shared_folder(df.sparkSession, "cut")  # sees to it that there is one
    return df.checkpoint()


#: Stored bytes of a table for one task.
SMALL = 8 << 20


def parts(df: DataFrame) -> int | None:
    """In how many tasks ``spread`` deals out a table; None if Spark doesn't know its size."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # Spark's mark for an unknown size
        return None
    return max(1, -(-size // (SMALL * cores))) * cores  # as many for each core


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """A table dealt out to all cores, in more tasks than those if it is larger, so that a task's part doesn't grow with the
    table: one file of one row group is one task, however many cores there are, and a task reads up to 128 MB of files,
    which what is made of its rows exceeds many times. A table whose size Spark doesn't know stays as it is. key: a column
    of many values by which rows are dealt out, so that later steps by it needn't do so again."""
    n = parts(df)
    return df if not n else df.repartition(n, key) if key else df.repartition(n)
