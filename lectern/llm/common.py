"""Helpers that the operators share: tables, checkpoints, folds and bounded id filters."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most ids that a filter broadcasts (16 bytes each); beyond it the filter is a shuffled join.
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder; where none is named, a temporary one in local mode and an error on a cluster, whose
    machines wouldn't see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the one that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose workers give memory back as they go: they live on for other stages, and
    what their allocators hold counts for the executor."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in run(batches):
                yield out
                del out
                pa.default_memory_pool().release_unused()
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return df.mapInArrow(tidy, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out from every training set."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't among ``ids`` (one column, doc_id); rows without an id stay.

    ids: cut to a checkpoint by the caller, as they are counted first.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``limit`` labelled documents outside fold 0, the first by hash of their id.

    Labels of an id that disagree count as the smaller one, and so do texts of a repeated id (the smallest as a string), so
    the driver gets ``limit`` rows at most; rows without id, label or text are left out.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return [(r.text, r.y) for r in sorted(one.collect(), key=lambda r: r.doc_id)]
