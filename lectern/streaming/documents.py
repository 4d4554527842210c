"""The stateless operators over streams. They are functions of a row, so a stream's plan is the batch plan; only
counts over time need state, which watermarks bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import sentences
from lectern.operators.preflight import preflight_column
from lectern.plans.formatter import Options, reformat_documents


def stream_of(spark, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    """Documents as Parquet files arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_sentences(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sid", "sentence"))


def stream_preflight(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.inline(preflight_column("text")))


def stream_reformatted(documents: DataFrame, options: Options = Options()) -> DataFrame:
    return reformat_documents(documents, options)


def counts_by_window(documents: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Documents and sentences by event time, in windows one after the other, or with ``slide`` in overlapping ones; rows
    later than ``late`` are dropped and their state with them."""
    rows = documents.withWatermark(time, late).select(time, F.size(sentences(F.col("text"))).alias("n"))
    return rows.groupBy(F.window(time, window, slide)).agg(F.count("*").alias("documents"), F.sum("n").alias("sentences"))


def counts_by_session(documents: DataFrame, time: str, key: str, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows by key and session: rows of a key with less than ``gap`` between each and the next. State ends with the
    watermark; a batch is merged within each task before it is shuffled."""
    rows = documents.withWatermark(time, late).select(time, key)
    return rows.groupBy(key, F.session_window(time, gap).alias("window")).agg(F.count("*").alias("n"))


def write_parquet(frame: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    out = frame.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
