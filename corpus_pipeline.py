"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Defined cases, in all stages: an empty table gives an empty one; columns beside those of ``documents`` go through all but
the last, whatever their names; repeated rows are judged alike, and stay or go together in all but the near-duplicates'
stage; very long texts are read whole. Each stage says what it does with nulls."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import byte_bpe, decontamination, quality_classifier, quality_rules, simhash_dedup
from lectern.llm.common import shared_folder, table, training_rows


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled documents of its input.

    A null, empty or blank text is scored by the intercept; a row without doc_id is scored like any other."""
    rows = training_rows(docs, table(spark, sf_dir, "labels"), "quality", quality_classifier.TRAIN_ROWS)
    return quality_classifier.keep_predicted(docs, quality_classifier.fit(rows))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and aren't outliers of their language and source.

    A null text fails the base rule. Null languages and sources are groups of their own. A row without doc_id stays."""
    return quality_rules.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id; rows that repeat this id stay.

    Null, empty and blank texts are copies of each other. A row without doc_id stays and stands for no group."""
    return simhash_dedup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    A null or empty text holds none and stays. A row without doc_id is judged by its text. Null items are left out."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_split, offsets_crc32, ids of each document left.

    A null or empty text has no ids; doc_id may be null."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(byte_bpe.VOCABULARY), with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("quality rules", rules_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", tokens_stage),
]

#: SQL can't express the classifier, the estimates or the ids: the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
