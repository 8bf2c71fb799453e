"""The corpus pipeline: quality, exact dedup, near-duplicate join, source mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clipgrain.llm import exact_dedup, mixing, ngram_join, packing, quality
from clipgrain.llm.common import delete, ready, scratch, shared_folder, table
from clipgrain.llm.queries import MAX_REPETITION, tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score says they are clean.

    Null and empty texts are scored like others; rows that repeat are each scored and
    stay or go together; an empty table gives no rows; all columns are kept.
    """
    ready(spark)
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest doc_id.

    A null text is an empty one; where no row of a group has a doc_id, all stay; of rows
    that repeat doc_id and text one stays; an empty table gives no rows.
    """
    ready(spark)
    return exact_dedup.drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, 0.8) the row with the smallest doc_id.

    Rows without a doc_id, or without words, stay; rows that repeat a doc_id are judged by
    their own text; an empty table gives no rows.
    """
    ready(spark)
    return ngram_join.keep_one(docs, words=5, similarity=(80, 100))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources are drawn up to MAX_REPETITION times as often.

    A null source is one of its own; null and empty texts cost one token; an empty table gives no rows.
    """
    ready(spark)
    return mixing.mixed_documents(docs, max_repetition=MAX_REPETITION)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all drawn rows in sequences of 2048 tokens; a null or empty text is the end id alone, an empty table gives no rows."""
    ready(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality classifier", good), ("exact dedup", distinct), ("n-gram Jaccard join", dissimilar), ("source mixing", mixed), ("packing", packed)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again by the next.

    A stage's table is deleted once the next one is written. The last one, in the shared
    folder under ``corpus-pipeline-``, is the result and belongs to the caller.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        if i:
            delete(spark, f"{folder}/{i - 1}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
