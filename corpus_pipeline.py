"""The corpus pipeline: quality, near-duplicates, secrets, mixture, pieces.

Every stage takes a table of documents (doc_id, text, lang, source, n_chars and any further columns)
and, but for the last, returns one. Nulls, empty texts, repeated rows and an empty table are as the
stage's operator states; no stage drops a row for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import mixing, pieces, quality, secrets, simhash
from quillon.llm.common import discard, materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    It learns from the labelled ones among these, whole texts of a bounded number. Empty and null
    texts are judged as any other; without labels the share of good ones decides for all alike.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: that of least doc_id, null ids last. Texts without words are one class."""
    return simhash.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in them replaced by a mark; null and empty texts stay as they are."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, shard by shard; a null source is a source, null texts have no words."""
    return mixing.mix(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with the digest of what they decode to; a row for each row, null texts without ids."""
    return pieces.encoded(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: The quality stage compresses and the last one merges pairs, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again for the next, then deleted.

    An empty table goes through all stages and gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)
    return docs
