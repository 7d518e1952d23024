"""A corpus pipeline of five stages; counted as part of factweave.llm.

Each stage reads all that its predecessor kept, as a Parquet table. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import decontamination, near_join, quality, secrets
from factweave.llm.base import table, written
from factweave.llm.packing import packed_digest


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score by pairwise ranking is at the threshold or above."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id."""
    return near_join.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 or more."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked and n_chars counted anew."""
    return secrets.redact(docs, secrets.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packed_digest(docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", decontaminated), ("secrets", redacted), ("packing", packed)]

#: SQL has no near-duplicate classes, trained models or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
