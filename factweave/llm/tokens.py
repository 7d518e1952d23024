"""Token counts with a digest cache.

The digest of a document's content and the digest of the tokenizer's version name a stored count. The content is normalised
in the one way that can't change a count: null becomes the empty text. Distinct contents that the cache lacks are encoded
once, whole, and their counts appended to the cache; every document then takes its count from the cache.

Null or empty text: 0 tokens. Repeated rows: one row out for each row in. Empty table: no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.base import documents, new_path, table
from factweave.llm.subwords import encoder, version_digest

CACHE = "content_digest string, tokenizer_digest string, n_tokens long"


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache as a table; empty where nothing has been stored."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def encode_misses(misses: DataFrame, path: str, ranks: str | None, version: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, ranks)
        for b in batches:
            digests = b.column(0)
            n = pa.array([e.count(x) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([digests, pa.array([version] * len(n), pa.string()), n], names=["content_digest", "tokenizer_digest", "n_tokens"])

    return misses.mapInArrow(run, CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, ranks: str | None = None, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row. cache: a folder that later calls may name again; None: a new one."""
    spark = docs.sparkSession
    version = version_digest(tokenizer)
    cache = cache or new_path(spark, "token_cache")
    rows = documents(docs).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_digest"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    mine = lambda: cached(spark, cache).where(F.col("tokenizer_digest") == version)
    misses = rows.groupBy("content_digest").agg(F.first("text").alias("text")).join(mine(), "content_digest", "left_anti")
    encode_misses(misses, tokenizer, ranks, version).write.mode("append").parquet(cache)
    counts = mine().groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have stored the same content
    return rows.drop("text").join(counts, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op2_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return out.withColumn("over_limit", F.col("n_tokens") > 512)
