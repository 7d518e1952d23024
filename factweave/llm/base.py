"""What the operators of this package share: reading, the shared work folder, label sampling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, in every contract of this package.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="factweave-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, readable after an executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), without the other columns; whatever else the table holds can't clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def crc_fold(column: str, modulus: int):
    """crc32 of the id as text, modulo; null ids fall in fold 0 of the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def label_table(labels: DataFrame, name: str) -> DataFrame:
    """doc_id, y (0 or 1): null labels are left out; where rows of one document disagree, the majority counts and a tie is 1."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).groupBy("doc_id").agg((F.avg(F.col(name).cast("double")) >= 0.5).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, name: str, modulus: int, held_out: int, per_class: int):
    """Texts and labels of at most per_class training documents of each class, as pandas, and the share of label 1 among all training labels.

    The documents are those with the least hash of their id, so that a run can be repeated. Only ids are sorted; the texts
    come by a join with the chosen ids, which are 2 * per_class at most. A document with several rows counts once.
    """
    y = label_table(labels, name).where(crc_fold("doc_id", modulus) != held_out)
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for c in (0, 1):
        part = y.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values("doc_id").reset_index(drop=True)
    total = sum(counts.values())
    return rows, (counts.get(1, 0) / total if total else 0.5)
