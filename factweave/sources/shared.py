"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a new folder, if all runs on this machine, else an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="factweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "kept", *sorted_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, readable after an executor is lost, and read by the columns that are used."""
    path = new_path(df.sparkSession, name)
    (df.sortWithinPartitions(*sorted_by) if sorted_by else df).write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parted(df: DataFrame, by: str, n: int, name: str) -> list[DataFrame]:
    """df written once in the shared folder, and read as a table for each number below n in its column by: each is as large to Spark's planner as its own files."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(by).parquet(path, compression="zstd")
    spark, schema = df.sparkSession, df.drop(by).schema

    def read(k: int) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{path}/{by}={k}")
        except AnalysisException:  # no row has this number
            return spark.createDataFrame([], schema)

    return [read(k) for k in range(n)]


def distinct_rows(df: DataFrame, digest: str | None = None) -> DataFrame:
    """df.distinct() where few rows are repeated: rows whose digest occurs once are distinct as they are and aren't shuffled, the others are compared whole.

    So only digests are dealt out, and two different rows of one digest do no harm. df is computed again for each use of it. digest: a column that is equal
    where the others are, if one is made more cheaply than from all of them; it is left out of the result.
    """
    columns = [c for c in df.columns if c != digest]
    rows = df.select(*columns, (F.col(digest) if digest else F.xxhash64(*columns)).alias("digest"))
    repeated = kept(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "repeated")
    if repeated.isEmpty():
        return rows.select(*columns)
    once_only = rows.join(repeated, "digest", "left_anti").select(*columns)
    return once_only.unionByName(rows.join(repeated, "digest", "left_semi").select(*columns).distinct())


def stem(column: str) -> Column:
    """A name without its digits. Equal names have equal stems, and names that are numbered alike share one, so stems are few."""
    return F.coalesce(F.translate(column, "0123456789", ""), F.lit(""))


def apart(rows: DataFrame, others: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """rows whose s may be one of others' s, by its stem (and by p, or other columns), and the rest. Both sides' rows stay where they are while the stems are few; rows is read twice."""
    by = by or ("p",)
    stems = kept(others.select(stem("s").alias("stem"), *by).distinct(), "stems")
    tagged = rows.withColumn("stem", stem("s"))
    return tuple(tagged.join(stems, ["stem", *by], how).select(*rows.columns) for how in ("left_semi", "left_anti"))


def state(spark: SparkSession, paths: list[str]) -> tuple:
    """What tells whether files have changed: their number and a sum over path, length and time of change. No file is opened."""
    files = spark.read.format("binaryFile").load(paths).select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    return tuple(files.agg(F.count(F.lit(1)), F.sum("h")).first())


_made: dict[tuple, tuple[str, StructType]] = {}


def once(spark: SparkSession, name: str, paths: list[str], make: Callable[[], DataFrame], folder_name: str | None = None) -> DataFrame:
    """The table that make gives, written once for each application and state of the files it is made from; made again if they change, or if it was cleared away."""
    key = (spark.sparkContext.applicationId, name, *state(spark, paths))
    if key in _made:
        path, schema = _made[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # the folder was cleared
            del _made[key]
    df, path = make(), new_path(spark, folder_name or name)
    df.write.parquet(path, compression="zstd")
    _made[key] = path, df.schema
    return spark.read.schema(df.schema).parquet(path)
