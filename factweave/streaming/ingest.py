"""New analyses as a stream of delimited files, appended to a table of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.sources.binding import triples

BUCKETS = 64


def stream(spark: SparkSession, folder: str, columns: tuple[str, ...], sep: str = ";") -> DataFrame:
    """The rows of files as they arrive in folder; all columns are text."""
    return spark.readStream.csv(folder, schema=", ".join(f"`{c}` string" for c in columns), sep=sep, header=True, quote='"', escape='"')


def append_triples(rows: DataFrame, properties: tuple[str, ...], target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Maps each batch to triples and appends those that target lacks; the batch's number names its part, so a batch that is run again replaces it.

    Triples lie in BUCKETS by a hash of their subject, so a batch meets only the buckets that its own subjects fall in.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = triples(batch, properties).distinct().withColumn("bucket", F.pmod(F.xxhash64("s"), F.lit(BUCKETS)).cast("int"))
        if number:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            known = spark.read.schema(new.schema).option("basePath", target).parquet(f"{target}/batch=*").where(F.col("bucket").isin(touched) & (F.col("batch") < number))
            new = new.join(known.select("bucket", "s", "p", "o"), ["bucket", "s", "p", "o"], "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number}")

    writer = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
