"""Suggestions for many fields: an inverted index of the trigrams of their distinct values, kept as tables.

Values lie sorted in blocks, and the index names the blocks that a trigram occurs in: neighbours share most of their trigrams, so it is far shorter than a list of
values for each trigram. A search of three characters or more takes the blocks that hold all its trigrams and then looks at the texts themselves, so its rows
are those of a scan; a shorter one scans the distinct values. For each field the values that begin with the search come first, then by lower case,
then by themselves, up to a cap.

Blank and missing values are never suggested. Case is ignored. An empty search suggests every field's first values. A field without values has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions.text import present
from factweave.sources.shared import new_path

GRAM, CAP = 3, 20
#: Bits of the number of values in a block.
BLOCK_BITS = 12


def values_of(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """field, value, n: the distinct present values of each field's column, one pass over rows."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), present(F.col(c).cast("string")).alias("value")) for f, c in fields.items()])
    return rows.select(F.explode(cells).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def grams(value: Column) -> Column:
    """The distinct trigrams of a text in lower case; none of a shorter text."""
    low = F.lower(value)
    n = F.char_length(low) - GRAM + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: low.substr(i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Index:
    """values: field, value, n, block, sorted by block. postings: gram, block, sorted by gram. So a search reads few row groups of either."""

    values: DataFrame
    postings: DataFrame

    @classmethod
    def built(cls, rows: DataFrame, fields: dict[str, str]) -> Index:
        spark = rows.sparkSession
        values_path, postings_path = new_path(spark, "suggest-values"), new_path(spark, "suggest-grams")
        # The id numbers the values of a sorted partition one after the other: its upper bits are a block of neighbours. It is written, so a table has it once for all.
        block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
        values_of(rows, fields).sortWithinPartitions("field", "value").withColumn("block", block).write.parquet(values_path)
        values = cls._read(spark, values_path, "field string, value string, n long, block long")
        postings = values.select(F.explode(grams(F.col("value"))).alias("gram"), "block").distinct()
        postings.sortWithinPartitions("gram").write.parquet(postings_path)
        return cls(values, cls._read(spark, postings_path, "gram string, block long"))

    @staticmethod
    def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(path)

    def search(self, text: str, cap: int = CAP, fields: tuple[str, ...] | None = None) -> DataFrame:
        """field, value, n, place (from 1)."""
        low = text.lower()
        wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        values = self.values if fields is None else self.values.where(F.col("field").isin(*fields))
        if wanted:
            hits = self.postings.where(F.col("gram").isin(*wanted)).groupBy("block").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(wanted))
            # A row of 8 bytes for each 4096 values at most.
            values = values.join(F.broadcast(hits.select("block")), "block", "left_semi")
        lower = F.lower("value")
        found = values.where(lower.contains(low))
        order = [F.when(lower.startswith(low), 0).otherwise(1), lower, F.col("value")]
        place = F.row_number().over(Window.partitionBy("field").orderBy(*order))
        return found.withColumn("place", place).where(F.col("place") <= cap).select("field", "value", "n", F.col("place").cast("long").alias("place"))
