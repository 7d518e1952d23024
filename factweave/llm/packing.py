"""Packing by concatenate and cut.

One pass encodes every document and stores its ids with its place within its partition. Sums of the partitions' totals give
each partition its place in the whole; a document's global place follows. The concatenation is cut every `length` ids; a
document that crosses a cut has a boundary record on either side. No sequence but the last is short of `length`.

Null or empty text: the end id alone. Repeated rows: each is packed. Empty table: no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.base import documents, table, written
from factweave.llm.subwords import encoder

#: Totals are broadcast up to this many partitions (24 bytes each), and joined by a shuffle beyond.
MOST_PARTS = 1_000_000
ENCODED = "doc_id long, part long, place long, n long, ids binary"


def encoded(docs: DataFrame, path: str, ranks: str | None, end_id: int) -> DataFrame:
    """Each document's ids with the end id, and its place among the ids of its partition."""
    last = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, place = encoder(path, ranks), TaskContext.get().partitionId(), 0
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part_of = b.slice(k, 500)
                ids = [e.ids(x) + last for x in part_of.column(1).to_pylist()]
                places, n = [], [len(x) // 4 for x in ids]
                for x in n:
                    places.append(place)
                    place += x
                yield pa.RecordBatch.from_arrays([part_of.column(0), pa.array([part] * len(n), pa.int64()), pa.array(places, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "part", "place", "n", "ids"])

    return documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def pack(docs: DataFrame, path: str, ranks: str | None = None, end_id: int = 1, length: int = 2048) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (binary, 32-bit little-endian), doc_tokens, sequence_id, offset, and whether the document goes on before or after."""
    rows = written(encoded(docs, path, ranks, end_id), "encoded", compression="zstd")
    totals = rows.groupBy("part").agg(F.max(F.col("place") + F.col("n")).alias("total"))
    first = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    first = written(first, "part_offsets")
    if first.count() <= MOST_PARTS:
        first = F.broadcast(first)
    g, end = F.col("g"), F.col("g") + F.col("n")
    k = F.col("sequence_id")
    lo, hi = F.greatest(g, k * length), F.least(end, (k + 1) * length)
    return (
        rows.join(first, "part")
        .withColumn("g", F.col("before") + F.col("place"))
        .select("doc_id", "n", "g", "ids", F.explode(F.sequence(F.floor(g / length), F.floor((end - 1) / length))).alias("sequence_id"))
        .select(
            "doc_id",
            (lo - g).alias("start"),
            (hi - lo).alias("length"),
            F.substring(F.col("ids"), ((lo - g) * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int")).alias("ids"),
            F.col("n").alias("doc_tokens"),
            "sequence_id",
            (lo - k * length).alias("offset"),
            (lo > g).alias("continues_earlier"),
            (hi < end).alias("continues_later"),
        )
    )


def packed_digest(docs: DataFrame) -> DataFrame:
    """pack() with the production tokenizer; each piece's ids by their crc32."""
    out = pack(docs, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continues_earlier", "continues_later")


def op4_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))
