"""Sharding by fixed virtual slots.

Records are hashed into thousands of virtual slots by their text, so equal texts share a slot; the bytes of each slot are
summed; a versioned map from slots to shards, kept as a table, is made from these sums and edited when shards are rebalanced:
only the slots that must move change their shard. A group of equal texts larger than an eighth of a shard has a slot of its own, so that two of them
need not share one; only a group larger than a whole shard, which no shard could hold and stay near the others' size, is dealt over as many slots as it fills shards, by a hash of doc_id.

Null or empty text: 16 bytes. Repeated rows: each is a record. Empty table: no rows. Other columns are left out.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.base import documents, new_path, table, work_dir, written

OVERHEAD = 16
SLOTS = 4096
#: A group of equal texts above this share of a shard has slots of its own.
GROUP_SHARE = 1 / 8


def balanced_map(slot_bytes: dict[int, int], n_shards: int, n_slots: int = SLOTS) -> dict[int, int]:
    """The largest slot first, each to the shard that has least so far; ties go to the lower number."""
    loads = [(0, s) for s in range(n_shards)]
    out = {}
    for slot in sorted(range(n_slots), key=lambda k: (-slot_bytes.get(k, 0), k)):
        load, shard = heapq.heappop(loads)
        out[slot] = shard
        heapq.heappush(loads, (load + slot_bytes.get(slot, 0), shard))
    return out


def rebalanced_map(old: dict[int, int], slot_bytes: dict[int, int], n_shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """old, edited: slots of shards that are gone, and then slots of the fullest shards, move to the emptiest ones until all are within tolerance of the mean."""
    out = dict(old)
    loads = dict.fromkeys(range(n_shards), 0)
    homeless = []
    members: dict[int, list[int]] = {s: [] for s in loads}
    for slot, shard in sorted(old.items()):
        if shard in loads:
            loads[shard] += slot_bytes.get(slot, 0)
            members[shard].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda k: (-slot_bytes.get(k, 0), k)):
        to = min(loads, key=lambda s: (loads[s], s))
        out[slot], loads[to] = to, loads[to] + slot_bytes.get(slot, 0)
        members[to].append(slot)
    mean = sum(loads.values()) / n_shards
    for _ in range(len(out)):
        full, least = max(loads, key=lambda s: (loads[s], -s)), min(loads, key=lambda s: (loads[s], s))
        gap = loads[full] - loads[least]
        fits = [k for k in members[full] if 0 < slot_bytes.get(k, 0) < gap]
        if loads[full] <= mean * (1 + tolerance) and loads[least] >= mean * (1 - tolerance) or not fits:
            break
        slot = min(fits, key=lambda k: (abs(slot_bytes[k] - gap / 2), k))
        out[slot] = least
        members[full].remove(slot)
        members[least].append(slot)
        loads[full] -= slot_bytes[slot]
        loads[least] += slot_bytes[slot]
    return out


def save_map(spark: SparkSession, path: str, slot_map: dict[int, int], slot_bytes: dict[int, int], version: int) -> None:
    rows = [(k, s, int(slot_bytes.get(k, 0))) for k, s in sorted(slot_map.items())]
    spark.createDataFrame(rows, "virtual_slot int, shard int, bytes long").coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """virtual_slot, shard, bytes: as many rows as slots."""
    return spark.read.parquet(f"{path}/version={version}")


def records(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return documents(docs).select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("content"),
    )


def with_slots(rows: DataFrame, n_shards: int, n_slots: int = SLOTS) -> tuple[DataFrame, int]:
    """rows with virtual_slot, and the number of slots. Large groups are at most n_shards / GROUP_SHARE, so they are numbered here and broadcast."""
    groups = rows.groupBy("content").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    shard_bytes = max(1.0, total / n_shards)
    own, first = [], n_slots
    for r in groups.where(F.col("bytes") > shard_bytes * GROUP_SHARE).orderBy("content").collect():
        parts = math.ceil(r["bytes"] / shard_bytes)
        own.append((r["content"], first, parts))
        first += parts
    large = rows.sparkSession.createDataFrame(own, "content long, first_slot int, parts int")
    hashed = F.pmod(F.xxhash64("content"), F.lit(n_slots)).cast("int")
    slot = F.coalesce(F.col("first_slot") + F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), hashed)
    return rows.join(F.broadcast(large), "content", "left").withColumn("virtual_slot", slot).drop("parts", "first_slot", "content"), first


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, and slot: the record's place within its shard, from 0 without gaps.

    Places come from two sums: the records of the shard's earlier virtual slots, and the record's number within its own.
    """
    spark = docs.sparkSession
    rows, n_slots = with_slots(written(records(docs), "records"), n_shards, n_slots)
    rows = written(rows, "slotted")
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # n_slots rows at most
    slot_bytes = {r["virtual_slot"]: r["bytes"] for r in sums}
    n = {r["virtual_slot"]: r["n"] for r in sums}
    slot_map = balanced_map(slot_bytes, n_shards, n_slots)
    path = map_path or new_path(spark, "slot_map")
    save_map(spark, path, slot_map, slot_bytes, 1)
    before, first = dict.fromkeys(range(n_shards), 0), []
    for k in sorted(slot_map):
        first.append((k, slot_map[k], before[slot_map[k]]))
        before[slot_map[k]] += n.get(k, 0)
    places = spark.createDataFrame(first, "virtual_slot int, shard int, first_place long")
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("k", F.row_number().over(w).cast("long"))
    return numbered.join(F.broadcast(places), "virtual_slot").select("doc_id", "size", "text_crc32", "shard", (F.col("first_place") + F.col("k") - 1).alias("slot"), "virtual_slot")


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


__all__ = ["balanced_map", "load_map", "op7_virtual_slots", "rebalanced_map", "save_map", "shard", "work_dir"]
