"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by size, in classes of which the largest is less than twice the smallest. For each class a document
is cut into blocks as long as the class's largest item, and every two neighbouring blocks form a window, so a passage that holds
an item lies in a window at most four times as large; so the Jaccard similarity of window and item is high enough for MinHash,
however long the document is. An item and a document that agree in any of 64 minima are a candidate; the share of the item's
distinct five-word shingles that the whole document has is then counted on the words themselves. An item that is contained whole in one
window is missed with a probability below (3/4) ** 64. An item that repeats a shingle, so that its distinct ones may be few for
its length, is looked up by each of its shingles instead and never missed.

Null or empty texts and those of fewer than five words have no shingles: such items are never found, such documents never
reported. Repeated rows: a pair is reported for each row of the document, and once for equal rows of an item. Empty tables: no rows. Other
columns are left out or, by decontaminated(), kept.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.base import documents, table
from factweave.llm.shingles import K, Shingles, chunks, multipliers, words

THRESHOLD = 0.8
N_HASHES = 64
#: Items go to the executors in blocks of at most about so many items and characters; more items mean more passes.
BLOCK_ITEMS = 20_000
BLOCK_CHARACTERS = 32_000_000
FOUND = "item_id long, doc_id long, n_item_shingles long, n_shared long, containment double"


class Items:
    """A block of test items: shingles, and for each size class and hash the items by their minimum."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.items: list[tuple[int, frozenset[tuple[str, ...]]]] = []
        self.classes: dict[int, list[dict[int, list[int]]]] = {}
        self.repeating: dict[int, list[int]] = defaultdict(list)
        a, b = multipliers(N_HASHES)
        for item_id, text in rows:
            w = words(text)
            if len(w) < K:
                continue
            own = frozenset(zip(*(w[j:] for j in range(K)), strict=False))
            h = np.unique(Shingles([w]).h)
            if len(h) < len(w) - K + 1:
                for x in h.tolist():
                    self.repeating[x].append(len(self.items))
                self.items.append((item_id, own))
                continue
            by_hash = self.classes.setdefault(1 << (len(w) - K + 1).bit_length(), [defaultdict(list) for _ in range(N_HASHES)])
            for j in range(N_HASHES):
                by_hash[j][int((h * a[j] + b[j]).min())].append(len(self.items))
            self.items.append((item_id, own))
        self.sorted = {size: [np.array(sorted(d), dtype=np.uint64) for d in by_hash] for size, by_hash in self.classes.items()}
        self.sorted_repeating = np.array(sorted(self.repeating), dtype=np.uint64)

    def candidates(self, s: Shingles) -> set[tuple[int, int]]:
        """(text, item) that agree in a minimum of some window, or in a shingle of an item that repeats one."""
        out: set[tuple[int, int]] = set()
        if not len(s.h) or not self.items:
            return out
        known = self.sorted_repeating
        if len(known):
            k = np.minimum(np.searchsorted(known, s.h), len(known) - 1)
            hits = np.flatnonzero(known[k] == s.h)
            of_hit = np.repeat(np.arange(len(s.n)), s.n)[hits]
            for text, x in set(zip(of_hit.tolist(), s.h[hits].tolist(), strict=True)):
                out.update((text, i) for i in self.repeating[x])
        a, b = multipliers(N_HASHES)
        cuts = {}
        for size in self.classes:
            n_blocks = -(-s.n // size)
            first = np.cumsum(n_blocks) - n_blocks
            of = np.repeat(np.arange(len(s.n)), n_blocks)
            cuts[size] = of, s.starts[of] + (np.arange(n_blocks.sum()) - first[of]) * size
        for j in range(N_HASHES):
            hj = s.h * a[j] + b[j]
            for size, (of, at) in cuts.items():
                low = np.minimum.reduceat(hj, at)
                same = of[1:] == of[:-1]
                low[:-1] = np.where(same, np.minimum(low[:-1], low[1:]), low[:-1])
                known = self.sorted[size][j]
                k = np.minimum(np.searchsorted(known, low), len(known) - 1)
                for hit in np.flatnonzero(known[k] == low):
                    out.update((int(of[hit]), i) for i in self.classes[size][j][int(low[hit])])
        return out

    def found(self, texts: list[str], threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item_id, n_item_shingles, n_shared, containment), verified."""
        for lo, hi in chunks(texts):
            split = [words(t) for t in texts[lo:hi]]
            by_text = defaultdict(list)
            for text, item in self.candidates(Shingles(split)):
                by_text[text].append(item)
            for text, found in by_text.items():
                w = split[text]
                own = set(zip(*(w[j:] for j in range(K)), strict=False))
                for i in sorted(found):
                    item_id, wanted = self.items[i]
                    n = len(wanted & own)
                    if n >= threshold * len(wanted):
                        yield lo + text, item_id, len(wanted), n, n / len(wanted)


def blocks(items: DataFrame) -> Iterator[Items]:
    """The items, a bounded block at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    n, characters = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    parts = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(characters / BLOCK_CHARACTERS))
    for k in range(parts):
        yield Items([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()])


def searched(shared: Broadcast, threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids = pdf["doc_id"].tolist()
            got = [(item, ids[text], n, k, c) for text, item, n, k, c in shared.value.found(pdf["text"].tolist(), threshold)]
            yield pd.DataFrame(got, columns=["item_id", "doc_id", "n_item_shingles", "n_shared", "containment"])

    return run


def cleared(shared: Broadcast, threshold: float):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            clean = np.ones(len(s), dtype=bool)
            clean[[text for text, *_ in shared.value.found(s.tolist(), threshold)]] = False
            yield pd.Series(clean)

    return F.pandas_udf(run, "boolean")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, doc_id, n_item_shingles, n_shared, containment of each item that a document holds to at least threshold."""
    rows = documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    share = docs.sparkSession.sparkContext.broadcast
    return reduce(DataFrame.unionByName, (rows.mapInPandas(searched(share(block), threshold), FOUND) for block in blocks(items)))


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, that hold no item to at least threshold."""
    share = docs.sparkSession.sparkContext.broadcast
    for block in blocks(items):
        docs = docs.where(cleared(share(block), threshold)(F.coalesce(F.col("text"), F.lit(""))))
    return docs


def op8_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Counts every shared shingle of every item and document.
SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
x AS (SELECT item_id, doc_id, count(*) AS k FROM bs JOIN ds USING (s) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, CAST(n AS BIGINT) AS n_item_shingles, CAST(k AS BIGINT) AS n_shared, CAST(k AS DOUBLE) / n AS containment
FROM x JOIN n USING (item_id) WHERE k >= 0.8 * n
"""
