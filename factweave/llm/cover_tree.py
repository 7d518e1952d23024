"""Embedding near-dedup: pairs of vectors within a cosine threshold, exact, by dual traversal of cover trees.

On unit vectors a cosine of at least t is a chord of at most sqrt(2 - 2 t), so the search is a metric one.

1. Vectors are scaled to unit length in double precision; equal unit vectors become one representative with its number of copies.
2. The upper level: at most CELLS pivots, taken farthest first from a bounded sample (the SAMPLE least digests; it only shapes
   the tree). Every representative goes to its nearest pivot's cell, and a cell of more than BLOCK representatives is dealt over several blocks by digest.
3. Within a block a cover tree is built in numpy: nested levels whose radii halve, each node the centre of what lies
   below it, with the exact radius that covers it. The blocks' trees are a table.
4. Dual traversal: pairs of cells, then pairs of blocks, then pairs of nodes are dropped where the distance of the
   centres exceeds the chord plus both covering radii; pairs of nodes that lie within the chord with all they cover are taken whole; the rest is
   opened, and nodes with many below them are compared by products of matrices. A task gives, for each representative that it links, how many vectors
   it linked and the root of its local component, never the pairs.
5. Components join these local roots.

Nothing is approximate: the sample shapes the cells only, and the bounds hold for every vector. In data without structure (isotropic in many
dimensions) no triangle inequality rules out much, and step 4 compares most blocks by matrix products.

Vectors that are null, empty or zero, or hold null or non-finite entries, link with nothing; vectors of different length don't link. Rows of one vec_id
count as vectors of their own, and share an id. A null vec_id is the least. Ties of the least id don't matter. An empty table gives no rows. Other
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.base import table, written
from factweave.llm.near_join import components
from factweave.llm.vectors import by_length

THRESHOLD = 0.9
#: Pivots of the upper level, and the sample they are taken from: what the driver holds at most.
CELLS, SAMPLE = 64, 2048
#: Representatives of a block on average, and blocks that travel together.
BLOCK, BUNDLE = 1024, 8
#: Pairs of nodes looked at in one go; a pair that opens into more than WIDE is opened alone.
DENSE, WIDE = 1 << 16, 4096
#: Nodes of no more points are opened into these at once, where a product of matrices is made.
SMALL = 32
#: Bounds are widened by this (a chord of 0 comes out as 1e-8 at most), and cosines so near to the threshold are summed again in one fixed order.
SLACK = 1e-7
#: Bounds on products in single precision, which only choose what is looked at in double precision.
SINGLE = 1e-4


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim, unit (bytes of doubles), digest; dim 0 and no unit where a vector links with nothing."""
    for batch in batches:
        n = batch.num_rows
        dims, units = np.zeros(n, dtype=np.int32), [None] * n
        for at, x in by_length(batch.column(1)):
            largest = np.abs(x).max(1)
            good = np.isfinite(x).all(1) & (largest > 0)
            x = x[good] / largest[good, None]  # squares neither overflow nor vanish
            x = x / np.sqrt((x * x).sum(1))[:, None] + 0.0  # no -0.0
            dims[at[good]] = x.shape[1]
            for i, u in zip(at[good].tolist(), x, strict=True):
                units[i] = u.tobytes()
        digests = [u and hashlib.blake2b(u, digest_size=16).digest() for u in units]
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "dim": dims, "unit": pa.array(units, pa.binary()), "digest": pa.array(digests, pa.binary())})


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Places of up to most rows, each the farthest from those before it: a prefix is a net for the distance at which the next one lies."""
    out, near = [0], np.full(len(x), np.inf)
    for _ in range(min(most, len(x)) - 1):
        near = np.minimum(near, 2 - 2 * x @ x[out[-1]])
        far = int(near.argmax())
        if near[far] <= SLACK:
            break
        out.append(far)
    return np.array(out)


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Tree:
    """A cover tree over a block's unit vectors: nested levels, radii 2, 1, 1/2, ...; every node is a stretch of the points in order."""

    def __init__(self, x: np.ndarray):
        d = chord(x, x)
        np.fill_diagonal(d, 0.0)
        n = len(x)
        near, at = d[0].copy(), np.zeros(n, dtype=np.int64)  # each point's nearest centre so far
        centres, parent, order, radius = [0], [-1], np.full(n, -1), 2.0
        order[0] = 0
        level = [0]
        while (near > 0).any() and radius > 1e-12:
            radius /= 2
            depth, above = level[-1] + 1, at.copy()  # a new centre's parent is the nearest centre of the levels above
            while (far := near > radius).any():
                new = int(far.argmax())
                parent.append(int(above[new]))
                order[new] = len(centres)
                centres.append(new)
                level.append(depth)
                closer = d[new] < near
                near[closer], at[closer] = d[new][closer], new
            if len(centres) == n:
                break
        # What is left lies on a centre.
        for p in np.flatnonzero(order < 0).tolist():
            parent.append(int(at[p]))
            centres.append(p)
            level.append(level[-1])
        children: dict[int, list[int]] = {}
        for c, p in zip(centres[1:], parent[1:], strict=True):
            children.setdefault(p, []).append(c)
        depth_of = dict(zip(centres, level, strict=True))
        self.order: list[int] = []
        self.nodes: list[tuple[int, int, int, float, tuple[int, ...]]] = []  # centre, start, end, radius, children
        self._lay(d, centres[0], 0, children, depth_of)
        self.x = x[self.order]

    def _lay(self, d: np.ndarray, root: int, level: int, children: dict, depth_of: dict) -> None:
        """Nodes in post-order; a centre's node at a level holds itself at the next level and its children of that level."""
        order, nodes = self.order, self.nodes

        def lay(c: int, rest: list[int]) -> int:
            """The node of c with the children in rest (in order of level)."""
            start = len(order)
            if not rest:
                order.append(c)
                nodes.append((start, start, start + 1, 0.0, ()))
                return len(nodes) - 1
            depth = depth_of[rest[0]]
            own = [k for k in rest if depth_of[k] == depth]
            below = [lay(c, rest[len(own) :]), *(lay(k, children.get(k, [])) for k in own)]
            end = len(order)
            nodes.append((start, start, end, float(d[c][order[start:end]].max()), tuple(below)))
            return len(nodes) - 1

        lay(root, children.get(root, []))

    def packed(self) -> dict:
        nodes = self.nodes
        first = np.cumsum([0] + [len(k[4]) for k in nodes])
        return {
            "starts": np.array([k[1] for k in nodes], dtype=np.int32).tobytes(), "ends": np.array([k[2] for k in nodes], dtype=np.int32).tobytes(),
            "radii": np.array([k[3] for k in nodes]).tobytes(), "first": first.astype(np.int32).tobytes(),
            "children": np.array([c for k in nodes for c in k[4]], dtype=np.int32).tobytes(), "units": self.x.tobytes()}


class Block:
    """A tree as read from the table. A node's centre is its first point; the last node is the root."""

    def __init__(self, row, dim: int, offset: int):
        self.x = np.frombuffer(row.units).reshape(-1, dim)
        self.single = self.x.astype(np.float32)
        self.rids, self.copies = np.frombuffer(row.rids, dtype=RID), np.frombuffer(row.copies, dtype=np.int64)
        self.start, self.end, self.first, self.children = (np.frombuffer(x, dtype=np.int32) for x in (row.starts, row.ends, row.first, row.children))
        self.radius = np.frombuffer(row.radii)
        self.before = np.concatenate([[0], np.cumsum(self.copies)])
        self.count = np.diff(self.first)
        self.offset, self.links = offset, np.zeros(len(self.x), dtype=np.int64)
        self.root = len(self.start) - 1
        self.leaf = np.zeros(len(self.x), dtype=np.int64)  # each point's own node
        single = np.flatnonzero(self.count == 0)
        self.leaf[self.start[single]] = single


    def below(self, node: int) -> np.ndarray:
        return self.child(np.full(max(self.count[node], 1), node), np.arange(max(self.count[node], 1)))

    def parted(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """What a node opens into: the points of its small nodes, and the others."""
        below = self.below(node)
        small = self.end[below] - self.start[below] <= SMALL
        size = (self.end - self.start)[below[small]]
        return np.repeat(self.start[below[small]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), below[~small]

    def child(self, nodes: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th child of each node; a node without children stands for itself."""
        if not len(self.children):
            return nodes
        return np.where(self.count[nodes] > 0, self.children[np.minimum(self.first[nodes] + k, len(self.children) - 1)], nodes)


class Sets:
    """Components of a task's points, joined many at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            if (a == b).all():
                return
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def crossed(a: Block, ps: np.ndarray, b: Block, qs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of nodes, every pair of what they open into."""
    ca, cb = np.maximum(a.count[ps], 1), np.maximum(b.count[qs], 1)
    n = ca * cb
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return a.child(ps[pair], k // cb[pair]), b.child(qs[pair], k % cb[pair])


def traverse(a: Block, b: Block, sets: Sets, threshold: float) -> None:
    """Counts in a.links and b.links the vectors that points of a and of b link, and joins these in sets. a may be b.

    Pairs of nodes wait as arrays, DENSE at a time; one pair that opens into more than WIDE others is opened by a product of matrices.
    """
    reach = float(np.sqrt(2 - 2 * threshold))
    todo: list[tuple[np.ndarray, np.ndarray]] = [(np.array([a.root]), np.array([b.root]))]
    near_points = 1 - (reach + SLACK) ** 2 / 2 - SINGLE

    def taken(ps: np.ndarray, qs: np.ndarray) -> None:
        """Pairs of nodes that link with all they cover."""
        for mine, own, other, others in ((a, ps, b, qs), (b, qs, a, ps)):
            weight = other.before[other.end[others]] - other.before[other.start[others]]
            alone = mine.end[own] - mine.start[own] == 1
            np.add.at(mine.links, mine.start[own[alone]], weight[alone])
            ks, first, back = np.unique(own[~alone], return_index=True, return_inverse=True)
            extra = np.zeros(len(ks), dtype=np.int64)
            np.add.at(extra, back, weight[~alone])
            for k, more, o in zip(ks.tolist(), extra.tolist(), (other.offset + other.start[others[~alone][first]]).tolist(), strict=True):
                mine.links[mine.start[k] : mine.end[k]] += more
                covered = mine.offset + np.arange(mine.start[k] + 1, mine.end[k])
                sets.join(covered, np.full(len(covered), o))  # all that a node covers links with the other node's centre
        sets.join(a.offset + a.start[ps], b.offset + b.start[qs])

    def met(ps: np.ndarray, qs: np.ndarray) -> None:
        """Pairs of nodes: dropped, taken whole, decided (single points), or to be opened."""
        for k in range(0, len(ps), DENSE):
            p, q = ps[k : k + DENSE], qs[k : k + DENSE]
            at_a, at_b = a.start[p], b.start[q]
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", a.x[at_a], b.x[at_b]), 0))
            radii = a.radius[p] + b.radius[q]
            near, whole = d <= reach + radii + SLACK, d + radii <= reach - SLACK
            points = near & ~whole & (a.end[p] - at_a == 1) & (b.end[q] - at_b == 1)
            if points.any():
                decided(at_a[points], at_b[points])
            if whole.any():
                taken(p[whole], q[whole])
            if (rest := near & ~whole & ~points).any():
                todo.append((p[rest], q[rest]))

    def decided(i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of points, by the distance itself; what is within rounding of the threshold is summed again, in one order whichever the shapes."""
        s = np.einsum("ij,ij->i", a.x[i], b.x[j])
        hit = s >= threshold
        for k in np.flatnonzero(np.abs(s - threshold) <= SLACK).tolist():
            hit[k] = float((a.x[i[k]] * b.x[j[k]]).sum()) >= threshold
        i, j = i[hit], j[hit]
        np.add.at(a.links, i, b.copies[j])
        np.add.at(b.links, j, a.copies[i])
        sets.join(a.offset + i, b.offset + j)

    def opened(p: int, q: int) -> None:
        """One pair of nodes with many below them: points by points in single precision, nodes of more than SMALL points by their bounds."""
        same = a is b and p == q
        (points_a, wide_a), (points_b, wide_b) = a.parted(p), b.parted(q)
        for k in range(0, len(points_a), 1024):
            rows, columns = np.nonzero(a.single[points_a[k : k + 1024]] @ b.single[points_b].T >= near_points)
            i, j = points_a[k + rows], points_b[columns]
            decided(i[i < j], j[i < j]) if same else decided(i, j)
        if same:  # each pair of nodes once, then each node with itself
            rows, columns = np.triu_indices(len(wide_a), 1)
            met(wide_a[rows], wide_a[columns])
            todo.extend((np.array([k]), np.array([k])) for k in wide_a.tolist())
        else:
            met(np.repeat(wide_a, len(wide_b)), np.tile(wide_b, len(wide_a)))
            met(np.repeat(a.leaf[points_a], len(wide_b)), np.tile(wide_b, len(points_a)))
        met(np.repeat(wide_a, len(points_b)), np.tile(b.leaf[points_b], len(wide_a)))

    while todo:
        ps, qs = todo.pop()
        alone = np.maximum(a.count[ps], 1) * np.maximum(b.count[qs], 1) > WIDE
        if a is b:
            alone |= ps == qs
        for p, q in zip(ps[alone].tolist(), qs[alone].tolist(), strict=True):
            if a.count[p] or b.count[q]:
                opened(p, q)
        if not alone.all():
            met(*crossed(a, ps[~alone], b, qs[~alone]))


RID = "V16"
LINKED = "rid binary, root binary, n_links long"
TREE = "bundle long, block long, rids binary, copies binary, units binary, starts binary, ends binary, radii binary, first binary, children binary, radius double"


def built(g: pd.DataFrame, dim: int) -> pd.DataFrame:
    """The cover tree of a block."""
    g = g.sort_values("rid", kind="stable")
    tree = Tree(np.frombuffer(b"".join(g["unit"])).reshape(-1, dim))
    rids, copies = b"".join(g["rid"].iloc[tree.order]), g["copies"].to_numpy(dtype=np.int64)[tree.order]
    return pd.DataFrame([{"bundle": g["bundle"].iat[0], "block": g["block"].iat[0], "rids": rids, "copies": copies.tobytes(), "radius": tree.nodes[-1][3], **tree.packed()}])


def compared(key: tuple, g: pd.DataFrame, dim: int, threshold: float) -> pd.DataFrame:
    """rid, root, n_links of what the blocks of two bundles (or of one) link with each other."""
    left, right = key
    blocks, offset = [], 0
    for row in g.sort_values("block").itertuples():
        blocks.append((row.bundle, Block(row, dim, offset)))
        offset += len(blocks[-1][1].x)
    sets, reach = Sets(offset), float(np.sqrt(2 - 2 * threshold))
    for i, (p, a) in enumerate(blocks):
        for q, b in blocks[i:]:
            if {p, q} != {left, right}:
                continue
            if a is b or chord(a.x[:1], b.x[:1])[0, 0] <= reach + a.radius[-1] + b.radius[-1] + SLACK:
                traverse(a, b, sets, threshold)
    rids, links = np.concatenate([b.rids for _, b in blocks]), np.concatenate([b.links for _, b in blocks])
    at = np.flatnonzero(links)
    return pd.DataFrame({"rid": rids[at].tolist(), "root": rids[sets.label[at]].tolist(), "n_links": links[at]})


def celled(batches: Iterator[pa.RecordBatch], dim: int, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Representatives with the cell of their nearest pivot and their distance from it."""
    for batch in batches:
        if batch.num_rows:
            d = chord(np.frombuffer(b"".join(batch.column("unit").to_pylist())).reshape(-1, dim), pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "distance"])


def linked_of(reps: DataFrame, dim: int, threshold: float, block: int) -> DataFrame:
    """rid, root, n_links: what representatives of one length (rid, copies, unit) link, from each task that compared them."""
    spark = reps.sparkSession
    sample = reps.orderBy("rid").limit(SAMPLE).select("unit").collect()
    points = np.stack([np.frombuffer(r["unit"]) for r in sample])
    pivots = points[farthest_first(points, CELLS)]
    cells = written(reps.mapInArrow(partial(celled, dim=dim, pivots=pivots), "rid binary, copies long, unit binary, cell int, distance double"), "cells")
    # At most CELLS rows.
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).orderBy("cell").collect()
    first, rows, at = {}, [], 0
    for r in sizes:
        parts = -(-r["n"] // block)
        first[r["cell"]] = at
        rows.append((r["cell"], at, parts))
        at += parts
    dealt = spark.createDataFrame(rows, "cell int, first long, parts long")
    number = F.col("first") + F.pmod(F.xxhash64("rid"), F.col("parts"))
    blocked = cells.join(F.broadcast(dealt), "cell").select("rid", "copies", "unit", number.alias("block"), F.floor(number / BUNDLE).cast("long").alias("bundle"))
    trees = written(blocked.groupBy("block").applyInPandas(lambda g: built(g, dim), TREE), "trees")
    # Pairs of cells whose bounds meet; a cell's blocks lie in consecutive bundles.
    reach, radii = float(np.sqrt(2 - 2 * threshold)), np.array([r["radius"] for r in sizes])
    d = chord(pivots[[r["cell"] for r in sizes]], pivots[[r["cell"] for r in sizes]])
    meet = np.argwhere(np.triu(d <= reach + radii[:, None] + radii[None, :] + SLACK))
    spans = [(f // BUNDLE, (f + p - 1) // BUNDLE) for _, f, p in rows]
    pairs = spark.createDataFrame([(*spans[i], *spans[j]) for i, j in meet.tolist()], "a0 long, a1 long, b0 long, b1 long").distinct()
    pairs = pairs.select(F.explode(F.sequence("a0", "a1")).alias("a"), "b0", "b1").repartition("a").select("a", F.explode(F.sequence("b0", "b1")).alias("b"))
    pairs = pairs.select(F.least("a", "b").alias("left_bundle"), F.greatest("a", "b").alias("right_bundle")).distinct()
    wanted = pairs.select("left_bundle", "right_bundle", F.explode(F.array_distinct(F.array("left_bundle", "right_bundle"))).alias("bundle"))
    return trees.join(wanted, "bundle").groupBy("left_bundle", "right_bundle").applyInPandas(lambda key, g: compared(key, g, dim, threshold), LINKED)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = written(ids.mapInArrow(unit_rows, "vec_id long, dim int, unit binary, digest binary"), "unit_vectors")
    least = lambda c: F.min(F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("id"))).alias("least")
    reps = rows.where("dim > 0").groupBy(F.col("digest").alias("rid")).agg(least("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"), F.first("dim").alias("dim"))
    reps = written(reps.select("rid", F.col("least.id").alias("least_id"), "copies", "unit", "dim"), "representatives")
    parts = reps.sparkSession.createDataFrame([], LINKED)
    for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        if r["n"] > 1:
            parts = parts.unionByName(linked_of(reps.where(F.col("dim") == r["dim"]).select("rid", "copies", "unit"), r["dim"], threshold, block))
    parts = written(parts, "linked")
    labels = components(parts.select("rid", "root"))
    least_of = labels.join(reps.select("rid", "least_id"), "rid").groupBy("label").agg(least("least_id"))
    found = parts.groupBy("rid").agg(F.sum("n_links").alias("links")).join(labels, "rid").join(least_of, "label").select("rid", "links", F.col("least.id").alias("component"))
    each = reps.select("rid", "least_id", "copies").join(found, "rid", "left").select(
        "rid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("links").isNull(), F.col("least_id")).otherwise(F.col("component")).alias("component_id"))
    out = rows.where("dim > 0").select("vec_id", F.col("digest").alias("rid")).join(each, "rid").select("vec_id", "n_links", "component_id")
    alone = rows.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs, and all that a vector reaches by links.
SQL = """WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1) LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM link GROUP BY 1) USING (vec_id)"""
