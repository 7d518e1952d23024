"""N-gram Jaccard join by a MinHash LSH forest.

Texts that are equal word for word form one class and go on as one representative. Each representative has a signature, read
as `TREES` sequences of `DEPTH` labels; a tree is the prefix trie of one of these sequences, and a trie's node holds the representatives that share a prefix. Only
nodes of two or more are kept, from the prefix length `LEAST` on down to the full length. Representatives that meet in a node are gathered under
its least one, the hub, with the longest prefix at which they met. Of all that met at `LEAST`, those count that met at the matched prefix: it is
sought from the full length, a label shorter at a time, until the links that are expected to be missed are within the target recall in each band of similarity in
which links were found (shortened()). It is one length for the whole table; corpora whose copies are all close need no short prefixes. `LEAST` is the length at which two texts at the threshold meet with the target recall, whatever was found.

Groups are verified exactly on sets of five-word shingles. A group above `BLOCK` texts, or of more than `BLOCK_SHINGLES` shingles, is cut into blocks that all
hold the hub, and every two blocks are then compared, so no link is lost, and no task or row holds an unbounded group. For that a text is dealt out once for each
tile of `TILE` texts, not for each block. The comparisons grow with the square of
a group's size, as the number of its links does. Where only classes are
wanted (deduplicated()), texts that are not joined to the hub within their block are compared with every text of the group, block by block,
which loses no link that would join two classes. Only a tree of links and the number of links leave a block or a pair of tiles, never all pairs.

Classes are the connected components of the links, found by spreading the least label. n_links of a document is the number of
documents it was verified to be linked with, word-for-word copies included; each pair of texts is counted in one place, whatever groups it meets in.

Null or empty text: no words; such texts equal each other. Texts of fewer than five words match only word for word. Null doc_id: sorted after all others, so
it names or stands for a class only if it is alone in it. Repeated rows: one row out for each. Empty table: no rows. Other columns are left out or, by deduplicated(), kept.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.base import documents, table, written
from factweave.llm.shingles import Shingles, chunks, mixed, signatures, words

THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.9995
BLOCK = 256
BLOCK_SHINGLES = 1_000_000
#: Texts, or shingles, of a tile: the blocks of a group that meet those of another tile in one task, which compares them block by block.
TILE = 1024
TILE_SHINGLES = 1_000_000
#: Lower ends of the bands of similarity; the first takes in what is estimated below it, since estimates vary.
BANDS = (0.8, 0.85, 0.9, 0.95)
#: Candidates are broadcast to filter the texts up to this many (some 50 bytes each), and joined by a shuffle beyond.
MOST_CANDIDATES = 400_000


def meeting(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that two texts share a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix in which two texts at the threshold meet, in some tree, with at least the target recall; 1 if none does."""
    return next((d for d in range(depth, 0, -1) if meeting(threshold, d, trees) >= recall), 1)


LEAST = prefix_length()


def shortened(found: dict[tuple[int, int], int], least: int = LEAST, recall: float = RECALL) -> int:
    """The prefix length to stop at. found: pairs by the band of their estimated similarity and the longest prefix they share.

    Texts of similarity s that share a prefix of length d in some tree are meeting(s, d) of all that there are. Every band of which a pair was found at any
    length must have the target recall at its lower end, and no pair may be found at shorter prefixes alone.
    """
    there = [sum(n for (b, _), n in found.items() if b == band) for band in range(len(BANDS))]
    for d in range(DEPTH, least, -1):
        if all(meeting(x, d) >= recall for x, n in zip(BANDS, there, strict=True) if n) and all(at >= d for _, at in found):
            return d
    return least


SIGNED = "doc_id long, text_hash long, digest string, n_shingles long, labels array<int>"


def signed(docs: DataFrame) -> DataFrame:
    """Each text's digest of words, and its labels, tree by tree (none for texts without shingles)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf["text"].tolist()
            for lo, hi in chunks(texts):
                split = [words(t) for t in texts[lo:hi]]
                s = Shingles(split)
                labels = (mixed(signatures(s, TREES * DEPTH)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                which = np.cumsum(s.n > 0) - 1
                part = pdf.iloc[lo:hi]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"],
                    "text_hash": part["text_hash"],
                    "digest": [hashlib.blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=16).hexdigest() for w in split],
                    "n_shingles": s.n,
                    "labels": [labels[which[k]] if s.n[k] else [] for k in range(len(split))],
                })

    return documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, SIGNED)


def forest(reps: DataFrame, least: int = LEAST) -> DataFrame:
    """rid, hub, depth: the representatives that meet a node's hub, and the longest prefix they do so at.

    Tries are walked from the shortest prefix down: below a node of one there is nothing to find.
    """
    node = lambda d: F.xxhash64(F.lit(d), "tree", F.slice("path", 1, d))
    trees = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.slice("labels", t * DEPTH + 1, DEPTH).alias("path")))).alias("x")
    paths = reps.where(F.size("labels") > 0).select("rid", trees).select("rid", "x.*")
    met = None
    for d in range(least, DEPTH + 1):
        at = paths.withColumn("key", node(d))
        nodes = at.groupBy("key").agg(F.min("rid").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
        at = at.join(nodes, "key").select("rid", "tree", "path", "hub")
        paths = written(at, "paths", compression="zstd") if d == least else at
        own = paths.select("rid", "hub", F.lit(d).alias("depth"))
        met = own if met is None else met.unionByName(own)
        paths = paths.drop("hub")
    return met.groupBy("hub", "rid").agg(F.max("depth").alias("depth"))


def candidates(reps: DataFrame, least: int | None = None) -> DataFrame:
    """hub, rid, n_shingles: who meets at the prefix length that the target recall asks for, each hub with itself."""
    least = least or LEAST
    met = written(forest(reps, least), "forest")
    signs = written(reps.join(met.select("rid").distinct(), "rid", "left_semi").select("rid", "labels", "n_shingles"), "forest_labels", compression="zstd")
    hubs = signs.select(F.col("rid").alias("hub"), F.col("labels").alias("hub_labels"))
    same = F.size(F.filter(F.zip_with("labels", "hub_labels", lambda a, b: a == b), lambda x: x)) / (TREES * DEPTH)
    band = sum((same >= x).cast("int") for x in BANDS[1:])
    pairs = met.where("rid <> hub").join(signs, "rid").join(hubs, "hub").where(same >= BANDS[0] - 0.1)
    found = {(r["band"], r["depth"]): r["count"] for r in pairs.select(band.alias("band"), "depth").groupBy("band", "depth").count().collect()}
    return met.where(F.col("depth") >= shortened(found, least)).join(signs.select("rid", "n_shingles"), "rid").select("hub", "rid", "n_shingles")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets of distinct numbers; the shared numbers are taken some thousand at a time."""
    m = len(sets)
    if m <= 6:
        own = [set(x.tolist()) for x in sets]
        return np.array([[len(a & b) for b in own] for a in own])
    every = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    _, column, n = np.unique(every, return_inverse=True, return_counts=True)
    shared = n > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    out = np.zeros((m, m), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((m, width), dtype=np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def linked(texts: list[str], threshold: float = THRESHOLD) -> np.ndarray:
    """For every two texts, whether their sets of shingles have at least the threshold's Jaccard similarity. Texts without shingles match none."""
    return linked_sets([np.unique(exact_shingles(t)) for t in texts], threshold)


def linked_sets(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    n = np.array([len(x) for x in sets])
    both = intersections(sets)
    either = n[:, None] + n[None, :] - both
    out = both >= threshold * np.maximum(either, 1)
    out &= n[:, None] > 0
    np.fill_diagonal(out, False)
    return out


def exact_shingles(text: str) -> np.ndarray:
    """Shingles by 64-bit numbers: two different ones agree with a probability of 2 ** -64."""
    return Shingles([words(text)]).h


def roots(links: np.ndarray) -> list[int]:
    """The first member of each one's connected component."""
    out = [-1] * len(links)
    for k in range(len(links)):
        if out[k] < 0:
            out[k], todo = k, [k]
            while todo:
                for x in np.flatnonzero(links[todo.pop()]).tolist():
                    if out[x] < 0:
                        out[x] = k
                        todo.append(x)
    return out


VERIFIED = "hub long, rid long, root long, part int, n_links long, open boolean"


def verified(grouped: DataFrame, cross: bool) -> DataFrame:
    """Each member's root within its group, the links counted there, and whether it is still open: in a group that was cut, and not joined to the hub.

    role: 1 in a group that was cut, else 0. cross: only links between members of role 1 (of one block, or open) and others (0, or 2 if open
    themselves) are looked for, and those counted that no first block and no lesser hub has counted; with role 3, those between members of
    different parts. A text is given as its sorted shingles where grouped has these.
    """
    given = cross or "shingles" in grouped.columns

    def shared(keys: list[list[int]]) -> np.ndarray:
        """Whether two members have a key in common."""
        place: dict[int, int] = {}
        row = [i for i, own in enumerate(keys) for _ in own]
        column = [place.setdefault(x, len(place)) for own in keys for x in own]
        held = np.zeros((len(keys), len(place)), dtype=np.float32)
        held[row, column] = 1
        return held @ held.T > 0

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates(["rid", "role"] if cross else "rid")
        rids, parts, hub, gid = g["rid"].tolist(), g["part"].to_numpy(), g["hub"].iat[0], g["gid"].iat[0]
        links = linked_sets([x.view(np.uint64) for x in g["shingles"]]) if given else linked(g["text"].tolist())
        copies = g["n_copies"].to_numpy()
        role = g["role"].to_numpy()
        gids, hubs = [list(x) for x in g["gids"]], [list(x) for x in g["hubs"]]

        def met(before: int | None) -> np.ndarray:
            """Whether two texts meet in a group, of those less than before if given."""
            of = [[(x, h) for x, h in zip(*own, strict=True) if before is None or x < before] for own in zip(gids, hubs, strict=True)]
            out = shared([[x for x, _ in own] for own in of])
            at = defaultdict(list)
            for i, x in enumerate(rids):
                at[x].append(i)
            for i, own in enumerate(of):
                for _, h in own:
                    for j in at.get(h, ()):
                        out[i, j] = out[j, i] = True
            return out

        if cross:
            links &= (role == 1)[:, None] ^ (role == 1)[None, :]
            links &= np.array(rids)[:, None] != np.array(rids)[None, :]
            counted = links & ~met(None) & ~shared([[h for h in own if h < hub] for own in hubs])
            counted[role == 2] = False
        else:
            counted = links
            if any(len(x) > 1 or x and x[0] != gid for x in gids):  # two texts may meet in other groups too: the least counts them
                counted = links & ~met(gid)
        root = roots(links)
        at_hub = root[rids.index(hub)] if hub in rids else None
        cut = bool((role == 1).any()) and not cross
        return pd.DataFrame({"hub": hub, "rid": rids, "root": [rids[k] for k in root], "part": parts, "n_links": counted @ copies, "open": [cut and k != at_hub for k in root]})

    def tiles(g: pd.DataFrame) -> pd.DataFrame:
        """Two tiles, or one with itself, block by block: the links of each member and its root in these tiles, without members that have none."""
        g = g.drop_duplicates(["rid", "role"])
        if "text" in g:
            g = g.assign(shingles=[np.unique(exact_shingles(t)).view(np.int64) for t in g["text"]]).drop(columns="text")
        if (g["role"] == 3).any():
            blocks = [x for _, x in g.groupby("part")]
            pairs = ((a.assign(role=1), b.assign(role=0)) for k, a in enumerate(blocks) for b in blocks[k + 1 :])
        else:
            left, right = ([x.iloc[k : k + BLOCK] for k in range(0, len(x), BLOCK)] for x in (g[g["role"] == 1], g[g["role"] != 1]))
            pairs = ((a, b) for a in left for b in right)
        parent: dict[int, int] = {}
        n_links: dict[int, int] = defaultdict(int)

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for a, b in pairs:
            out = one(pd.concat([a, b], ignore_index=True))
            for rid, root, n in zip(out["rid"].tolist(), out["root"].tolist(), out["n_links"].tolist(), strict=True):
                n_links[rid] += n
                parent[find(rid)] = find(root)
        rows = [(x, find(x), n) for x, n in n_links.items()]
        found = np.array([x for x in rows if x[2] or x[0] != x[1]], dtype=np.int64).reshape(-1, 3)  # typed, if empty too: ids must not become floats
        hub = np.full(len(found), g["hub"].iat[0], dtype=np.int64)
        return pd.DataFrame({"hub": hub, "rid": found[:, 0], "root": found[:, 1], "part": np.zeros(len(found), np.int32), "n_links": found[:, 2], "open": np.zeros(len(found), bool)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None

        def done() -> pd.DataFrame:
            return (tiles if cross else one)(pd.concat(held, ignore_index=True))

        for pdf in frames:
            out = []
            for gid, g in pdf.groupby("gid", sort=False):
                if held and gid != last:
                    out.append(done())
                    held.clear()
                held.append(g)
                last = gid
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield done()

    return grouped.repartition("gid").sortWithinPartitions("gid").mapInPandas(run, VERIFIED)


def components(edges: DataFrame) -> DataFrame:
    """rid, label: the least rid that the edges (rid, root) join it with. Labels spread along edges and along labels until none changes."""
    nodes = edges.select("rid").union(edges.select(F.col("root").alias("rid"))).distinct()
    edges = written(edges.where("rid <> root").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("root").alias("rid"), F.col("rid").alias("root")))
    labels = written(nodes.select("rid", F.col("rid").alias("label")), "labels")
    while True:
        seen = labels.withColumnsRenamed({"rid": "root", "label": "near"})
        least = both.join(seen, "root").groupBy("rid").agg(F.min("near").alias("near"))
        near = labels.join(least, "rid", "left").select("rid", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("rid").alias("new"), F.col("label").alias("far"))
        after = written(near.join(jump, "new", "left").select("rid", "label", F.least("new", "far").alias("new")), "labels")
        changed = after.where("new < label").limit(1).count()
        labels = after.select("rid", F.col("new").alias("label"))
        if not changed:
            return labels


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, text of the representatives in wanted (distinct rids)."""
    rows = documents(docs).select(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rid"), "text")
    n = wanted.count()
    return rows.join(F.broadcast(wanted) if n <= MOST_CANDIDATES else wanted, "rid", "left_semi")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """rid, shingles: the distinct shingles, sorted as unsigned numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"rid": pdf["rid"], "shingles": [np.unique(exact_shingles(t)).view(np.int64) for t in pdf["text"]]})

    return texts.select("rid", "text").mapInPandas(run, "rid long, shingles array<long>")


def tile_pairs(placed: DataFrame) -> DataFrame:
    """hub, rid, part, role, gid: every two tiles of each group that was cut, role 1 in that of the lesser number, and each tile with itself, role 3. The hub was compared with all."""
    members = placed.where("role = 1 and rid <> hub").select("hub", "rid", "part", "tile", "tiles").repartition("rid")  # a large group is spread before it grows
    pairs = members.select("hub", "rid", "part", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    role = F.when(F.col("tile") == F.col("other"), 3).otherwise((F.col("tile") < F.col("other")).cast("int"))
    return pairs.select("hub", "rid", "part", role.alias("role"), F.xxhash64("hub", F.least("tile", "other"), F.greatest("tile", "other")).alias("gid"))


def classes(docs: DataFrame, threshold_prefix: int | None = None, count: bool = True) -> DataFrame:
    """doc_id, text_hash, class_id (the least doc_id of the class), n_links, is_kept (one row of each class). Without count, n_links lacks links within classes across blocks."""
    signs = written(signed(docs), "signed", compression="zstd").withColumn("rid", F.xxhash64("doc_id", "text_hash"))
    # n_copies counts rows; of equal words the least (doc_id, text_hash) stands for all.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "rid")).alias("least")
    reps = written(
        signs.groupBy("digest").agg(least, F.count(F.lit(1)).alias("n_copies"), F.first("labels").alias("labels"), F.first("n_shingles").alias("n_shingles"))
        .select("digest", F.col("least.rid").alias("rid"), "n_copies", "labels", "n_shingles"), "representatives", compression="zstd")
    met = written(candidates(reps, threshold_prefix), "met")
    sizes = met.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("n_shingles"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.col("n") - 1, F.ceil(F.col("n_shingles") / BLOCK_SHINGLES))).cast("int")
    part = F.when(F.col("rid") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rid", F.lit(1)), F.col("blocks")).cast("int")))
    tiles = F.least(blocks, F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("n_shingles") / TILE_SHINGLES)).cast("int"))
    placed = met.drop("n_shingles").join(sizes.where("n > 1").select("hub", blocks.alias("blocks"), tiles.alias("tiles")), "hub").select("hub", "rid", "blocks", "tiles", (F.col("blocks") > 1).cast("int").alias("role"), F.explode(part).alias("part"))
    placed = written(placed.withColumns({"gid": F.xxhash64("hub", "part"), "tile": F.floor(F.col("part") * F.col("tiles") / F.col("blocks")).cast("int")}), "placed")
    # A representative is in as many groups as there are tries at most, besides those of which it is the hub.
    groups = placed.where("rid <> hub").groupBy("rid").agg(F.collect_set(F.struct("gid", "hub")).alias("groups")).select("rid", F.col("groups.gid").alias("gids"), F.col("groups.hub").alias("hubs"))
    texts = written(texts_of(docs, placed.select("rid").distinct()), "texts", compression="zstd").dropDuplicates(["rid"])
    copies = reps.select("rid", "n_copies")
    none = F.array().cast("array<long>")
    about = placed.select("rid").distinct().join(copies, "rid").join(groups, "rid", "left").withColumns({"gids": F.coalesce("gids", none), "hubs": F.coalesce("hubs", none)})
    about = written(about, "about")
    grouped = placed.join(about, "rid").join(texts, "rid").select("gid", "hub", "rid", "n_copies", "gids", "hubs", "part", "role", "text")
    first = written(verified(grouped, False), "verified")
    if count:
        cut = placed.where("role = 1 and rid <> hub").select("rid").distinct()
        sets = written(shingle_sets(texts.join(cut, "rid", "left_semi")), "sets", compression="zstd")
        second = tile_pairs(placed).join(about, "rid").join(sets, "rid").select("gid", "hub", "rid", "n_copies", "gids", "hubs", "part", "role", "shingles")
        first = first.unionByName(written(verified(second, True), "verified"))
    still = None if count else written(first.where("open").select("hub", "rid", "part").distinct(), "open")
    if still is not None and still.limit(1).count():
        # Open texts are dealt to tiles of their own, by their shingles' share in the group too.
        n_open = still.groupBy("hub").agg(F.count(F.lit(1)).alias("n_open"))
        n_open = n_open.join(sizes.select("hub", tiles.alias("tiles"), "n"), "hub").select("hub", "tiles", F.least(F.col("tiles"), F.ceil(F.col("n_open") * F.col("tiles") / F.col("n")) + 1).cast("int").alias("lefts"))
        members = placed.where("rid <> hub").select("hub", "rid", "part", "tile").join(n_open.drop("tiles"), "hub")
        one = still.join(n_open, "hub").select("hub", "rid", "part", F.lit(1).alias("role"), F.pmod(F.xxhash64("rid", F.lit(2)), F.col("lefts")).cast("int").alias("left"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("right"))
        other = members.join(still.select("hub", "rid", F.lit(2).alias("role")), ["hub", "rid"], "left").select("hub", "rid", "part", F.coalesce("role", F.lit(0)).alias("role"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("left"), F.col("tile").alias("right"))
        crossed = one.unionByName(other).withColumn("gid", F.xxhash64("hub", "left", "right"))
        second = crossed.join(about, "rid").join(texts, "rid").select("gid", "hub", "rid", "n_copies", "gids", "hubs", "part", "role", "text")
        first = first.unionByName(written(verified(second, True), "verified"))
    labels = components(first.select("rid", "root"))
    counts = first.groupBy("rid").agg(F.sum("n_links").alias("linked"))
    found = reps.select("digest", "rid", "n_copies").join(labels, "rid", "left").join(counts, "rid", "left")
    found = written(found.select("digest", "rid", F.coalesce("label", "rid").alias("label"), (F.col("n_copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "found")
    members = written(signs.select("doc_id", "text_hash", "digest").join(found, "digest"), "members")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    least = members.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(place).alias("first"))
    return members.join(least, "label").select("doc_id", "text_hash", "class_id", "n_links", (place == F.col("first")).alias("is_kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns: of each class the document with the least doc_id (of repeated rows one)."""
    kept = classes(docs, count=False).where("is_kept").select("doc_id", "text_hash").distinct().alias("kept")
    own = F.xxhash64(F.coalesce(F.col("own.text"), F.lit("")))
    same = F.col("own.doc_id").cast("long").eqNullSafe(F.col("kept.doc_id")) & (own == F.col("kept.text_hash"))
    # Of the rows that repeat a kept row, one stays; ids are unique but for these, so id and text deal the rows evenly.
    return docs.alias("own").join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


__all__ = ["candidates", "classes", "components", "deduplicated", "linked", "op9_lsh_forest", "prefix_length", "roots"]
