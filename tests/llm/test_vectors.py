"""Near duplicates by cover trees and whitening by QDWH against brute force, with odd vectors."""

import itertools

import numpy as np
import pandas as pd
import pytest

from factweave.llm import cover_tree, whitening

COLUMNS = "vec_id long, embedding array<float>, label int, rid string, n string, copies string, component string, dim string"
SF = "/root/testdata/sf0.001"


def frame(spark, vectors, kind="float", ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, *["x"] * 5) for i, v in zip(ids, vectors, strict=True)], COLUMNS.replace("float", kind)).repartition(3)


def clustered(seed=1, dim=12):
    """Isotropic vectors, near copies of one (a third of all), near copies of others, exact copies, scaled copies, chains at the threshold."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dim) for _ in range(220)]
    hot = rng.standard_normal(dim)
    out += [hot + rng.standard_normal(dim) * s for s in rng.choice([0.05, 0.2, 0.35], 180)]
    out += [out[k] + rng.standard_normal(dim) * 0.25 for k in range(40)]
    out += [out[3]] * 30 + [2 * out[3], 4 * out[5], 3 * out[5]]
    step = np.arccos(0.9) * 0.999
    out += [np.r_[np.cos(k * step), np.sin(k * step), np.zeros(dim - 2)] for k in range(9)]
    return [[float(np.float32(x)) for x in v] for v in out]


def brute(vectors, threshold=0.9):
    good = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(vectors[i], float) / np.max(np.abs(vectors[i])) for i in good}
    unit = {i: u / np.linalg.norm(u) for i, u in unit.items()}
    links = {i: {j for j in good if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold} for i in good}
    out = []
    for i in range(len(vectors)):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links.get(todo.pop(), set()) - seen)
            seen |= new
        out.append((i, len(links.get(i, ())), min(seen), min(seen) == i))
    return out


@pytest.mark.parametrize("block", [16, 1024])
def test_links_are_exact(spark, block):
    odd = [None, [], [0.0] * 12, [None] + [1.0] * 11, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [1.0] * 5, [1.0] * 5, [2.0, 2.0, 2.0, 2.0, 2.1], [3e38] * 12, [1e-38] * 12]
    vectors = clustered() + odd
    out = sorted(map(tuple, cover_tree.near_duplicates(frame(spark, vectors), block=block).collect()))
    assert out == brute(vectors)


def test_ids_repeat_and_are_null(spark):
    v = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.0, 1.0]]
    out = cover_tree.near_duplicates(frame(spark, v, ids=[7, 7, None, 3])).collect()
    assert sorted(map(str, out)) == sorted(map(str, [
        *[type(out[0])(vec_id=7, n_links=1, component_id=7, kept=True)] * 2, type(out[0])(vec_id=None, n_links=1, component_id=None, kept=True), type(out[0])(vec_id=3, n_links=1, component_id=None, kept=False)]))


def test_no_vectors(spark):
    none = frame(spark, [])
    assert cover_tree.near_duplicates(none).count() == 0 == whitening.whiten(none).count()
    alone = frame(spark, [[1.0, 2.0], None])
    assert sorted(map(tuple, cover_tree.near_duplicates(alone).collect())) == [(0, 0, 0, True), (1, 0, 1, True)]
    assert whitening.whiten(alone).count() == 0  # no variance, no component


def test_tree_covers():
    x = np.array([np.array(v) / np.linalg.norm(v) for v in clustered()])
    tree = cover_tree.Tree(np.unique(x, axis=0))
    assert sorted(tree.order) == list(range(len(tree.x)))
    for start, first, end, radius, below in tree.nodes:
        assert start == first and cover_tree.chord(tree.x[start][None], tree.x[start:end]).max() <= radius + cover_tree.SLACK
        assert [k for b in below for k in range(*tree.nodes[b][1:3])] == (list(range(start, end)) if below else [])


@pytest.mark.parametrize("block", [7, 64, 1000])
@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.97])
def test_traversal_against_all_pairs(threshold, block):
    """Trees and their traversal alone: links by all pairs of points, and their components."""
    x = np.array(clustered(block))
    x, copies = np.unique(x / np.linalg.norm(x, axis=1)[:, None], axis=0, return_counts=True)
    order = np.random.default_rng(block).permutation(len(x))
    parts = [order[k : k + block] for k in range(0, len(x), block)]
    frames = [pd.DataFrame({"rid": [int(i).to_bytes(16, "big") for i in p], "copies": copies[p], "unit": [x[i].tobytes() for i in p], "block": b, "bundle": b // 3}) for b, p in enumerate(parts)]
    trees = pd.concat([cover_tree.built(f, x.shape[1]) for f in frames])
    links, joined = np.zeros(len(x), dtype=int), cover_tree.Sets(len(x))
    for i, j in itertools.combinations_with_replacement(sorted(set(trees["bundle"])), 2):
        for rid, root, n in cover_tree.compared((i, j), trees[trees["bundle"].isin([i, j])], x.shape[1], threshold).itertuples(index=False):
            links[int.from_bytes(rid, "big")] += n
            joined.join(np.array([int.from_bytes(rid, "big")]), np.array([int.from_bytes(root, "big")]))
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    assert links.tolist() == (near @ copies).tolist()
    all_pairs = cover_tree.Sets(len(x))
    all_pairs.join(*np.nonzero(near))
    assert joined.label.tolist() == all_pairs.label.tolist()


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_other_thresholds(spark, threshold):
    vectors = clustered(2)
    out = cover_tree.near_duplicates(frame(spark, vectors, "double"), threshold, 64)
    if threshold < 1:
        assert sorted(map(tuple, out.collect())) == brute(vectors, threshold)
    else:
        assert {r["vec_id"]: r["n_links"] for r in out.collect()}[3] >= 30


def test_spectrum():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 40):
        for values in (rng.random(n), np.repeat(rng.random(n), 2)[:n], np.linspace(1, 1 + 1e-6, n), 10.0 ** -np.arange(n), np.zeros(n), np.ones(n), -rng.random(n)):
            q = np.linalg.qr(rng.standard_normal((n, n)))[0]
            a = (q * values) @ q.T
            a = (a + a.T) / 2
            for most in (1, 8, n):
                got, vectors = whitening.spectrum(a, most)
                k = min(most, n)
                np.testing.assert_allclose(got, np.sort(np.linalg.eigvalsh(a))[::-1][:k], atol=2e-14)
                np.testing.assert_allclose(vectors.T @ vectors, np.eye(k), atol=1e-13)
                np.testing.assert_allclose(a @ vectors, vectors * got, atol=1e-13)


def test_polar_factor():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar(a)
    values, vectors = np.linalg.eigh(a)
    np.testing.assert_allclose(u, (vectors * np.sign(values)) @ vectors.T, atol=1e-12)


def check_whitened(out, vectors, ids, k=8):
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(d) for d in ((n * x - s) ** 2).sum(1)]
    y = ((n * x - s) / n).astype(float)
    v = y.T @ y / n
    values = np.sort(np.linalg.eigvalsh(v))[::-1][:k]
    got = {}
    for r in out:
        got.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(got) == list(range(1, k + 1)) and all(sorted(g) == sorted(ids) for g in got.values())
    w = np.array([[got[c + 1][i]["whitened"] for c in range(k)] for i in ids])
    for c in range(k):
        one = got[c + 1]
        assert [one[i]["deviation"] for i in ids] == deviation and {r["n"] for r in one.values()} == {n}
        assert all(abs(r["explained"] / (values[c] / np.trace(v)) - 1) < 1e-9 for r in one.values())
        vector = y.T @ w[:, c] / n / np.sqrt(values[c])  # V v / e
        assert abs(np.linalg.norm(vector) - 1) < 1e-9
        np.testing.assert_allclose(w[:, c], y @ vector / np.sqrt(values[c]), atol=1e-9)
        np.testing.assert_allclose(v @ vector, values[c] * vector, atol=1e-9 * values[0])
    z = w - w.mean(0)
    error = np.abs(z.T @ z / n - np.eye(k)).max()
    assert error < 1e-9 and all(r["identity_error"] < 1e-9 for r in out)


def test_whitening(spark):
    vectors = clustered(4)
    odd = [None, [], [None] + [1.0] * 11, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [1.0] * 5]
    out = whitening.whiten(frame(spark, vectors + odd)).collect()
    check_whitened(out, vectors, range(len(vectors)))


def test_whitening_of_few_dimensions_and_large_entries(spark):
    rng = np.random.default_rng(9)
    vectors = [[float(a), float(b), float(a)] for a, b in rng.integers(-(2**29), 2**29, (50, 2))]
    out = whitening.whiten(frame(spark, vectors, "double"))
    assert dict(out.dtypes)["deviation"] == "decimal(38,0)"
    check_whitened(out.collect(), vectors, range(50), 2)  # the third direction has no variance


def test_queries(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    vectors = [r["embedding"] for r in rows]
    assert sorted(map(tuple, cover_tree.op11_cover_tree(spark, SF).collect())) == brute(vectors)
    out = whitening.op13_qdwh_whitening(spark, SF)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check_whitened(out.collect(), vectors, range(len(vectors)))
