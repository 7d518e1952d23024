"""Embedding whitening: the covariance's leading components by QDWH spectral divide-and-conquer, and the rows projected on them.

Spark sums: one pass gives exact sums of the integer coordinates, one the centred products, one the covariance of the
whitened values, and the last writes them. What meets on the driver is as large as the dimension squared, whatever the
number of rows. There the covariance is shifted, the polar factor of the shifted matrix (QR-based dynamically weighted
Halley iteration) gives the projector on the components above the shift, an orthonormal basis splits the matrix in two, and
each half is split again until single components are left.

Vectors that are null or empty, or hold null or non-finite entries, are dropped. The most frequent length of vector is the
table's (ties: the smaller); vectors of another length are dropped too, as they have no place in one covariance. A null vec_id stays. Repeated rows
count each. Entries beyond +-2**30 count as that. A direction without variance (eigenvalue not above dimension x machine
precision x trace) is no component, so a table of equal vectors, of one vector or of none gives no rows. Of equal
eigenvalues any orthonormal components come, the same for all rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.base import table
from factweave.llm.vectors import is_finite, matrix

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Entries are held to this before they are scaled, so that sums stay exact.
LARGEST = 2.0**30
EPS = np.finfo(float).eps


def polar(a: np.ndarray, least: float = 1e-17) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH; least is a lower bound of its singular values over their greatest."""
    x, l, one = a / np.linalg.norm(a), least, np.eye(len(a))  # noqa: E741
    for _ in range(30):
        l2 = l * l
        d = (4 * (1 - l2) / l2**2) ** (1 / 3)
        w = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d)))
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))
            new = b / c * x + (w - b / c) / np.sqrt(c) * q[: len(a)] @ q[len(a) :].T
        else:
            new = b / c * x + (w - b / c) * np.linalg.solve(one + c * x.T @ x, x.T).T
        new = (new + new.T) / 2
        l = min(1.0, l * (w + b * l2) / (1 + c * l2))  # noqa: E741
        moved, x = np.linalg.norm(new - x), new
        if abs(1 - l) < 10 * EPS and moved < EPS ** (1 / 3):
            break
    return x


def split(a: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The number of components above a shift, and an orthonormal basis whose first columns span them; None where all eigenvalues are one."""
    n, norm = len(a), np.linalg.norm(a)
    diagonal = np.sort(np.diag(a))
    spread = max(diagonal[-1] - diagonal[0], np.linalg.norm(a - np.diag(np.diag(a))))
    if spread <= 4 * EPS * norm:
        return None
    rng = np.random.default_rng(n)
    best: tuple[float, int, np.ndarray] | None = None
    # The mean of the diagonal lies strictly between the least and the greatest eigenvalue; the others are tried where a shift comes too near to one.
    for shift in (np.median(diagonal), diagonal.mean(), *(diagonal.mean() + spread * f for f in (0.01, -0.01, 0.03, -0.03, 0.1, -0.1))):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis = np.linalg.qr(projector @ rng.standard_normal((n, k)), mode="complete")[0]
        basis = np.linalg.qr(projector @ basis[:, :k], mode="complete")[0]
        left = float(np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]))
        if best is None or left < best[0]:
            best = left, k, basis
        if left <= 8 * n * EPS * norm:
            break
    return best and best[1:]


def spectrum(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most greatest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    cut = split(a) if len(a) > 1 else None
    if cut is None:
        order = np.argsort(-np.diag(a), kind="stable")[:most]
        return np.diag(a)[order], np.eye(len(a))[:, order]
    k, basis = cut
    parts = []
    for part, wanted in ((basis[:, :k], most), (basis[:, k:], most - k)):
        if wanted > 0:
            inner = part.T @ a @ part
            values, vectors = spectrum((inner + inner.T) / 2, wanted)
            parts.append((values, part @ vectors))
    values, vectors = np.concatenate([x for x, _ in parts]), np.hstack([x for _, x in parts])
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """n vectors; their sums; the integer next to each mean and what it lacks; components (falling), their eigenvalues, and the trace."""

    n: int
    sums: tuple[int, ...]
    whole: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    furthest: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    @property
    def fits(self) -> bool:
        """Whether every deviation fits in a long."""
        return len(self.sums) * self.furthest**2 < 2**63

    def deviation(self, x: np.ndarray) -> list:
        """The sum over dimensions of (n * x - sum)**2, exact."""
        if self.fits:
            wrapped = [(s + 2**63) % 2**64 - 2**63 for s in self.sums]  # the difference fits, its parts need not
            d = self.n * x - np.array(wrapped, dtype=np.int64)
            return (d * d).sum(1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return [Decimal(int(v)) for v in (d * d).sum(1)]


def integers(column: pa.Array, dim: int) -> np.ndarray:
    return np.floor(SCALE * np.clip(matrix(column, dim), -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """i, s, low, high, n of a partition's coordinates; a sum leaves before it could pass a long."""
    for batch in batches:
        if batch.num_rows:
            x = integers(batch.column(0), dim)
            yield pa.RecordBatch.from_pydict({"i": np.arange(dim, dtype=np.int32), "s": x.sum(0), "low": x.min(0), "high": x.max(0), "n": np.full(dim, len(x))})


def products(batches: Iterator[pa.RecordBatch], dim: int, row) -> Iterator[pa.RecordBatch]:
    """i, j, v: sums of products of row(x)'s columns over a partition, and with j = -1 the sums of the columns."""
    total = None
    for batch in batches:
        if batch.num_rows:
            y = row(integers(batch.column(0), dim))
            y = np.hstack([y, np.ones((len(y), 1))])
            total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        k = len(total) - 1
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_pydict({
            "i": np.concatenate([i, np.arange(k)]).astype(np.int32), "j": np.concatenate([j, np.full(k, -1)]).astype(np.int32), "v": np.concatenate([total[i, j], total[:k, k]])})


def covariance(rows: DataFrame, dim: int, row, n: int, k: int) -> np.ndarray:
    """The covariance (divisor n) of row(x), k columns whose mean is zero but for rounding; that rest is taken off."""
    parts = rows.mapInArrow(partial(products, dim=dim, row=row), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out, mean = np.zeros((k, k)), np.zeros(k)
    for p in parts:
        if p["j"] < 0:
            mean[p["i"]] = p["v"] / n
        else:
            out[p["i"], p["j"]] = out[p["j"], p["i"]] = p["v"] / n
    return out - np.outer(mean, mean)


def remaining(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, embedding of the rows that count, and the length of a vector (0: there is none)."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(is_finite("embedding"))
    most = good.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = most["dim"] if most else 0
    return good.where(F.size("embedding") == dim), dim


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """The components of rows (of remaining), all of them."""
    x = rows.select("embedding")
    agg = x.mapInArrow(partial(sums, dim=dim), "i int, s long, low long, high long, n long").groupBy("i")
    each = agg.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("i").collect()
    n, total = each[0]["n"], tuple(int(r["s"]) for r in each)
    whole = [round(s / n) for s in total]
    rest = np.array([(s - n * w) / n for s, w in zip(total, whole, strict=True)])
    furthest = max(max(n * r["high"] - s, s - n * r["low"]) for r, s in zip(each, total, strict=True))
    none = Whitening(n, total, np.array(whole, dtype=np.int64), rest, np.zeros((dim, 0)), np.zeros(0), 0.0, furthest)
    v = covariance(x, dim, none.centred, n, dim)
    values, vectors = spectrum(v, components)
    trace = float(np.trace(v))
    real = values > dim * EPS * trace
    vectors = vectors[:, real]
    largest = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])]
    return Whitening(n, total, none.whole, rest, vectors * np.where(largest < 0, -1, 1), values[real], trace, furthest)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation (a long, or where that is too small decimal(38,0)), whitened, explained, identity_error."""
    spark = vectors.sparkSession
    columns = "vec_id long, component int, n long, deviation {}, whitened double, explained double, identity_error double"
    rows, dim = remaining(vectors)
    if not dim:
        return spark.createDataFrame([], columns.format("long"))
    model = fit(rows, dim, components)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], columns.format("long"))
    error = float(np.abs(covariance(rows.select("embedding"), dim, model.whitened, model.n, k) - np.eye(k)).max())
    shared = spark.sparkContext.broadcast(model)  # dimension x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.int64() if m.fits else pa.decimal128(38, 0)
        for batch in batches:
            x = integers(batch.column(1), dim)
            size, at = len(x) * k, pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(at), "component": pa.array(np.tile(np.arange(1, k + 1), len(x)).astype(np.int32)), "n": pa.array(np.full(size, m.n)),
                "deviation": pa.array(m.deviation(x), kind).take(at), "whitened": pa.array(m.whitened(x).ravel()),
                "explained": pa.array(np.tile(m.values / m.trace, len(x))), "identity_error": pa.array(np.full(size, error))})

    return rows.mapInArrow(run, columns.format("long" if model.fits else "decimal(38,0)"))


def op13_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds (only from billions of rows on) is null here."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
