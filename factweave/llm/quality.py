"""Quality by Bradley-Terry pairwise ranking.

A document's score is linear in its features. Preference pairs put a training document of label 1 before one of label 0; the
logistic loss on the difference of their features is minimised. The threshold is the quantile of training scores
that leaves the share of label 1 above it; the published score is the logistic function of the distance to the threshold, so
0.5 is the threshold. All training documents take part: the bins are their quantiles (by Spark's percentile_approx, to one rank in 100,000), and
documents are dealt to groups of about `GROUP` by a hash of their id; in a group, every document of the one label is compared with every one of the other.
Each group of the more frequent label meets one of the rarer, whose documents meet several where they are few. Newton's method needs only the sums over groups.

Null or empty text: all features 0, scored like any other. Labels that are null or disagree: see base.label_table. Without
labels of both classes every score is the share of label 1. Repeated rows: one row out for each. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.base import crc_fold, documents, label_table, table, written

#: Documents of the more frequent label in a group, and of the rarer one at the least, where there are so many.
GROUP, FEW = 2048, 32
ROUNDS, DECAY = 25, 1e-4
SYMBOLS = b"#*$%&|<>^~@\\{}[]+=_"
#: A bound of this module's own numbers, for the bins below.
BINS = 12
NAMES = ("length", "words", "word_length", "distinct", "common", "upper", "digits", "symbols", "pairs", "exclaims", "stops", "line_words", "line_repeats", "shrinks", "alone", "long_word", "capitals")


def features(text: str) -> list[float]:
    """Whole-text measures, each by a few passes of compiled code."""
    b = text.encode("utf-8", "replace")
    n = len(b)
    words = b.split()
    if not words:
        return [0.0] * len(NAMES)
    k = len(words)
    distinct = set(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    gone = lambda chars: (n - len(b.translate(None, chars))) / n
    most = max(Counter(words).values()) / k
    return [
        np.log1p(n),
        np.log1p(k),
        n / k,
        len(distinct) / k**0.8,
        most,
        gone(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        gone(b"0123456789"),
        gone(SYMBOLS),
        sum(map(b.count, (b"###", b"***", b"$$$", b"%%%", b"&&&", b"!!", b"|", b"??", b".."))) / k,
        gone(b"!?"),
        gone(b".,;:"),
        np.log1p(k / len(lines)),
        1 - len(set(lines)) / len(lines),
        len(zlib.compress(b, 1)) / n,
        sum(map(b.count, (b" | ", b" - ", b" * "))) / k,
        max(map(len, distinct)),
        sum(1 for w in words if w[:1].isupper()) / k,
    ]


class Ranking:
    """Bins of each feature, a weight for each bin, the threshold and the scale."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, threshold: float, scale: float, constant: float | None = None):
        self.edges, self.weights, self.threshold, self.scale, self.constant = edges, weights, threshold, scale, constant

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum(self.weights[j][np.searchsorted(self.edges[j], x[:, j], side="right")] for j in range(x.shape[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) * self.scale, -50, 50)))


def pair_sums(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over all pairs of a row of a before one of b (bins of each feature, numbered through): their number, the loss, its downward slope, and the upper triangle of its second derivatives."""
    one_hot = lambda bins: np.eye(len(w))[bins].sum(1)
    zb, sb, ends, weights = one_hot(b), w[b].sum(1), np.zeros(len(b)), np.zeros(len(b))
    loss, slope, second = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
    for k in range(0, len(a), 512):
        za = one_hot(a[k : k + 512])
        d = np.clip(w[a[k : k + 512]].sum(1)[:, None] - sb, -500, 500)
        wrong = 1 / (1 + np.exp(d))
        v = wrong * (1 - wrong)
        loss += np.logaddexp(0, -d).sum()
        slope += za.T @ wrong.sum(1)
        ends += wrong.sum(0)
        weights += v.sum(0)
        cross = za.T @ (v @ zb)
        second += (za * v.sum(1)[:, None]).T @ za - cross - cross.T
    second += (zb * weights[:, None]).T @ zb
    return np.concatenate([[len(a) * len(b), loss], slope - zb.T @ ends, second[np.triu_indices(len(w))]])


def least(sums: Callable[[np.ndarray], np.ndarray], size: int, decay: float = DECAY, rounds: int = ROUNDS) -> np.ndarray:
    """The weights of least mean loss over the pairs, by Newton's method; a step that makes it larger is halved. sums: pair_sums of weights, over all groups."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        got = sums(w)
        upper = np.zeros((size, size))
        upper[np.triu_indices(size)] = got[2 + size :] / got[0]
        return got[1] / got[0] + decay / 2 * w @ w, got[2 : 2 + size] / got[0] - decay * w, upper + np.triu(upper, 1).T + decay * np.eye(size)

    w = np.zeros(size)
    loss, slope, second = at(w)
    for _ in range(rounds):
        step = np.linalg.solve(second, slope)
        while (now := at(w + step))[0] > loss and np.abs(step).max() > 1e-4:
            step = step / 2
        if now[0] > loss:
            break
        w, gained = w + step, loss - now[0]
        loss, slope, second = now
        if gained < 1e-6:
            break
    return w


def numbered(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each feature, numbered through."""
    return np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(x.shape[1])], 1) + BINS * np.arange(x.shape[1])


def train(x: np.ndarray, y: np.ndarray, rate: float, rounds: int = ROUNDS, decay: float = DECAY) -> Ranking:
    """The fit of few documents, as one group: what fit() finds over many."""
    if not (y == 1).any() or not (y == 0).any():
        return Ranking(np.zeros((0, 0)), np.zeros((0, 0)), 0.0, 1.0, float(np.mean(y)) if len(y) else rate)
    edges = np.array([np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(x.shape[1])])
    bins = numbered(x, edges)
    w = least(lambda w: pair_sums(bins[y == 1], bins[y == 0], w), BINS * x.shape[1], decay, rounds)
    raw = np.sort(w[bins].sum(1))
    k = int((y == 0).sum())
    return Ranking(edges, w.reshape(x.shape[1], BINS), float(raw[k - 1] + raw[k]) / 2, 1.0)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, x: the features of every row."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([[float(v) for v in features(t)] for t in s], index=s.index)

    return documents(docs).select("doc_id", F.pandas_udf(run, "array<double>")("text").alias("x"))


def groups(known: DataFrame, n: dict[int, int]) -> DataFrame:
    """known (doc_id, y, x) with the number of its group; rows of the rarer label stand in several where they are few."""
    rare = int(n[1] < n[0])
    many = -(-n[1 - rare] // GROUP)
    few = max(1, min(many, n[rare] // FEW))
    h = F.xxhash64("doc_id")
    frequent = known.where(F.col("y") != rare).withColumn("group", F.pmod(h, F.lit(many)))
    rarer = known.where(F.col("y") == rare).withColumn("group", F.explode(F.sequence(F.pmod(h, F.lit(few)), F.lit(many - 1).cast("long"), F.lit(few).cast("long"))))
    return frequent.unionByName(rarer)


def fit_features(every: DataFrame, labels: DataFrame) -> Ranking:
    """every: doc_id, x of all documents; only the training documents among them are used. One with several rows counts once."""
    y = label_table(labels, "quality").where(crc_fold("doc_id", 3) != 1)
    known = written(every.join(y, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")), "known")
    n = {0: 0, 1: 0} | {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n[0] or not n[1]:
        rate = y.agg(F.avg("y")).first()[0]
        return Ranking(np.zeros((0, 0)), np.zeros((0, 0)), 0.0, 1.0, 1.0 if n[1] else 0.0 if n[0] else 0.5 if rate is None else rate)
    size, places = BINS * len(NAMES), np.linspace(0, 1, BINS + 1)[1:-1].tolist()
    edges = np.array(known.agg(*[F.percentile_approx(F.col("x")[j], places, 100_000) for j in range(len(NAMES))]).first())
    bins = F.pandas_udf(lambda x: pd.Series(numbered(np.stack(x), edges).astype(np.int32).tolist()), "array<int>")
    dealt = written(groups(known, n).select("group", "y", bins("x").alias("bins")), "groups")

    def sums(w: np.ndarray) -> np.ndarray:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            b, y = np.stack(pdf["bins"]), pdf["y"].to_numpy()
            return pd.DataFrame({"sums": [pair_sums(b[y == 1], b[y == 0], w).tobytes()]})

        def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum(np.frombuffer(x) for pdf in frames for x in pdf["sums"])
            if not np.isscalar(total):
                yield pd.DataFrame({"id": np.arange(len(total)), "n": total})

        each = dealt.groupBy("group").applyInPandas(one, "sums binary").mapInPandas(added, "id long, n double")
        return each.groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")["n"].to_numpy()

    w = least(sums, size)
    raw = F.pandas_udf(lambda x: pd.Series(w[numbered(np.stack(x), edges)].sum(1)), "double")
    share = [(n[0] - 0.5) / (n[0] + n[1]), (n[0] + 0.5) / (n[0] + n[1])]
    threshold = float(np.mean(known.agg(F.percentile_approx(raw("x"), share, 100_000)).first()[0]))
    return Ranking(edges, w.reshape(len(NAMES), BINS), threshold, 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> Ranking:
    return fit_features(featured(docs.where(crc_fold("doc_id", 3) != 1)), labels)


def scored(model: Ranking):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            x = np.array([features(t or "") for t in s]).reshape(len(s), len(NAMES))
            yield pd.Series(model.score(x))

    return F.pandas_udf(run, "double")


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, score."""
    return documents(docs).select("doc_id", scored(model)("text").alias("score"))


def kept(docs: DataFrame, model: Ranking, least: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, whose text scores at least `least`."""
    return docs.where(scored(model)(F.coalesce(F.col("text"), F.lit(""))) >= least)


def op5_pairwise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = written(featured(table(spark, sf_dir, "documents")), "features", compression="zstd")
    model = fit_features(every, table(spark, sf_dir, "labels"))
    score = F.pandas_udf(lambda x: pd.Series(model.score(np.stack(x))), "double")
    out = every.select("doc_id", score("x").alias("score"))
    return out.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


__all__ = ["Ranking", "featured", "features", "fit", "fit_features", "kept", "op5_pairwise_ranking", "score", "train"]
