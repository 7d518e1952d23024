"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of the words in it and of their first PREFIX
characters; the document's is the noisy-or of its sentences', and only documents have labels. A sentence's prior odds fall with the number of
the document's sentences, so that words that say nothing give a document of any length the same small probability. The weights are fitted to the labels of at most `per_class`
training documents of each class, chosen by a hash of their id; the share of toxic documents among all training labels sets
the weight of either class. Every word of `MIN_SENTENCES` distinct sentences is a feature, whatever the size of the sample; the fit's
penalty on a weight falls with the evidence for the word, and words that it leaves at 0 are not kept; its size was chosen by cross-validation over
folds 1 to 4, without the held-out fold 0. Sentences above one half are the offending ones.

Null or empty text: no sentence, score 0. Labels that are null or disagree: see base.label_table. No labels of either class: every score is
the share of label 1. Repeated rows: one row out for each. Other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.base import crc_fold, documents, labelled_sample, table

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
PER_CLASS = 2500
MIN_SENTENCES = 4
#: The penalty on the weight of a word whose class difference is 5 standard errors; it goes with the fourth power of 5 / difference.
PENALTY = 1e-4
#: A longer word counts as its beginning too, so that forms of one stem share their evidence.
PREFIX = 5


def features_of(word: str) -> tuple[str, ...]:
    return (word, f"{word[:PREFIX]}*") if len(word) > PREFIX else (word,)


def bag(sentence: str) -> set[str]:
    """The features of a sentence."""
    return {f for w in set(WORD.findall(sentence.lower())) for f in features_of(w)}


class Bags:
    """bias and weights of words and prefixes; the base rate where nothing could be learned."""

    def __init__(self, bias: float, weights: dict[str, float], constant: float | None = None):
        self.bias, self.weights, self.constant = bias, weights, constant

    def known(self, text: str) -> dict[str, tuple[str, ...]]:
        """The words of a text that have a weight, or whose beginning has, with what has."""
        out = {}
        for w in set(WORD.findall(text.lower())):
            if found := tuple(f for f in features_of(w) if f in self.weights):
                out[w] = found
        return out

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, logit) of each sentence."""
        known, weights = self.known(text), self.weights
        spans = [m for m in SENTENCE.finditer(text) if not m[0].isspace()]
        prior = self.bias - math.log(max(1, len(spans)))
        out = []
        for m in spans:
            hits = known.keys() & WORD.findall(m[0].lower())
            out.append((m.start(), m.end(), prior + sum(weights[f] for f in {f for w in hits for f in known[w]})))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of all sentences, and the offending ones."""
        if self.constant is not None:
            return self.constant, []
        got = self.sentences(text)
        return -math.expm1(-sum(np.logaddexp(0, [z for *_, z in got]).tolist())), [(s, e, 1 / (1 + math.exp(-min(z, 500)))) for s, e, z in got if z > 0]


def train(texts: list[str], y: list[int], rate: float, rounds: int = 400, penalty: float = PENALTY) -> Bags:
    y = np.asarray(y, dtype=float)
    if not len(y) or y.min() == y.max():
        return Bags(0.0, {}, float(y.mean()) if len(y) else rate)
    # Words are counted in distinct sentences, so those of copied documents count once.
    counts, n, seen = (Counter(), Counter()), [0, 0], (set(), set())
    for text, label in zip(texts, y.astype(int), strict=True):
        for m in SENTENCE.finditer(text):
            found = bag(m[0])
            if found and (key := hash(frozenset(found))) not in seen[label]:
                seen[label].add(key)
                counts[label].update(found)
                n[label] += 1
    c0, c1 = counts
    n0, n1 = (max(1, x) for x in n)
    total = n0 + n1
    # The difference of a word's shares of sentences between the classes, in units of its standard error.
    strength = {w: abs(c1[w] / n1 - c0[w] / n0) / math.sqrt((p := k / total) * (1 - p + 1e-9) * (1 / n1 + 1 / n0)) for w in c1.keys() | c0.keys() if (k := c1[w] + c0[w]) >= MIN_SENTENCES}
    del seen, counts, c0, c1
    words = sorted(strength)
    cost = penalty * (5 / np.maximum([strength[w] for w in words], 0.5)) ** 4
    index = {w: k for k, w in enumerate(words)}
    of_doc, of_sentence, of_word = [], [], []
    for d, text in enumerate(texts):
        for m in SENTENCE.finditer(text):
            if m[0].isspace():
                continue
            k = len(of_doc)
            of_doc.append(d)
            got = [index[w] for w in bag(m[0]) if w in index]
            of_word += got
            of_sentence += [k] * len(got)
    of_doc, of_sentence, of_word = (np.asarray(x, dtype=np.int64) for x in (of_doc, of_sentence, of_word))
    lengths = np.bincount(of_doc, minlength=len(y))
    prior = -np.log(np.maximum(lengths, 1))[of_doc]
    weight = np.where(y == 1, rate / y.sum(), (1 - rate) / (1 - y).sum())
    w, b = np.zeros(len(words)), -4.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for t in range(1, rounds + 1):
        z = b + prior + np.bincount(of_sentence, weights=w[of_word], minlength=len(of_doc))
        loss = np.bincount(of_doc, weights=np.logaddexp(0, z), minlength=len(y))  # minus the log of P(no sentence is toxic)
        p = -np.expm1(-loss)
        gain = np.where(y == 1, np.exp(-loss) / np.maximum(p, 1e-9), -1.0) * weight
        gz = gain[of_doc] / (1 + np.exp(-z))
        gw = np.bincount(of_word, weights=gz[of_sentence], minlength=len(words))
        gw = np.where(w != 0, gw - cost * np.sign(w), np.sign(gw) * np.maximum(np.abs(gw) - cost, 0))
        g = np.append(gw, gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = np.where(w * (w + step[:-1]) < 0, 0, w + step[:-1])  # a weight that would change its sign stops at 0
        b += step[-1]
    return Bags(float(b), {x: k for x, k in zip(words, w.tolist(), strict=True) if k})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Bags:
    rows, rate = labelled_sample(docs, labels, "toxic", 5, 0, per_class)
    return train(rows["text"].tolist(), rows["y"].tolist(), rate)


def score(docs: DataFrame, model: Bags) -> DataFrame:
    """doc_id, score, and the offending sentences: start and end in code points, and the sentence's own score."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [model.score(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [min(1.0, max(0.0, p)) for p, _ in got], "sentences": [[{"start": s, "end": e, "score": x} for s, e, x in bad] for _, bad in got]})

    return documents(docs).mapInPandas(run, "doc_id long, score double, sentences array<struct<start:long,end:long,score:double>>")


def op10_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"))
