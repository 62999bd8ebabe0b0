"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in the words it holds and their beginnings; the
document's is their noisy-or, 1 - prod(1 - p).  Only document labels train it: proximal gradient steps on the document
likelihood with an L1 penalty on non-negative weights, so few terms keep one.  The same sentence scores then locate the offending sentences.

Sentences without a weighted term are no instances, so length alone never makes a document toxic.

Defined results: text without such a sentence, null and empty text included, has score 0; every row gives one result;
null doc_id is carried and counts as held out; without labels of both classes no term has a weight; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .training import Cache, sample

#: Bounds of the training sample: labelled rows, and sentence features of all of them together.
ROWS, FEATURES = 8000, 10_000_000
BITS = 20
#: Beginnings of words that are features of their own.
HEADS = (3, 4, 5)
LEAST_DOCS = 5
THRESHOLD = 0.5
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_END = -1


def _numbers(word: str) -> tuple[int, ...]:
    """Feature numbers of a lower-case word: itself and its beginnings."""
    names = [word, *(word[:n] + "~" for n in HEADS if len(word) >= n)]
    return tuple(xxhash.xxh32_intdigest(x.encode("utf-8", "replace")) >> (32 - BITS) for x in names)


class Bags:
    """text -> feature numbers, distinct in each sentence, each sentence closed by -1."""

    def __init__(self):
        self.cache = Cache(_numbers)

    def __call__(self, text: str) -> np.ndarray:
        out, cache = [], self.cache
        for s in _SENTENCE.findall(text.lower()):
            out.extend(set().union(*map(cache.__getitem__, set(_WORD.findall(s)))))
            out.append(_END)
        return np.array(out, np.int64)


@dataclass(frozen=True)
class Model:
    bias: float
    numbers: np.ndarray
    weights: np.ndarray

    def table(self) -> dict[int, float]:
        return dict(zip(self.numbers.tolist(), self.weights.tolist(), strict=True))


def fit(rows: list[tuple[int, np.ndarray]], steps: int = 250, rate: float = 0.25, shrink: float = 6e-3) -> Model:
    """Full-batch proximal Adam on the noisy-or likelihood; both classes weigh the same."""
    none = Model(-8.0, np.empty(0, np.int64), np.empty(0))
    y = np.array([float(v > 0) for v, _ in rows])
    if not 0 < y.sum() < len(y):
        return none
    size = 1 << BITS
    seen = np.zeros(size, np.int64)
    toxic = np.zeros(size, np.int64)
    for v, x in rows:
        u = np.unique(x[x >= 0])
        seen[u] += 1
        toxic[u] += v > 0
    used = np.flatnonzero((seen >= LEAST_DOCS) & (toxic > seen * y.mean()))
    place = np.full(size, -1, np.int64)
    place[used] = np.arange(len(used))
    if not len(used):
        return none
    sent, feat, doc, at = [], [], [], 0
    for d, (_, x) in enumerate(rows):
        s = np.cumsum(x < 0) + at  # a feature's sentence: the number of closed sentences before it
        n = int((x < 0).sum())
        f = x >= 0
        k = place[x[f]]
        sent.append(s[f][k >= 0].astype(np.int32))
        feat.append(k[k >= 0].astype(np.int32))
        doc.append(np.full(n, d, np.int32))
        at += n
    sent, feat, doc = map(np.concatenate, (sent, feat, doc))
    heard, sent = np.unique(sent, return_inverse=True)  # a sentence without terms is no instance
    doc, at = doc[heard], len(heard)
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, b = np.zeros(len(used)), -4.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        z = np.clip(b + np.bincount(sent, w[feat], at), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(doc, np.logaddexp(0, z), len(y))  # -log prod(1 - p)
        # d loss / d z of a sentence: p for clean documents, -p * q / (1 - q) for toxic ones, q = prod(1 - p).
        odds = 1 / np.expm1(np.clip(clean, 1e-9, 50))
        g = (share * np.where(y > 0, -odds, 1.0))[doc] * p
        grad = np.append(np.bincount(feat, g[sent], len(used)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        w = np.maximum(w - shrink, 0)  # terms can only accuse: many harmless words don't clear a sentence
        b = min(b, -4.0)
    on = np.flatnonzero(w)
    return Model(float(b), used[on], w[on])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    return fit(sample(docs, labels, label, ROWS, FEATURES, Bags()))


def sentence_scores(text: str, model: Model, cache: Cache) -> list[tuple[int, int, float]]:
    """(start, end, logit) of each sentence that holds a weighted term."""
    out, weights = [], cache.weights
    for s in _SENTENCE.finditer(text):
        got = [x for x in map(cache.__getitem__, set(_WORD.findall(s[0].lower()))) if x]
        if got:
            out.append((s.start(), s.end(), model.bias + sum(weights[k] for k in set().union(*got))))
    return out


def _cache(model: Model) -> Cache:
    weights = model.table()
    cache = Cache(lambda word: tuple(k for k in _numbers(word) if k in weights))
    cache.weights = weights
    return cache


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(model)
        for b in batches:
            scores, spots = [], []
            for x in b.column(0):
                rows = sentence_scores(x.as_py() or "", model, cache)
                scores.append(1.0 - float(np.exp(-sum(float(np.logaddexp(0, z)) for *_, z in rows))))
                spots.append(",".join(f"{s}:{e}" for s, e, z in rows if z >= 0))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(scores, pa.float64()), pa.array(spots, pa.string())], ["doc_id", "score", "sentences"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending sentences as start:end in code points, comma-joined."""
    out = docs.select("text", "doc_id").mapInArrow(_scorer(model), "doc_id long, score double, sentences string")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "sentences")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
