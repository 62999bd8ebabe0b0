"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: words, and one to three neighbouring word shapes (letters by case, digits, punctuation,
and whether a word repeats its predecessor).  Each is scaled by its class log-count ratio; a linear hinge-loss model over the
scaled indicators is fitted by dual coordinate descent, and its margin is mapped to a probability on the same sample.

Defined results: null and empty text gets the score of a text without features; every row gives one result; null doc_id is
carried and counts as held out; without labels of both classes every score is the share of label 1 (1 without labels); an
empty table gives an empty result; other columns are carried by `keep` and never read.
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

from .common import freed, held_out, table
from .training import Cache, sample, sigmoid

#: Bounds of the training sample: labelled rows, and features of all of them together.
ROWS, FEATURES = 8000, 24_000_000
BITS = 18
LEAST_DOCS = 8
THRESHOLD = 0.3
_RUNS = re.compile(r"([a-z])\1+|([A-Z])\2+|(0)\3+|([^aA0])\4{2,}")
_LETTERS = re.compile(r"[^\W\d_]")


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs of them as one; other characters as they are, three of a kind at most."""
    s = "".join("0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c for c in word)
    return _RUNS.sub(lambda m: m[0][:3] if m[4] else m[0][0], s)


def _ids(word: str) -> tuple[int, int]:
    return xxhash.xxh32_intdigest(shape(word).encode("utf-8", "replace")), xxhash.xxh32_intdigest(word.lower().encode("utf-8", "replace"), 1)


class Features:
    """text -> sorted distinct feature numbers below 2 ** BITS."""

    def __init__(self):
        self.cache = Cache(_ids)

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.empty(0, np.int64)
        got = np.array(list(map(self.cache.__getitem__, words)), np.uint64)
        s, w = got[:, 0], got[:, 1]
        s = s.copy()
        s[1:] += (w[1:] == w[:-1]).astype(np.uint64) * np.uint64(0x9E3779B1)
        mix = lambda x, salt: (x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(64 - BITS)
        two = s[:-1] * np.uint64(1000003) + s[1:]
        three = two[:-1] * np.uint64(1000003) + s[2:]
        return np.unique(np.concatenate([mix(w, 0), mix(s, 1 << 60), mix(two, 2 << 60), mix(three, 3 << 60)])).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """score = sigmoid(slope * (bias + sum of weights / sqrt(number of known features)) + shift)."""

    weights: np.ndarray
    known: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        n = int(np.count_nonzero(self.known[x]))
        return self.bias + float(self.weights[x].sum()) / max(1, n) ** 0.5

    def score(self, x: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(x) + self.shift))


def fit(rows: list[tuple[int, np.ndarray]], cost: float = 1.0, epochs: int = 12, seed: int = 1) -> Model:
    size = 1 << BITS
    y = np.array([1.0 if v else -1.0 for v, _ in rows])
    share = float((y > 0).mean()) if len(y) else 1.0
    if share in (0.0, 1.0):
        logit = 40.0 if share else -40.0
        return Model(np.zeros(size, np.float32), np.zeros(size, bool), 0.0, 0.0, logit)
    docs = [np.bincount(np.concatenate([x for v, x in rows if (v > 0) == c] or [np.empty(0, int)]), minlength=size) for c in (False, True)]
    known = docs[0] + docs[1] >= LEAST_DOCS
    p, q = docs[1] + 1.0, docs[0] + 1.0
    ratio = np.where(known, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)
    xs = [x[known[x]] for _, x in rows]
    xs = [(x, ratio[x] / max(1, len(x)) ** 0.5) for x in xs]
    # Dual coordinate descent for the hinge loss; the rarer class weighs as much as the other.
    most = np.where(y > 0, cost * 0.5 / share, cost * 0.5 / (1 - share))
    norm = np.array([float(v @ v) + 1.0 for _, v in xs])
    w, b, a = np.zeros(size), 0.0, np.zeros(len(xs))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(xs)):
            x, v = xs[i]
            g = y[i] * (float(w[x] @ v) + b) - 1.0
            new = min(max(a[i] - g / norm[i], 0.0), most[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[x] += step * v
                b += step
                a[i] = new
    m = np.array([float(w[x] @ v) + b for x, v in xs])
    slope, shift = _platt(m, y > 0)
    return Model((w * ratio).astype(np.float32), known, b, slope, shift)


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for p = sigmoid(slope * m + shift), with the usual smoothed targets."""
    n1, n0 = y.sum(), (~y).sum()
    t = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([m, np.ones_like(m)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(z @ theta)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - t))
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    return fit(sample(docs, labels, label, ROWS, FEATURES, Features()))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            got = [model.score(features(x.as_py() or "")) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(got, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    out = docs.select("text", "doc_id").mapInArrow(_scorer(model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            yield b.filter(pa.array([model.score(features(x.as_py() or "")) >= threshold for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(freed(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
