"""Bounded training samples and word caches shared by the two classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Entries a worker's word cache may hold before it starts anew (about 150 bytes each).
CACHE = 400_000


class Cache(dict):
    """word -> make(word), emptied when full."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = self.make(word)
        return got


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, y, at): at most `rows` labels of documents outside the held-out fold, in an order fixed by the hash of doc_id.

    A doc_id that is labelled more than once counts once, with its largest label; null labels and ids don't count.
    """
    labels = labels.join(docs.select("doc_id").where(~held_out()), "doc_id", "left_semi")
    use = labels.where(~held_out() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return use.withColumn("at", F.xxhash64(F.lit(7), "doc_id")).orderBy("at", "doc_id").limit(rows)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most: int, features: Callable[[str], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(label, features) of at most `rows` labelled documents with at most `most` features together, on the driver.

    The labels that are broadcast are at most `rows` rows of three numbers; each text is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(x or "") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype(np.int32).tobytes() for x in got], pa.binary())], ["at", "y", "x"])

    chosen = labelled(docs, labels, label, rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("at", "y", "text")
    out, total = [], 0
    # Ordered by hashes: range bounds are sampled to the driver, and features are long.
    found = texts.mapInArrow(run, "at long, y int, x binary").orderBy("at", F.xxhash64("x"))
    for r in found.toLocalIterator(prefetchPartitions=False):
        x = np.frombuffer(bytes(r["x"]), np.int32)
        if total + len(x) > most:  # shorter ones behind it may still fit
            continue
        total += len(x)
        out.append((r["y"], x))
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
