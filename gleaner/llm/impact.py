"""Exact top-k search over an impact-ordered index, score at a time, for batches of queries.

A component's floor(64 x) is its impact, a dimension is a term, and a posting segment holds the rows of a block with one
impact in one dimension.  Segments are processed by descending size of their impact, in levels: the segments of a level add
to the accumulators of a whole batch of queries at once, as a product of the queries' impacts with the level's postings laid
out by dimension.  Impacts have signs here, so what is left of a row's score after a level is at most the norm of its
postings below the level, times the query's norm.  A query's processing stops once this proves that few rows can belong to
the result; these possible members are rescored exactly.  A lower bound of the k-th score comes from exact scores of a bounded
sample and, where that leaves many rows, of the block's leaders.

Defined results: vectors that are null or not finite, or not of the usual length, take no part; a repeated vec_id stands for
the least of its vectors; ties go to the smaller vec_id; an empty table gives an empty result; other columns are not read.
Impacts beyond 2 ** 24 in size would leave the exact range of the accumulators and raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .vectors import blockwise, clean, matrix, result, sample

SCALE = 64
#: Shares of a block's postings (without zeros) processed up to each proof, at least; after the last one all scores are known.
LEVELS = (0.75, 0.9, 1.0)
#: A query's processing stops when at most this share of the block can still belong to its result.
FEW = 0.15
#: Queries whose accumulators are held at once.
BATCH = 128


class Index:
    """Postings of a block of rows, by descending impact: levels of whole segments, each laid out by dimension."""

    def __init__(self, z: np.ndarray):
        self.n = len(z)
        #: Impacts up to 2 ** 24 are whole in single precision, too.
        self.z = np.ascontiguousarray(z, np.float32)
        size = np.abs(z)
        met = size[size > 0]
        floors = np.unique(np.quantile(met, [1 - x for x in LEVELS], method="lower"))[::-1] if len(met) else [1.0]
        #: By level: dimensions with postings, these postings, and the norms of the rows' postings in later levels.
        self.levels, above = [], np.inf
        for floor in floors:
            part = np.where((size >= floor) & (size < above), z, 0)
            dims = np.flatnonzero(part.any(0))
            rest = np.linalg.norm(np.where(size < floor, z, 0), axis=1)
            self.levels.append((dims, part.T[dims].astype(np.float32), rest.astype(np.float32)))
            above = floor
        self.norm = np.linalg.norm(z, axis=1).max(initial=0)
        # Accumulators and bounds are single precision: their error, for a query of norm 1, is less than this.
        self.error = (z.shape[1] + 8) * 2.0**-22 * self.norm

    def search(self, q: np.ndarray, k: int, bound: float, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the best k - all that score `bound` or the block's k-th score, at least - and their scores."""
        return self.batch(q[None], k, np.array([bound]), np.array([own]))[0]

    def batch(self, q: np.ndarray, k: int, bound: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """search() of every query; own is a query's row, or -1."""
        norm, weight, low = np.linalg.norm(q, axis=1), q.astype(np.float32), bound.astype(np.float64)
        # Sums of integers below 2 ** 24 are exact in single precision.
        exact = [w if small else x for w, x, small in zip(weight, q, norm * self.norm < 1 << 24, strict=True)]
        least = lambda at: np.maximum(low[at] - norm[at] * self.error, np.finfo(np.float32).min).astype(np.float32)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(q)
        left, score = np.arange(len(q)), 0
        for level, (dims, part, rest) in enumerate(self.levels, 1):
            score += weight[np.ix_(left, dims)] @ part
            most = norm[left, None].astype(np.float32) * rest
            most += score
            inside = np.flatnonzero(own[left] >= 0)
            most[inside, own[left[inside]]] = -np.inf
            possible = most >= least(left)[:, None]
            count = np.count_nonzero(possible, axis=1)
            stays = np.zeros(len(left), bool)
            for i, at in enumerate(left.tolist()):
                if count[i] > FEW * self.n and self.n - (own[at] >= 0) >= k:
                    lead = np.argpartition(-most[i], k - 1)[:k]
                    low[at] = max(low[at], float((self.z[lead] @ exact[at]).min()))
                    possible[i] = most[i] >= least(at)
                    count[i] = np.count_nonzero(possible[i])
                if level < len(self.levels) and count[i] > FEW * self.n:
                    stays[i] = True
                    continue
                rows = np.flatnonzero(possible[i])
                s = (self.z[rows] @ exact[at]).astype(np.float64)
                best = s >= low[at]
                found[at] = rows[best], s[best]
            if not stays.any():
                break
            left, score = left[stays], score[stays]
        return found


def _impacts(x: np.ndarray) -> np.ndarray:
    z = np.floor(SCALE * x)
    if z.size and np.abs(z).max() > 1 << 24:
        raise ValueError("impacts beyond 2 ** 24")
    return z


def _bounds(ids: np.ndarray, seen: np.ndarray, k: int):
    """Adds to each query the k-th score of a bounded sample, a lower bound of the k-th score over all rows."""
    z = _impacts(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column(1))
            if not len(q):
                continue
            s = _impacts(q) @ z.T
            s[b.column(0).to_numpy()[:, None] == ids[None, :]] = -np.inf
            low = np.partition(s, -k, 1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(low, pa.float64())], ["id", "x", "low"])

    return run


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qids = left["id"].to_numpy(), right["id"].to_numpy()
        if not len(ids) or not len(qids):
            return result([], pa.int64())
        order = np.argsort(ids)
        ids = ids[order]
        index = Index(_impacts(matrix(left["x"])[order]))
        q, low = _impacts(matrix(right["x"])), right["low"].to_numpy()
        at = np.searchsorted(ids, qids).clip(max=len(ids) - 1)
        own = np.where(ids[at] == qids, at, -1)
        out = []
        for i in range(0, len(q), BATCH):
            some = slice(i, i + BATCH)
            for query_id, (rows, s) in zip(qids[some], index.batch(q[some], k, low[some], own[some]), strict=True):
                top = np.lexsort((ids[rows], -s))[:k]
                out.append((query_id, ids[rows][top], s[top].astype(np.int64)))
        return result(out, pa.int64())

    return run


def top(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row whose id is divisible by `every`."""
    rows = staged(clean(vectors, True, id_col, vec_col), "impact-vectors")
    n = rows.count()
    ids, seen = sample(rows)
    queries = rows.where(F.col("id") % every == 0)
    if n:
        queries = staged(queries.mapInArrow(_bounds(ids, seen, k), "id long, x array<double>, low double"), "impact-queries")
    else:
        queries = queries.withColumn("low", F.lit(0.0))
    return blockwise(rows, queries, n, _search(k), "long", k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(table(spark, sf_dir, "embeddings"))
