"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner products become least distances by one more coordinate: x -> (x / M, sqrt(1 - |x|^2 / M^2)) with the largest
norm M, q -> (q / |q|, 0).  Each of TABLES tables hashes a vector to numbers floor((a . x + b) / WIDTH) with Gaussian a; their
count grows with the logarithm of the table, so that buckets stay small.  The difference of two projections at distance d is
normal with deviation d, which gives the probability that a neighbour at that distance lies in a bucket a given perturbation
away from the query's.  Buckets are visited in the order of that estimate until they hold the neighbour with probability
1 - MISS over all tables; d is the distance of the query's k-th neighbour as a bounded sample shows it: that of the sample's
neighbour of the rank that k of all rows have there.

Index rows and probes meet by bucket: buckets are dealt into parts, large ones in slices, and a part's queries in blocks, so
a task holds a bounded number of both.  The tables' candidates are merged and reranked by exact inner products; those beneath
what the sample shows to be out of reach go at once.  Queries with fewer than k candidates probe on through all buckets.

Defined results: vectors that are null, zero or not finite, or not of the usual length, take no part; a repeated vec_id
stands for the least of its vectors; equal scores go to the smaller vec_id; with k other rows or fewer a query gets them
all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_keys, staged, table
from .vectors import blockwise, clean, matrix, result, sample

TABLES, WIDTH = 6, 2.0
#: Largest perturbation of a hash number; likelihood below which a bucket isn't listed.
REACH, LEAST = 2, 1e-6
#: Estimated share of a query's k-th neighbours that may be missed, over all tables.
MISS = 0.08
#: Index rows of a part, queries of a block, and how many slices at most need be known everywhere.
PART, QUERIES, SLICES = 4096, 4096, 100_000
#: Candidates count down to the score that about so many times k of all rows reach, as the sample shows it.
DEEP = 3


def _phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    e = 1 - t * np.exp(-z * z) * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * (1 + np.sign(x) * e)


class Hashes:
    def __init__(self, dim: int, n: int, largest: float, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.count = min(16, round(0.5 * log2(n) + 1.5))
        self.a = rng.standard_normal((TABLES, self.count, dim + 1))
        self.b = rng.uniform(0, WIDTH, (TABLES, self.count))
        #: A bucket's number is the sum of its hash numbers times these, and of its table's.
        self.factor = rng.integers(1, 2**63, (TABLES, self.count), np.uint64) | np.uint64(1)
        self.table = rng.integers(1, 2**63, TABLES, np.uint64)
        self.largest = largest

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm2 = (x * x).sum(1)
        if query:
            return np.concatenate([x / np.sqrt(norm2)[:, None], np.zeros((len(x), 1))], 1)
        return np.concatenate([x / self.largest, np.sqrt(np.maximum(0, 1 - norm2 / self.largest**2))[:, None]], 1)

    def place(self, lifted: np.ndarray) -> np.ndarray:
        """(rows, tables, hashes): projections in widths."""
        return (np.einsum("nd,tkd->ntk", lifted, self.a, optimize=True) + self.b) / WIDTH

    def buckets(self, place: np.ndarray) -> np.ndarray:
        """(rows, tables): bucket numbers."""
        return (np.floor(place).astype(np.int64).view(np.uint64) * self.factor).sum(2, dtype=np.uint64) + self.table

    def probes(self, place: np.ndarray, dist: float) -> np.ndarray:
        """Buckets to visit for one query, table by table in the order of their estimated success."""
        steps = np.arange(-REACH, REACH + 1)
        low = (np.floor(place)[..., None] + steps - place[..., None]) * WIDTH / dist
        chance = np.maximum(_phi(low + WIDTH / dist) - _phi(low), 0.0)
        own, out = self.buckets(place[None])[0], []
        for t in range(TABLES):
            p, key = np.ones(1), own[t : t + 1]
            for h in range(self.count):
                step = steps.astype(np.int64).view(np.uint64) * self.factor[t, h]
                p, key = (p[:, None] * chance[t, h]).ravel(), (key[:, None] + step).ravel()
                on = p >= LEAST
                p, key = p[on], key[on]
            order = np.argsort(-p, kind="stable")
            many = np.searchsorted(np.cumsum(p[order]), 1 - MISS ** (1 / TABLES)) + 1
            out.append(key[order[:many]])
        return np.concatenate(out)


def _index(hashes: Hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            if len(x):
                keys = hashes.buckets(hashes.place(hashes.lift(x, False)))
                at = pa.array(np.repeat(np.arange(len(x)), TABLES))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), b.column(0).take(at), b.column(1).take(at)], ["bucket", "id", "x"])

    return run


def _plan(hashes: Hashes, ids: np.ndarray, seen: np.ndarray, n: int, k: int):
    """Adds to each query the buckets to visit and a score that its k best candidates should reach."""
    lifted = hashes.lift(seen, False)
    rank, deep = (min(len(ids), max(1, round(k * many * len(ids) / n))) for many in (1, DEEP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column(1))
            if not len(q):
                continue
            up = hashes.lift(q, True)
            near = up @ lifted.T
            near[b.column(0).to_numpy()[:, None] == ids[None, :]] = -np.inf
            near.sort(1)
            kth = near[:, -rank]
            dist = np.sqrt(np.maximum(2 - 2 * np.where(np.isfinite(kth), kth, -1.0), 1e-6))
            low = near[:, -deep] * hashes.largest * np.sqrt((q * q).sum(1)) if n > DEEP * k else np.full(len(q), -np.inf)
            keys = [hashes.probes(p, d).view(np.int64) for p, d in zip(hashes.place(up), dist, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(low)], ["id", "x", "buckets", "low"])

    return run


def _best(ids: np.ndarray, x: np.ndarray, q: np.ndarray, rows: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best of some rows; s holds their scores up to rounding."""
    if len(rows) > k:
        kth = np.partition(s, len(s) - k)[len(s) - k]
        rows = rows[s >= kth - 1e-9 * max(1.0, abs(kth))]
    exact = np.array([fsum(p) for p in (x[rows] * q).tolist()])
    top = np.lexsort((ids[rows], -exact))[:k]
    return ids[rows][top], exact[top]


def _search(k: int):
    """Index rows by bucket, and queries with the buckets they visit -> each query's k best among them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return result([], pa.float64())
        order = np.argsort(left["bucket"].to_numpy(), kind="stable")
        bucket, ids, x = left["bucket"].to_numpy()[order], left["id"].to_numpy()[order], matrix(left["x"])[order]
        qids, q, low = right["id"].to_numpy(), matrix(right["x"]), right["low"].to_numpy()
        low = low - 1e-9 * np.maximum(1.0, np.abs(low))
        visits = right["buckets"].combine_chunks()
        who, key = np.repeat(np.arange(len(qids)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()
        who, key = who[np.argsort(key, kind="stable")], np.sort(key)
        a, first = np.unique(bucket, return_index=True)
        begin, end = np.searchsorted(key, a, "left"), np.searchsorted(key, a, "right")
        hits = []
        for f, n, i, j in zip(first, np.diff(np.append(first, len(bucket))), begin, end, strict=True):
            s = x[f : f + n] @ q[who[i:j]].T
            row, col = np.nonzero(s >= low[who[i:j]])
            hits.append((who[i:j][col], f + row, s[row, col]))
        w, row, s = (np.concatenate(c) for c in zip(*hits, strict=True))
        on = ids[row] != qids[w]
        w, row, s = w[on], row[on], s[on]
        if not len(w):
            return result([], pa.float64())
        order = np.argsort(w, kind="stable")
        w, row, s = w[order], row[order], s[order]
        at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        out = []
        for i, j in zip(at, np.append(at[1:], len(w)), strict=True):
            rows, place = np.unique(row[i:j], return_index=True)  # a slice may lie in the part of another table's bucket
            own = w[i]
            same, first = np.unique(ids[rows], return_index=True)
            out.append((qids[own], *_best(ids, x, q[own], rows[first], s[i:j][place][first], k)))
        return result(out, pa.float64())

    return run


def _through(k: int):
    """All rows of a block for each query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x, qids, q = left["id"].to_numpy(), matrix(left["x"]), right["id"].to_numpy(), matrix(right["x"])
        out = []
        for i in range(len(qids) if len(ids) else 0):
            rows = np.flatnonzero(ids != qids[i])
            if len(rows):
                out.append((qids[i], *_best(ids, x, q[i], rows, x[rows] @ q[i], k)))
        return result(out, pa.float64())

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`."""
    rows = staged(clean(vectors, False, id_col, vec_col), "ann-vectors")
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    n, largest = rows.agg(F.count(F.lit(1)), F.max(norm2)).first()
    queries = rows.where(F.col("id") % every == 0)
    if not n:
        return queries.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    ids, seen = sample(rows)
    hashes = Hashes(seen.shape[1], n, float(largest) ** 0.5)
    plan = staged(queries.mapInArrow(_plan(hashes, ids, seen, n, k), "id long, x array<double>, buckets array<long>, low double"), "ann-queries")
    entries = rows.mapInArrow(_index(hashes), "bucket long, id long, x array<double>")
    counts = staged(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "ann-buckets")
    # Large buckets are dealt in slices, which their visitors visit one and all.
    large = F.broadcast(hot_keys(counts, ["bucket"], "n", PART, SLICES))
    slices, parts = F.coalesce("salts", F.lit(1)), -(-n * TABLES // PART)
    part = F.pmod(F.xxhash64("bucket", "slice"), F.lit(parts)).alias("part")
    entries = entries.join(large, "bucket", "left").withColumn("slice", F.pmod(F.xxhash64(F.lit(3), "id"), slices).cast("int"))
    visits = plan.select("id", F.explode("buckets").alias("bucket")).join(counts.select("bucket"), "bucket", "left_semi")
    visits = visits.join(large, "bucket", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    visits = visits.select("id", "bucket", part).groupBy("part", "id").agg(F.collect_set("bucket").alias("buckets"))
    visits = staged(visits.join(plan.select("id", "x", "low"), "id"), "ann-visits")
    blocks = visits.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    right = visits.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")).cast("int"))
    left = entries.select("bucket", "id", "x", part).join(blocks, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left, right = left.select("part", "block", "bucket", "id", "x"), right.select("part", "block", "id", "x", "buckets", "low")
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.distinct().withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    found = staged(found.select("query_id", "rank", "vec_id", "score"), "ann-found")
    enough = found.where(F.col("rank") == min(k, n - 1)).select(F.col("query_id").alias("id"))
    short = staged(plan.select("id", "x").join(enough, "id", "left_anti"), "ann-short")
    if short.isEmpty():
        return found
    more = blockwise(rows, short, n, _through(k), "double", k)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
