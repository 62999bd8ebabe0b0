"""Vectors, query blocks and merged top lists shared by the two searches.

The queries are a stated share of all rows and meet every row, in blocks: both sides are dealt into groups of bounded size,
each index block is searched through its own index by each query block, and the blocks' best are merged per query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an index block, and queries of a query block.
BLOCK, QUERIES = 8192, 2048
#: Rows of the sample that bounds are taken from; fixed by the hash of their ids.
SAMPLE = 4096


def clean(vectors: DataFrame, zero: bool, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x): finite vectors of the most frequent length; a repeated id stands for the least of its vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.where("id is not null and size(x) > 0").where(~F.exists("x", bad))
    if not zero:
        rows = rows.where(F.exists("x", lambda v: v != 0))
    usual = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("x") == (usual[0]["n"] if usual else 0)).groupBy("id").agg(F.min("x").alias("x"))


def sample(rows: DataFrame, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most SAMPLE rows."""
    got = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).toArrow()
    return got["id"].to_numpy(), matrix(got["x"])


def matrix(x: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.empty((0, 0))


def blockwise(index: DataFrame, queries: DataFrame, n_index: int, search: Callable[[pa.Table, pa.Table], pa.Table], score_type: str, k: int) -> DataFrame:
    """Every query block against every index block; then the k best of each query, ties to the smaller id."""
    blocks = max(1, -(-n_index // BLOCK))
    parts = max(1, -(-queries.count() // QUERIES))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("block", deal(blocks, 3)).withColumn("part", every(parts))
    right = queries.withColumn("part", deal(parts, 5)).withColumn("block", every(blocks))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(search, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def result(found: list[tuple[int, np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Table:
    q = np.concatenate([np.full(len(v), i, np.int64) for i, v, _ in found]) if found else np.empty(0, np.int64)
    v = np.concatenate([v for _, v, _ in found]) if found else np.empty(0, np.int64)
    s = np.concatenate([s for *_, s in found]) if found else np.empty(0)
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, kind)})
