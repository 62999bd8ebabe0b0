"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir, staged

__all__ = ["WORD", "bind", "freed", "held_out", "hot_keys", "pieces", "rewrite", "running", "shared_dir", "small_batches", "spread_join", "staged", "table", "word_count"]

#: A word, wherever a contract speaks of words: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]++"
#: Code points of the blocks that spans are cut from, so that a cut far into a text doesn't walk the text.
_BLOCK = 1024
#: A key is hot if it has more than this many rows and more than a thousandth of all rows, so at most 1000 keys are hot.
HOT_ROWS, HOT_KEYS = 256, 1000
#: Bytes after which an Arrow batch ends (a longer text is a batch of its own): JVM and worker hold several of each task, off the heap.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end after BATCH_BYTES; a lower setting stays.

    Spark's own bound is 64 MB, so that batches of long texts are whole partitions.
    """
    now = spark.conf.get(_BATCH, None)
    if now is None or not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run; at its end what it held goes back to the system, as workers stay, while the JVM needs the memory in other stages.

    Caches that refer to their owner are cycles, which only a collection frees.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def held_out() -> Column:
    """True where crc32 of doc_id as text leaves remainder 0 modulo 5 (null doc_id: true, it is never a label)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative join, by doubling: n log n steps, no growing copies."""
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(steps, values, lambda a, step: F.transform(a, lambda x, i: F.when(i >= step, join(F.get(a, i - step), x)).otherwise(x)))


def pieces(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<s,e,m>>: code-point start, end (exclusive) and text.

    split() and regexp_extract_all() walk the same matches, so running lengths of gaps and matches give the positions.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    both = bind(found, lambda got: F.zip_with(got, F.slice(gaps, 1, F.size(got)), lambda m, g: F.struct(m.alias("m"), (F.length(g) + F.length(m)).alias("n"))))
    placed = lambda x, e: F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m"))
    return bind(both, lambda rows: F.zip_with(rows, bind(F.transform(rows, lambda x: x["n"]), lambda n: running(n, lambda a, b: a + b)), placed))


def rewrite(text: Column, found: Column, new: Callable[[Column, Column], Column] | None = None) -> Column:
    """text with each span of (start, end, replacement) replaced; where spans overlap, the earlier one goes first.

    new(span, begin) gives the replacement of what earlier spans left of a span, from begin on; by default the span's own,
    or none where an earlier span took its beginning.
    """
    new = new or (lambda x, begin: F.when(x["s"] == begin, x["m"]).otherwise(""))

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        i, j = (F.floor(x / _BLOCK).cast("int") for x in (a, b))
        at = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
        one = F.substring(at(i), a - i * _BLOCK + 1, b - a)
        more = F.concat(F.substring(at(i), a - i * _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(at(j), F.lit(1), b - j * _BLOCK))
        return F.when(i == j, one).otherwise(more)

    def whole(blocks: Column, rows: Column, reached: Column) -> Column:
        def part(x: Column, n: Column) -> Column:
            at = F.coalesce(F.get(reached, n - 1), F.lit(0))
            begin = F.greatest(at, x["s"])
            return F.when(x["e"] > at, F.concat(cut(blocks, at, begin), new(x, begin))).otherwise("")

        end = F.element_at(reached, -1)
        return F.concat(F.array_join(F.transform(rows, part), ""), cut(blocks, end, F.greatest(end, (F.size(blocks) * _BLOCK).cast("int"))))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    ends = lambda rows: bind(F.transform(rows, lambda x: x["e"]), lambda e: running(e, F.greatest))
    walk = bind(blocks, lambda b: bind(found, lambda rows: bind(ends(rows), lambda reached: whole(b, rows, reached))))
    return F.when(F.size(found) > 0, walk).otherwise(text)


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", rows: int = HOT_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """(keys, salts) of the keys with more than `rows` rows and their share of all: `most` of them, so they can be broadcast.

    counts has one row per key and its number of rows, n.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(rows, -(-total // most))
    return counts.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("salts"))


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """many join one (a row per key) on keys; rows of hot keys are dealt by the hash of `by` to as many copies of one's row."""
    small = F.broadcast(hot)
    left = many.join(small, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts").cast("long")).cast("int"), F.lit(0))).drop("salts")
    right = one.join(small, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
    return left.join(right, [*keys, "salt"], how).drop("salt")
