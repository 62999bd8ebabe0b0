"""Substring deduplication by content-defined chunking.

A gear rolling hash over the UTF-8 bytes (window 16) cuts each text wherever it is small, and in stretches without such a
place (periodic ones have none) at its local minima; so equal passages are cut alike wherever they stand, and an insertion
moves no cut further away than a window.  Chunks are told apart by 96 bits of their digest.  Runs of neighbouring chunks that
other documents hold too, of LEAST_WORDS words or more, are repeated passages where the passage can have more than LONGER
words: its ends lie in the chunks before and after the run, or, as cuts see WINDOW bytes back, a few words further, so it has
hardly more words than these three together and ENDS.  The document with the smallest doc_id that holds a chunk keeps it.

LEAST_WORDS stays below what is left of a passage of more than 50 words without its outer chunks, and above the set phrases
that unrelated documents share.

Defined results: null or empty text has no chunks; rows that repeat a doc_id are one document, whose chunks don't repeat by
that; chunks of rows without doc_id are compared with others but reported only beside a document with one; an empty table
gives an empty result; other columns are carried by `dedup` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_keys, rewrite, spread_join, staged, table

#: Cuts by size of the hash lie MEAN bytes apart on average; chunks have LEAST to MOST bytes (but for the last of a text).
MEAN, LEAST, MOST = 32, 8, 256
WINDOW = 16
#: Stretches of more than twice as many bytes without a cut are cut at minima over as many on either side.
REACH = 32
LEAST_WORDS, LONGER, ENDS = 12, 50, 5
#: One 16-bit number for each byte, by rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 2026) & 0xFFFF for b in range(256)], np.uint16)
_SMALL = np.uint16((1 << 16) // MEAN)
#: Bytes of text worked on at a time.
_BLOCK = 4 << 20
#: at: start, size and words of a chunk in one number, as shuffles carry it.
#: beside: words of the chunk before it and of the one after it, in a byte each.
SCHEMA = "row long, doc_id long, at long, beside int, d1 long, d2 int"
_SIZE_BITS, _WORD_BITS = 12, 12


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte, of the last 16 bytes: h = 2 h + gear[byte] modulo 2 ** 16, by doubling."""
    h = GEAR[data]
    for s in (1, 2, 4, 8):
        h[s:] += h[:-s] << np.uint16(s)
    return h


def minima(h: np.ndarray) -> np.ndarray:
    """Where h is least among REACH neighbours on either side."""
    width, low = 1, h
    while width < 2 * REACH + 1:  # low[i] = least of h[i : i + width]
        step = min(width, 2 * REACH + 1 - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    out = np.zeros(len(h), bool)
    out[REACH : REACH + len(low)] = h[REACH : REACH + len(low)] == low
    return out


def _apart(at: np.ndarray) -> np.ndarray:
    return at[np.concatenate(([True], np.diff(at) >= LEAST))] if len(at) else at


def bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chunk bounds of texts that lie one after the other; offsets (len(texts) + 1) are among them."""

    def inner(at: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Of cuts, those between characters and with so many bytes of their own text on either side."""
        at = at[at < len(data)]
        at = at[(data[at] & 0xC0) != 0x80]
        text = np.searchsorted(offsets, at, "right")
        return at[(at - offsets[text - 1] >= begin) & (offsets[text] - at >= end)]

    h = rolling(data)
    at = np.unique(np.concatenate([offsets, _apart(inner(np.flatnonzero(h < _SMALL) + 1, WINDOW, 0))]))
    gaps = np.diff(at)
    if len(h) > 2 * REACH and (gaps > 2 * REACH).any():
        wide = np.repeat(gaps > 2 * REACH, gaps)
        low = inner(np.flatnonzero(minima(h) & wide) + 1, WINDOW + REACH, REACH)
        place = np.searchsorted(at, low)
        low = _apart(low[(low - at[place - 1] >= LEAST) & (at[place] - low >= LEAST)])
        at = np.unique(np.concatenate([at, low]))
        gaps = np.diff(at)
    forced = [np.arange(a + MOST, a + g, MOST) for a, g in zip(at[:-1][gaps > MOST], gaps[gaps > MOST], strict=True)]
    if forced:
        f = np.concatenate(forced)
        for _ in range(3):
            f = np.where((data[np.minimum(f, len(data) - 1)] & 0xC0) == 0x80, f + 1, f)
        at = np.unique(np.concatenate([at, f]))
    return at


def _chunk(ids: pa.Array, texts: pa.Array, first_row: int) -> pa.RecordBatch:
    texts = texts.cast(pa.large_binary())
    texts = pa.concat_arrays([texts.fill_null(b"")])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return pa.RecordBatch.from_pylist([], schema=_ARROW)
    at = bounds(data, offsets)
    doc = np.searchsorted(offsets, at[:-1], "right") - 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = ~space
    starts[1:] &= space[:-1]
    words = np.concatenate([[0], np.cumsum(starts, dtype=np.int32)])
    view, digest, cut = memoryview(data), xxhash.xxh3_128_digest, at.tolist()
    d = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]), [("a", "<i8"), ("b", "<i4"), ("c", "<i4")])
    start, size, many = chars[at[:-1]] - chars[offsets[doc]], chars[at[1:]] - chars[at[:-1]], words[at[1:]] - words[at[:-1]]
    spot = (start.astype(np.int64) << (_SIZE_BITS + _WORD_BITS)) | (size << _WORD_BITS) | many
    before, after = np.zeros(len(many), np.int32), np.zeros(len(many), np.int32)
    same = doc[1:] == doc[:-1]
    before[1:][same], after[:-1][same] = many[:-1][same], many[1:][same]
    beside = (before << 8) | after  # a chunk of MOST bytes has at most half as many words
    cols = [pa.array(doc + first_row, pa.int64()), ids.take(pa.array(doc)), pa.array(spot), pa.array(beside, pa.int32()), pa.array(d["a"].copy()), pa.array(d["b"].copy())]
    return pa.RecordBatch.from_arrays(cols, schema=_ARROW)


_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("beside", pa.int32()), ("d1", pa.int64()), ("d2", pa.int32())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        size = np.frombuffer(b.column(1).cast(pa.large_binary()).buffers()[1], np.int64)[: b.num_rows + 1] if b.num_rows else np.zeros(1, np.int64)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, size[i] + _BLOCK, "right")) - 1)
            part = b.slice(i, min(j, b.num_rows) - i)
            yield _chunk(part.column(0), part.column(1), row + i)
            i += part.num_rows
        row += b.num_rows


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per chunk: its text's row, doc_id, its start, size (code points) and words that start in it, those beside it, and digest.

    They are cheaper to work out again than to keep.
    """
    return docs.select("doc_id", text).mapInArrow(_chunks, SCHEMA)


def repeats(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, longer: int = LONGER) -> DataFrame:
    """One row per repeated passage of a document: doc_id, start_at, end_at (code points), words, first_doc_id, holders, kept, cuts.

    holders: the documents that keep its chunks; kept: this document is the only one of them; cuts: the spans of chunks
    that another document keeps, as array<struct<s,e>>.
    """
    all_ = chunks(docs, text)
    shared = all_.groupBy("d1", "d2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = staged(shared.where("lo < hi").select("d1", "d2", "lo", "n"), "chunk-shared")
    # A chunk that very many texts hold is dealt over tasks.
    hits = spread_join(all_, shared.drop("n"), ["d1", "d2"], hot_keys(shared, ["d1", "d2"]), F.col("row"))
    hits = hits.select(
        "row", "doc_id", "lo", F.shiftright("at", _SIZE_BITS + _WORD_BITS).alias("start"),
        F.shiftright("at", _WORD_BITS).bitwiseAND((1 << _SIZE_BITS) - 1).alias("size"), F.col("at").bitwiseAND((1 << _WORD_BITS) - 1).alias("words"),
        F.shiftright("beside", 8).alias("before"), F.col("beside").bitwiseAND(255).alias("after"),
    )
    # A run starts where no shared chunk ends.
    order = Window.partitionBy("row").orderBy("start")
    hits = hits.withColumn("opens", F.coalesce(F.lag(F.col("start") + F.col("size")).over(order) != F.col("start"), F.lit(True)))
    hits = hits.withColumn("run", F.sum(F.col("opens").cast("int")).over(order))
    # A run is parted where chunks that this document keeps meet chunks that others keep.
    hits = hits.withColumn("own", F.coalesce(F.col("lo") == F.col("doc_id"), F.lit(False)))
    hits = hits.withColumn("part", F.sum((F.col("opens") | (F.lag("own", 1, False).over(order) != F.col("own"))).cast("int")).over(order))
    parts = hits.groupBy("row", "doc_id", "run", "part").agg(
        F.min("start").cast("int").alias("s"), F.max(F.col("start") + F.col("size")).cast("int").alias("e"), F.sum("words").alias("words"),
        F.min("lo").alias("lo"), F.collect_set("lo").alias("holders"), F.first("own").alias("own"),
        F.min_by("before", "start").alias("before"), F.max_by("after", "start").alias("after"),
    )
    runs = parts.groupBy("row", "doc_id", "run").agg(
        F.min("s").alias("start_at"), F.max("e").alias("end_at"), F.sum("words").alias("words"), F.min("lo").alias("first_doc_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("holders")))).alias("holders"), F.min("own").alias("kept"),
        F.array_sort(F.collect_list(F.when(~F.col("own"), F.struct("s", "e")))).alias("cuts"),
        (F.sum("words") + F.min_by("before", "s") + F.max_by("after", "s") + ENDS).alias("most"),
    )
    runs = runs.where((F.col("words") >= least_words) & (F.col("most") > longer))
    return runs.select("doc_id", "start_at", "end_at", "words", "first_doc_id", "holders", "kept", "cuts")


def dedup(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, longer: int = LONGER) -> DataFrame:
    """All documents with their columns; of each repeated chunk only the keeper's stays in its text."""
    cut = repeats(docs, text, least_words, longer).where("not kept and doc_id is not null").select("doc_id", F.explode("cuts").alias("cut"))
    spans = F.array_sort(F.collect_set(F.struct(F.col("cut.s").alias("s"), F.lit(0).alias("k"), F.col("cut.e").alias("e"), F.lit("").alias("m"))))
    spans = cut.groupBy("doc_id").agg(spans.alias("spans"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id").join(spans, "doc_id", "left")
    new = F.when(F.col("spans").isNull(), F.col(f"whole.`{text}`")).otherwise(rewrite(F.col(f"whole.`{text}`"), F.col("spans")))
    return whole.select(F.col("whole").withField(f"`{text}`", new).alias("whole")).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
