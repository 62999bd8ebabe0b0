"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments; the Manhattan distance of two embeddings is a lower
bound of their Hamming distance.  Distance 4 over both halves means at most 2 in one of them, so each half is a grid whose
cells are its 16 counts, and two fingerprints within 2 there meet in a cell one step from both: every fingerprint visits its
own cell and those one step away (a range join).  In a cell, the full embeddings bound once more and the bits verify.

Equal fingerprints are one class before that, so exact copies cost nothing.  Cells emit the edges of a spanning forest of
their links, not the links, so a group of near copies stays linear; the components of these edges are those of all links.

`representatives` keeps one document of each group whose five-word shingles are alike by 0.8 (Jaccard).  It looks for
candidates by fingerprints of two-word shingles, which an edit changes less, in a grid of three thirds (so all pairs within 8
bits meet, and most within 12), and verifies them exactly on the five-word shingles.  Where a row of a cell has more than a
few, what hangs together is a crowd, dealt into blocks that meet in pairs, each in a task of its own.

Defined results: null and empty text, or text without words, has fingerprint zero and is linked like any other; every row
gives a result, repeated ones too; null doc_id is carried, and is a component_id only where no document has an id; an empty
table gives an empty result; other columns are not read.  `representatives` treats rows, not doc_ids: rows that share a
doc_id and no text are documents of their own; rows without a doc_id all stay; texts are told apart by 64 bits of their
digest; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, hot_keys, spread_join, staged, table
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: The grid of `links`: halves, as segments from and to.
HALVES = ((0, 16), (16, 32))
#: What `representatives` calls alike: Jaccard similarity of the sets of so many words.
ALIKE, ALIKE_SHINGLE = 0.8, 5
#: Its candidates: words of a fingerprint's shingles, grid, most bits, and the most a row of no crowd has in a cell.
NEAR_SHINGLE, THIRDS, NEAR_BITS, FEW = 2, ((0, 11), (11, 22), (22, 32)), 12, 4
#: Most bits between fingerprints of the five-word shingles; 0.8 means 10 bits of 64 there, with a deviation of 3.
CHECK_BITS = 18
#: Shingles of a block of a crowd; a task holds two.
TILE = 1 << 18
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are summed at a time (64 bytes each).
_BLOCK = 1 << 16
#: Rows of a cell beyond which it is dealt into pairs of blocks.
CROWD = 1 << 15
_PAIR = np.uint64(0x5555555555555555)


def _words(text: str | bytes | None) -> list[bytes]:
    return _WORDS.findall((text.encode() if isinstance(text, str) else text or b"").translate(_LOWER))


def _hashes(words: list[bytes], shingle: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of all shingles in order, a block at a time; of fewer words, of the whole sequence; of none, nothing."""
    if not words:
        return
    line = memoryview(b" ".join(words))
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    for i in range(0, n, _BLOCK):
        yield np.fromiter([hashed(line[a:b], seed) for a, b in zip(starts[i : i + _BLOCK], ends[i : i + _BLOCK], strict=True)], np.uint64)


def _simhash(hashes: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash over all shingles, repeats included."""
    return _simhash(_hashes(_words(text), shingle))


def _signed(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), _signed(got)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _counts(x: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, in place: 0, 1 or 2 in each pair of bits."""
    return x - ((x >> np.uint64(1)) & _PAIR)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed counts: 1 costs bit differences 1, 2 only between counts 0 and 2."""
    d = a ^ b  # 00-01: 01, 01-10: 11, 00-10: 10
    high, low = (d >> np.uint64(1)) & _PAIR, d & _PAIR
    return np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)


def _cells(parts: tuple[tuple[int, int], ...]):
    """Each row at its fingerprint's own cell and at those one step away, in all parts; the other columns go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            c, row = _counts(fp), np.arange(len(fp), dtype=np.int32)
            for part, (first, last) in enumerate(parts):
                own = (c >> np.uint64(2 * first)) & np.uint64((1 << 2 * (last - first)) - 1)
                keys, who = [own], [row]
                for seg in range(last - first):
                    one = np.uint64(1 << (2 * seg))
                    v = (own >> np.uint64(2 * seg)) & np.uint64(3)
                    keys += [own[v < 2] + one, own[v > 0] - one]
                    who += [row[v < 2], row[v > 0]]
                key, at = np.concatenate(keys).astype(np.int64) * len(parts) + part, pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays([pa.array(key), *[x.take(at) for x in b.columns]], ["cell", *b.schema.names])

    return run


def _whole_cells(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Batches sorted by cell, as columns of whole cells: the last cell of a batch waits for the next one.

    A cell with more than `most` rows comes in parts, marked false.
    """
    whole = lambda parts: [np.concatenate(x) for x in zip(*parts, strict=True)]
    held, rows, large, current = [], 0, False, None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [x.to_numpy() for x in b.columns]
        cell = cols[0]
        begin = 0 if current is None else int(np.searchsorted(cell, current, "right"))  # so far the waiting cell goes on
        held, rows = [*held, [x[:begin] for x in cols]], rows + begin
        if most is not None and rows and (large or rows > most):
            yield False, whole(held)
            held, rows, large = [], 0, True
        if begin == len(cell):
            continue
        cut = int(np.searchsorted(cell, cell[-1]))
        if rows + cut - begin:
            yield True, whole([*held, [x[begin:cut] for x in cols]])
        held, rows, large, current = [[x[cut:] for x in cols]], len(cell) - cut, False, cell[-1]
    if rows:
        yield most is None or not (large or rows > most), whole(held)


def _by_cell(cells: DataFrame, work, schema: str, crowd: int | None = None) -> DataFrame:
    """work(columns of whole cells, sorted by cell and size) of all cells; those of more than `crowd` rows in pairs of blocks.

    A block has about half as many rows, and each pair of blocks is a cell of its own, so no task holds a large cell.
    """
    crowd = crowd or CROWD
    names, order = cells.columns, [c for c in ("cell", "size") if c in cells.columns]
    out = pa.schema([(f.split()[0], {"long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]]) for f in schema.split(", ")])

    def once(most: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            for whole, cols in _whole_cells(chain([first], batches) if first else (), most):
                if whole:
                    got = work(cols)
                    yield pa.RecordBatch.from_arrays([*got.columns, *[pa.nulls(got.num_rows, f.type) for f in first.schema]], [*out.names, *names])
                else:
                    rest = [pa.array(x, f.type) for x, f in zip(cols, first.schema, strict=True)]
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(cols[0]), f.type) for f in out], *rest], [*out.names, *names])

        kept = ", ".join([schema, *[f"{f.name} {f.dataType.simpleString()}" for f in cells.schema]])
        return lambda rows: rows.repartition("cell").sortWithinPartitions(*order).mapInArrow(run, kept)

    found = staged(once(crowd)(cells), "simhash-cells")
    done, rest = found.where("cell is null").select(*out.names), found.where("cell is not null").select(*names)
    if rest.isEmpty():
        return done
    blocks = rest.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) * 2 / crowd).cast("int").alias("blocks"))
    rest = spread_join(rest, blocks.drop("n"), ["cell"], hot_keys(blocks, ["cell"]), F.col("fp"))
    rest = rest.withColumn("x", F.pmod(F.xxhash64(F.lit(9), "fp"), F.col("blocks")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("cell", F.least("x", "y"), F.greatest("x", "y"))
    return done.unionByName(once(None)(rest.withColumn("cell", pair).select(*names)).select(*out.names))


def _meetings(cell: np.ndarray, size: np.ndarray | None = None, alike: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of a cell, by the distance of the rows; with sizes (rising in a cell), only where they can be alike."""
    i, d = np.arange(len(cell)), 1
    while True:
        i = i[: np.searchsorted(i, len(cell) - d)]
        on = cell[i + d] == cell[i]
        if size is not None:
            on &= size[i] >= alike * size[i + d]
        i = i[on]
        if not len(i):
            return
        yield i, i + d
        d += 1


def _linked(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    near = _manhattan(_counts(x), _counts(y)) <= most
    near[near] = np.bitwise_count((x ^ y)[near]) <= most
    return near


class _Forest:
    """Spanning forest of links between nodes 0 to n - 1."""

    def __init__(self, n: int):
        self.up, self.a, self.b = np.arange(n), [], []

    def roots(self) -> np.ndarray:
        while not np.array_equal(root := self.up[self.up], self.up):
            self.up = root
        return root

    def _find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        step = 64
        while len(a):
            root = self.roots()
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            for x, y in zip(a[:step].tolist(), b[:step].tolist(), strict=True):
                p, q = self._find(x), self._find(y)
                if p != q:
                    self.up[max(p, q)] = min(p, q)
                    self.a.append(x)
                    self.b.append(y)
            a, b, step = a[step:], b[step:], 2 * step


def _forest(most: int):
    def work(cols: list[np.ndarray]) -> pa.RecordBatch:
        cell, fp = cols[0], cols[1].view(np.uint64)
        names, node = np.unique(fp, return_inverse=True)
        forest = _Forest(len(names))
        for i, j in _meetings(cell):
            on = _linked(fp[i], fp[j], most)
            forest.add(node[i[on]], node[j[on]])
        return pa.RecordBatch.from_arrays([_signed(names[np.array(x, np.int64)]) for x in (forest.a, forest.b)], ["a", "b"])

    return work


def links(distinct: DataFrame, most: int = DISTANCE, crowd: int | None = None) -> DataFrame:
    """(fp) distinct -> (a, b): edges that connect exactly the fingerprints that links of at most `most` bits connect."""
    if most > 4:
        raise ValueError("the grid's reach of one step on both sides covers at most 4 bits")
    cells = distinct.select("fp").mapInArrow(_cells(HALVES), "cell long, fp long")
    return _by_cell(cells, _forest(most), "a long, b long", crowd)


def near_duplicates(docs: DataFrame, text: str = "text", most: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row."""
    fps = staged(fingerprints(docs, text), "simhash-fps")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    roots = components(links(classes, most))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = staged(named, "simhash-roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    component = spread_join(named, ids.select("root", "component_id"), ["root"], hot_keys(ids, ["root"]), F.col("fp"))
    component = staged(component.select("fp", "component_id"), "simhash-components")
    out = spread_join(fps, component, ["fp"], hot_keys(classes, ["fp"]), F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# One document of each group of texts that are alike


def _shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the five-word shingles."""
    return np.unique(np.concatenate([*_hashes(words, ALIKE_SHINGLE), np.empty(0, np.uint64)]))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, ...) -> (..., node, fp, check, size): digest, fingerprints of two- and five-word shingles, distinct of the latter."""
    for b in batches:
        got = []
        for x in b.column(0).cast(pa.binary()):
            words = _words(x.as_buffer().to_pybytes() if x.is_valid else b"")
            five = _shingles(words)
            got.append((xxhash.xxh3_64_intdigest(b" ".join(words)), _simhash(_hashes(words, NEAR_SHINGLE)), _simhash([five]), len(five)))
        node, fp, check, size = zip(*got, strict=True) if got else ([], [], [], [])
        cols = [*b.columns[1:], _signed(node), _signed(fp), _signed(check), pa.array(size, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[1:], "node", "fp", "check", "size"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [_shingles(_words(x.as_buffer().to_pybytes() if x.is_valid else b"")).view(np.int64) for x in b.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], ["node", "set"])


def _candidates(cols: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of cells, by size -> (a, b, crowd): all candidates, or where a row has more than FEW the members of its crowd with their least.

    A crowd is what hangs together there; its pairs are looked at later.
    """

    cell, node, fp, check, size = cols
    fp, check = fp.view(np.uint64), check.view(np.uint64)
    many, forest, held = np.zeros(len(cell), np.int64), _Forest(len(cell)), []
    for i, j in _meetings(cell, size, ALIKE):
        on = np.flatnonzero(np.bitwise_count(fp[i] ^ fp[j]) <= NEAR_BITS)
        on = on[np.bitwise_count(check[i[on]] ^ check[j[on]]) <= CHECK_BITS]
        if len(on):
            i, j = i[on], j[on]
            many[i] += 1
            many[j] += 1
            forest.add(i, j)
            few = (many[i] <= FEW) & (many[j] <= FEW)
            held.append((i[few], j[few]))
    i, j = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 2
    root, least = forest.roots(), np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, root, node)
    crowded = np.isin(root, root[many > FEW])
    alone, member = ~crowded[i], np.flatnonzero(crowded & (node != least[root]))
    crowd = np.repeat([False, True], [int(alone.sum()), len(member)])
    x, y = np.concatenate([node[i[alone]], least[root[member]]]), np.concatenate([node[j[alone]], node[member]])
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(crowd)], ["a", "b", "crowd"])


def _tile(rows: pa.Table) -> pa.Table:
    """Two blocks of a crowd, lo and hi -> spanning forest of the alike pairs between them (or within, where they are one)."""
    node, block = rows["node"].to_numpy(), rows["block"].to_numpy()
    sets = rows["set"].combine_chunks()
    at = sets.offsets.to_numpy() - sets.offsets[0].as_py()
    size = np.diff(at)
    token = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(len(node)), size)[order]
    first = np.append(np.flatnonzero(np.concatenate(([True], np.diff(token[order]) > 0))), len(order))
    lo, hi = rows["lo"][0].as_py(), rows["hi"][0].as_py()
    forest, other = _Forest(len(node)), np.flatnonzero(block == hi)
    for i in np.flatnonzero(block == lo).tolist():
        held = [holder[first[t] : first[t + 1]] for t in token[at[i] : at[i + 1]].tolist()]
        both = np.bincount(np.concatenate(held), minlength=len(node))[other]
        j = other[both >= ALIKE * (size[i] + size[other] - both)]
        forest.add(np.full(len(j), i), j)
    return pa.table({"a": node[np.array(forest.a, int)], "b": node[np.array(forest.b, int)]})


def alike(texts: DataFrame, sets, crowd: int | None = None) -> DataFrame:
    """(node, fp, check, size) distinct -> (a, b): verified pairs that connect what all verified candidates connect.

    sets(nodes) gives (node, set) of those nodes.
    """
    cells = texts.select("node", "fp", "check", "size").mapInArrow(freed(_cells(THIRDS)), "cell long, node long, fp long, check long, size int")
    found = _by_cell(cells, _candidates, "a long, b long, crowd boolean", crowd)
    found = staged(found.distinct(), "near-candidates")
    held = staged(sets(found.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "near-sets")
    pairs = found.where("not crowd")
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("sum"))
    good = staged(both.where(F.col("n") >= ALIKE * (F.col("sum") - F.col("n"))).select("a", "b"), "near-alike")
    # Each member's least is enough if its others are tied to that; it has no more of them than cells.
    crowds = found.where("crowd").groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("ties"))
    crowds = crowds.select(F.col("ties")[0].alias("a"), F.explode(F.concat(F.array("b"), F.slice("ties", 2, F.size("ties")))).alias("b")).distinct()
    crowds = staged(crowds, "near-ties")
    if crowds.isEmpty():
        return good
    members = staged(components(crowds).join(held, "node"), "near-crowds")
    blocks = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum(F.size("set")) / TILE).cast("int").alias("blocks"))
    members = spread_join(members, blocks.select("root", "blocks"), ["root"], hot_keys(blocks, ["root"]), F.col("node"))
    members = members.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))
    tiles = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("root", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "node", "block", "set")
    return good.unionByName(tiles.groupBy("root", "lo", "hi").applyInArrow(_tile, "a long, b long"))


def representatives(docs: DataFrame, text: str = "text", crowd: int | None = None) -> DataFrame:
    """The documents, one row of each group of alike texts: the one with the smallest doc_id."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.where("doc_id is not null").select(F.col(f"`{text}`").alias("text"), whole, F.monotonically_increasing_id().alias("row"))
    kept = rows.drop("text").schema.add("node", "long").add("fp", "long").add("check", "long").add("size", "integer")
    rows = staged(rows.mapInArrow(freed(_texts), kept), "near-texts")
    order = F.struct(F.col("whole.doc_id").alias("id"), F.xxhash64(F.col(f"whole.`{text}`")).alias("h"), "row")
    texts = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("check").alias("check"), F.first("size").alias("size"), F.min(order).alias("best"))
    texts = staged(texts, "near-classes")

    def sets(nodes: DataFrame) -> DataFrame:
        chosen = texts.join(nodes, "node").select(F.col("best.row").alias("row"))
        return rows.join(chosen, "row", "left_semi").select("node", F.col(f"whole.`{text}`").alias("text")).mapInArrow(freed(_sets), "node long, set array<long>")

    roots = components(alike(texts, sets, crowd))
    best = texts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    return rows.join(best.select(F.col("best.row").alias("row")), "row", "left_semi").select("whole.*").unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
