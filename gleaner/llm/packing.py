"""Packing into training sequences by order-preserving dynamic programming.

Documents are tokenised in input order into one stream per input partition.  Windows of at most 2048 ids are cut from it at
document or sentence ends so that padding plus cut penalties are least: with f[j] the cost of packing up to cut j,

    f[j] = min over j - 2048 <= i < j of f[i] + padding(j - i), plus penalty[j]

where padding(n) = 2048 - n, or 0 at a power of two.  The first kind of transition is a sliding-window minimum of
f[i] + i - a monotone queue - and the second kind adds twelve more per cut.  Only where no document or sentence ends for
2048 ids may a cut fall elsewhere.

Streams are packed BLOCK ids at a time; the last window of a block opens the next, so memory doesn't grow with the
partition and nothing is shuffled.  sequence_id holds the partition in its upper bits.

Defined results: null and empty text is one document of its closing id alone; repeated rows are packed as often as they
occur; null doc_id is carried; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import freed, table
from .training import Cache

WIDTH = 2048
#: Closes every document.
CLOSE = 1
#: Costs of a cut, in ids of padding: none between documents, some after a sentence, more elsewhere.
AFTER_SENTENCE, ELSEWHERE = 4.0, 64.0
#: Ids that are packed at a time.
BLOCK = 1 << 18
_CLOSE = array("I", [CLOSE]).tobytes()
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words whose normal form is their lower case: printable ASCII and the precomposed letters of Latin-1 and Latin Extended-A.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: The vocabulary's split of such words after lower-casing: endings, letters, single digits, punctuation.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[!-/:-@\\[-`{-~]+")


#: How that vocabulary splits texts; any other one gets whole texts.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]


def _splits_words(spec: dict) -> bool:
    """Whether a tokenizer's description is that of words split here: lower case, white space dropped, byte letters, word ends."""
    normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        normal == _NORMAL and len(before) == 2 and before[0].get("pattern") == {"Regex": _SPLIT} and before[0].get("behavior") == "Removed"
        and before[1].get("type") == "ByteLevel" and not before[1].get("add_prefix_space") and not before[1].get("use_regex")
        and spec["model"].get("end_of_word_suffix") == "</w>" and spec.get("post_processor") is None
    )


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: itself where printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """text -> ids.  Where the tokenizer drops white space and never joins across it, words are encoded one by one and kept.

    Plain words are split here and their parts given to the vocabulary's merges, which costs a fifth of the whole
    tokenizer; any other word goes through the whole tokenizer, and so does a text where the tokenizer splits otherwise.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.by_word = _splits_words(json.loads(Path(vocabulary).read_text(encoding="utf-8")))
        self.letters = _byte_letters()
        self.words, self.parts = Cache(self._word), Cache(self._part)
        size = self.tokenizer.get_vocab_size()
        #: Whether a sentence ends after an id.
        self.ends = np.zeros(max(size, CLOSE + 1), bool)
        for word, i in self.tokenizer.get_vocab().items():
            self.ends[i] = word.removesuffix("</w>")[-1:] in (".", "!", "?") and (word.endswith("</w>") or not self.by_word)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join([self.letters[b] for b in part.encode()])
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, CLOSE], np.uint32)
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return np.frombuffer(b"".join([*map(self.words.__getitem__, words), _CLOSE]), np.uint32)


def cuts(at: np.ndarray, penalty: np.ndarray, width: int = WIDTH) -> list[int]:
    """Indices into `at` of the cheapest window ends; `at` rises from 0, steps by at most width, and ends with the stream."""
    n = len(at)
    pos, pen = at.tolist(), penalty.tolist()
    # For each cut, the cuts a power of two before it.
    index = np.full(int(at[-1]) + 1, -1, np.int64)
    index[at] = np.arange(n)
    hits = []
    for k in range(width.bit_length()):
        j = np.flatnonzero(at >= 1 << k)
        i = index[at[j] - (1 << k)]
        hits.append(np.stack([j, i])[:, i >= 0])
    hits = np.concatenate(hits, 1)
    hits = hits[:, np.argsort(hits[0], kind="stable")]
    first = np.searchsorted(hits[0], np.arange(n + 1)).tolist()
    before = hits[1].tolist()
    cost, came = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # (f[i] + i, place of i, i), rising
    for j in range(1, n):
        p = pos[j]
        low = p - width
        while queue[0][1] < low:
            queue.popleft()
        best, _, i = queue[0]
        best += width - p
        for k in before[first[j] : first[j + 1]]:
            if cost[k] < best:
                best, i = cost[k], k
        cost[j] = best = best + pen[j]
        came[j] = i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    out = [n - 1]
    while came[out[-1]]:
        out.append(came[out[-1]])
    return out[::-1]


def _candidates(ids: np.ndarray, ends: np.ndarray, closes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, and at which penalty: document and sentence ends, and inside of longer sentences."""
    last = np.flatnonzero(ends[ids] | closes) + 1
    at = np.unique(np.concatenate([[0], last, [len(ids)]]))
    gaps = np.diff(at)
    extra = [np.arange(a + width // 2, a + g, width // 2) for a, g in zip(at[:-1][gaps > width], gaps[gaps > width], strict=True)]
    at = np.unique(np.concatenate([at, *extra])) if extra else at
    penalty = np.full(len(at), ELSEWHERE)
    inner = at > 0
    penalty[inner] = np.where(closes[at[inner] - 1], 0.0, np.where(ends[ids[at[inner] - 1]], AFTER_SENTENCE, ELSEWHERE))
    penalty[at == len(ids)] = 0.0
    return at, penalty


class Packer:
    """Streams documents into pieces."""

    def __init__(self, encode: Encoder, first_sequence: int, width: int = WIDTH, block: int = BLOCK):
        self.encode, self.width, self.block = encode, width, max(block, 4 * width)
        self.sequence = first_sequence
        self.docs: list[tuple] = []  # (doc_id, ids, ids before the ones still here)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.held += len(ids)
        return self.pack(False) if self.held >= self.block else []

    def pack(self, everything: bool) -> list[tuple]:
        if not self.docs:
            return []
        left = [ids[gone:] for _, ids, gone in self.docs]
        ids = np.concatenate(left)
        bounds = np.cumsum([len(x) for x in left])
        closes = np.zeros(len(ids), bool)
        closes[bounds - 1] = True
        at, penalty = _candidates(ids, self.encode.ends, closes, self.width)
        chosen = at[cuts(at, penalty, self.width)].tolist()
        if not everything:
            chosen.pop()  # the last window goes on in the next block
        out, begin, d = [], 0, 0
        starts = [0, *bounds.tolist()]
        for end in chosen:
            x = begin
            while x < end:
                doc_id, whole, gone = self.docs[d]
                stop = min(end, starts[d + 1])
                out.append((doc_id, gone + x - starts[d], stop - x, zlib.crc32(ids[x:stop].astype("<u4").tobytes()), len(whole), self.sequence, x - begin))
                x = stop
                if x == starts[d + 1]:
                    d += 1
            begin = end
            self.sequence += 1
        rest = self.docs[d:]
        if rest and begin > starts[d]:
            doc_id, whole, gone = rest[0]
            rest[0] = (doc_id, whole, gone + begin - starts[d])
        self.docs, self.held = rest, len(ids) - begin
        return out


def _pack(vocabulary: str, width: int):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        packer = Packer(encode, TaskContext.get().partitionId() << 40, width)
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                if rows := packer.add(doc_id.as_py(), encode(text.as_py() or "")):
                    yield batch(rows)
        yield batch(packer.pack(True))

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, width: int = WIDTH, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return docs.select("doc_id", text).mapInArrow(freed(_pack(vocabulary or default_vocabulary(), width)), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
