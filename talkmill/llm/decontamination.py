"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are a stated query set: blocks of at most BLOCK_BYTES of items are broadcast, and each is held against all documents, so what
a task holds is bounded however long the benchmark is. Words are numbers into the block's vocabulary, so seeds are looked up for whole
batches of texts at once and the words that no item has cost nothing. A seed is three words of an item, in a row or with a gap after
the second, whatever its frequency: rare ones alone would lose the copies whose rare words were replaced. So a copy is found if it has
three unchanged words in a row, or two, any one and a third. Around the hits of an item in a document the passage is aligned with the
item by Smith-Waterman over words, unless it has too few of the item's words for any alignment to reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import need, text_batches

#: Offsets of the words of a seed.
SHAPES = ((0, 1, 2), (0, 1, 3))
#: Bytes of the items that are broadcast at once.
BLOCK_BYTES = 16 << 20
MATCH, THRESHOLD = 2, 0.4
#: Byte -> lower case, or a space for what isn't an ASCII letter or digit or part of another character.
_BYTES = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words without ASCII punctuation, A-Z in lower case."""
    return text.translate(_BYTES).split()


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words of each text, all words in order), as words_of has them; null texts have none."""
    texts = texts.take(pa.array(np.arange(len(texts)))).fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    plain = pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_BYTES)))
    parts = pc.ascii_split_whitespace(plain)
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(full)])
    ends = np.asarray(parts.offsets)
    return upto[ends[1:]] - upto[ends[:-1]], flat.filter(pa.array(full))


def _rows(item: np.ndarray, passage: np.ndarray) -> Iterator[np.ndarray]:
    m = len(passage)
    at = np.arange(m + 1)
    row = np.zeros(m + 1, np.int32)
    for w in item:
        new = np.zeros(m + 1, np.int32)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, -1), row[1:] - 1)
        np.maximum(new, 0, out=new)
        # gaps in the item: the best earlier cell of this row, less one a step
        row = np.maximum.accumulate(new + at) - at
        yield row


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over word numbers (match 2, mismatch -1, gap -1): best score, and the end of its passage part, and the number of item words seen by then."""
    best, end, top = 0, 0, 0
    for i, row in enumerate(_rows(item, passage)):
        k = int(row.argmax())
        if row[k] > best:
            best, end, top = int(row[k]), k, i + 1
    return best, end, top


def start_of(item: np.ndarray, passage: np.ndarray, score: int) -> int:
    """Where an alignment of that score begins which ends with the last words of both: the latest such place, found by aligning backwards."""
    first = len(passage)
    for row in _rows(item[::-1], passage[::-1]):
        hit = np.nonzero(row >= score)[0]
        if len(hit):
            first = min(first, len(passage) - int(hit[0]))
            break
    return first


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(shape: int, *words: np.ndarray) -> np.ndarray:
    key = np.full(len(words[0]), shape + 1, np.uint64)
    for w in words:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64))
    return key


class Block:
    """Items of a block: their words as numbers and their seeds."""

    def __init__(self, items: list[tuple[int, bytes]]):
        words = [words_of(t) for _, t in items]
        self.items = [k for k, _ in items]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        self.vocabulary = list(number)
        self.ids = [np.array([number[w] for w in ws], np.int64) for ws in words]
        self.bags = [np.unique(x, return_counts=True) for x in self.ids]
        keys, owner, at = [], [], []
        #: Offsets of the seeds in use: those of SHAPES, and all words in a row of items that are too short for these.
        self.shapes = list(SHAPES) + [tuple(range(n)) for n in (1, 2) if any(len(x) == n for x in self.ids)]
        for k, x in enumerate(self.ids):
            for s, shape in enumerate(self.shapes):
                n = len(x) - shape[-1]
                if n > 0 and (len(shape) == 3 or len(x) == len(shape)):
                    keys.append(_keys(s, *[x[o : o + n] for o in shape]))
                    owner.append(np.full(n, k))
                    at.append(np.arange(n))
        none = [np.zeros(0, np.int64)]
        key = np.concatenate(keys or [np.zeros(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        self.owner, self.at = np.concatenate(owner or none)[order], np.concatenate(at or none)[order]
        self.seeds, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The words' numbers, -1 for words that no item has."""
        if not hasattr(self, "_set"):
            self._set = pc.SetLookupOptions(pa.array(self.vocabulary, pa.large_binary()).cast(pa.large_string()))
        return pc.index_in(words, options=self._set).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "_set"}

    def hits(self, numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, place in the item) of every seed among the words of documents end to end."""
        out = []
        for s, shape in enumerate(self.shapes):
            n = len(numbers) - shape[-1]
            if n <= 0 or not len(self.seeds):
                continue
            ok = doc[:n] == doc[shape[-1] : shape[-1] + n]
            for o in shape:
                ok &= numbers[o : o + n] >= 0
            i = np.nonzero(ok)[0]
            key = _keys(s, *[numbers[i + o] for o in shape])
            k = np.minimum(np.searchsorted(self.seeds, key), len(self.seeds) - 1)
            found = np.nonzero(self.seeds[k] == key)[0]
            i, k = i[found], k[found]
            size = self.first[k + 1] - self.first[k]
            upto = np.cumsum(size)
            each = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.first[k] - upto + size, size)
            out.append((np.repeat(i, size), self.owner[each], self.at[each]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([o[c] for o in out]) if out else none for c in range(3))

    def common(self, k: int, passage: np.ndarray) -> int:
        """Words that item and passage have in common, repeated ones as often as both have them: no alignment has more matches."""
        kinds, n = self.bags[k]
        at = np.minimum(np.searchsorted(kinds, passage), len(kinds) - 1)
        return int(np.minimum(np.bincount(at[kinds[at] == passage], minlength=len(kinds)), n).sum())


def passages(hits: list[tuple[int, int]], length: int, n_words: int) -> list[tuple[int, int]]:
    """Word ranges of the document that may hold the item, from (document position, item position) of its seeds; overlapping ones are merged."""
    slack = length // 2 + 4
    out: list[list[int]] = []
    # by their left ends, not by the hits' places: a later hit of a later part of the item may reach further back
    for a, z in sorted((max(0, d - i - slack), min(n_words, d - i + length + slack)) for d, i in hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def best_passage(block: Block, k: int, words: np.ndarray, hits: list[tuple[int, int]], threshold: float) -> tuple[float, int, int] | None:
    """(score, first word, words) of the item's best alignment about its hits in a document, if it reaches threshold."""
    item = block.ids[k]
    best = (0, 0, 0, 0)
    for a, z in passages(hits, len(item), len(words)):
        seen = words[a:z]
        if block.common(k, seen) / len(item) < threshold:
            continue
        s, end, top = align(item, seen)
        if s > best[0]:
            best = (s, a, end, top)
    s, a, end, top = best
    if not s or s / (MATCH * len(item)) < threshold:
        return None
    first = start_of(item[:top], words[a : a + end], s)
    return s / (MATCH * len(item)), a + first, end - first


def matches(texts: pa.Array, block: Block, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, words) of each item whose best passage in a text reaches threshold."""
    size, flat = split(texts)
    numbers = block.numbers(flat)
    doc = np.repeat(np.arange(len(size)), size)
    start = np.cumsum(size) - size
    at, item, place = block.hits(numbers, doc)
    order = np.lexsort((place, at, item, doc[at]))
    at, item, place, owner = at[order], item[order], place[order], doc[at[order]]
    cuts = np.nonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]), [True]]))[0] if len(at) else []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        d, k = int(owner[a]), int(item[a])
        got = best_passage(block, k, numbers[start[d] : start[d] + size[d]], list(zip((at[a:z] - start[d]).tolist(), place[a:z].tolist(), strict=True)), threshold)
        if got:
            yield d, block.items[k], *got


SCHEMA = "doc_id long, item_id long, score double, first_word long, n_words long"


def _search(block, threshold: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(matches(b.column(1), block.value, threshold)) if b.num_rows else []
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            ids = b.column(0).take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols[1:], (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]], names=["doc_id", "item_id", "score", "first_word", "n_words"])

    return search


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of at most block_bytes (a longer item is a block of its own); null ids, null and wordless texts hold nothing to find.

    Repeated rows count once; an id with several texts has a result for each.
    """
    need(benchmark, "item_id", "text")
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    now: list[tuple[int, bytes]] = []
    size = 0
    for k, t in rows.toLocalIterator():
        raw = t.encode()
        if now and size + len(raw) > block_bytes:
            yield Block(now)
            now, size = [], 0
        if words_of(raw):
            now.append((k, raw))
            size += len(raw)
    if now:
        yield Block(now)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item whose best alignment reaches threshold of the item's words: doc_id, item_id, score, first_word, n_words.

    A score is twice the matches less mismatches and gaps, over twice the item's words, so an exact copy has 1. Whole texts are searched; null and
    empty texts match nothing; repeated rows give repeated results; ties go to the earliest passage. Other columns of docs, whatever their names, play no part.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    text_batches(spark)
    out = None
    for block in blocks(benchmark, block_bytes):
        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_search(spark.sparkContext.broadcast(block), threshold), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _hit(block, threshold: float):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        for d, *_ in matches(pa.array(texts, pa.string()), block.value, threshold):
            out[d] = True
        return pd.Series(out)

    return hit


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no item reaches threshold, all columns as they are; null and empty texts stay. Only the text goes through Python."""
    need(docs, "text")
    text_batches(docs.sparkSession)
    names, out = docs.columns, docs
    for block in blocks(benchmark, block_bytes):
        out = out.where(~_hit(docs.sparkSession.sparkContext.broadcast(block), threshold)("text"))
    return out.select(*names)
