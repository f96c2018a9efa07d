"""Unbounded n-gram scoring with suffix arrays.

The context of a token is the text of its document before it, read backwards to the document's start, which counts as a token of its
own. A token is scored by the longest context that the training documents have: (count of context and token + m * p) / (count of the
context + m), where p is the unigram probability of the base score and m falls with the length of the context (MASS).

Training positions, sorted by their contexts, are a suffix array of the reversed corpus. It is sharded by content: a position and all
positions that share a context of the length in question meet in one shard, so a looked-up position visits one shard a step, whatever the
size of the corpus.

1. Whole histories: how many training documents share a document's first i tokens is a count of equal prefix hashes, first at
   lengths 1, 2, 4, ... and then at all lengths up to the first power that isn't shared. This settles training documents, which are part of
   what they are scored by, and every position of others whose history a training document starts with.
2. Contexts of up to DEPTH tokens: shards by the last token. Frequent tokens, pairs and triples are split by one token more each; the counts
   of the frequent contexts themselves are summed over the shards.
3. Windows of W to K tokens, for positions whose longest context is longer: shards by the rarest or least-hashed part of the last W
   tokens, so neighbouring positions travel together with the K tokens before them. A shard holds the suffix array of its distinct
   windows; each asked context finds its longest match and the range that shares it by binary search. Positions that match all K tokens,
   and the training positions they match, go on to the next windows, until none is left.

Tokens travel as ranks by frequency in compressed blocks. Equal segments of a chunk of documents travel once, with a weight.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import fold_of, need, read_staged, release, remove, staged, text_batches, write_staged

DEPTH = 4
#: Prior mass by context length, from 1; longer contexts have the last.
MASS = (16.0, 8.0, 4.0, 1.0)
#: Growth of the windows after the first one, which ends at 4 * DEPTH.
GROWTH = 8
#: Tokens of a chunk of documents, of a shard of short contexts on average, and those shipped to a shard of windows.
CHUNK_TOKENS, RANGE_TOKENS, SHARD_TOKENS = 1_500_000, 1_000_000, 2_500_000
END = xxhash.xxh64_intdigest(b"", 7)
_B = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> _U(20)) % _U(parts)).astype(np.int32)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers by byte planes, compressed together."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [a.dtype.str[1:3].encode(), struct.pack("<q", len(a)), (a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else a).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(b: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    out, at = [], 1
    for _ in range(raw[0]):
        kind, n = np.dtype("<" + raw[at : at + 2].decode()), struct.unpack_from("<q", raw, at + 2)[0]
        at += 10
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the fewest bytes."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def _batch(schema: str, **columns) -> pa.RecordBatch:
    """A batch of the schema; columns not given are null."""
    names = [c.split() for c in schema.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], _TYPES[t]) if k in columns else pa.nulls(n, _TYPES[t]) for k, t in names], names=[k for k, _ in names])


def _schema(schema: str) -> pa.Schema:
    return pa.schema([(k, _TYPES[t]) for k, t in (c.split() for c in schema.split(", "))])


def _table(schema: str, out: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(out, _schema(schema)) if out else _schema(schema).empty_table()


def _sent(schema: str, rows: list[tuple], each: int = 64) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in schema.split(", ")]
    for k in range(0, len(rows), each):
        yield _batch(schema, **dict(zip(names, zip(*rows[k : k + each], strict=True), strict=False)))


CHUNK = "chunk long, ids binary, nulls binary, held binary, ends binary, tokens binary, words binary, counts binary, n long, train long"


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words of each text, all words in order): ASCII letters in lower case, cut at ASCII white space."""
    if texts.offset:  # some kernels misread slices
        texts = texts.take(pa.array(np.arange(len(texts))))
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(full)])
    offsets = np.asarray(parts.offsets) - parts.offsets[0].as_py()
    return upto[offsets[1:]] - upto[offsets[:-1]], flat.filter(pa.array(full))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents: tokens as numbers into the chunk's words (hashes) and each word's count in training documents."""
    from pyspark import TaskContext

    base, k = TaskContext.get().partitionId() << 24, 0
    ids: list[int | None] = []
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    words: list[pa.Array] = []
    n = 0

    def flush() -> pa.RecordBatch:
        coded = pa.chunked_array(words, pa.large_string()).combine_chunks().dictionary_encode()
        own = coded.indices.to_numpy()
        kinds = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
        size, out = np.concatenate(sizes), np.concatenate(held)
        ends = np.cumsum(size + 1)
        tokens = np.full(ends[-1], len(kinds), np.uint32)
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = False
        tokens[inner] = own
        train = np.repeat(~out, size + 1)
        # twice the count in training documents, and 1 if a document to score has the word
        counts = 2 * np.bincount(tokens[train], minlength=len(kinds) + 1) + (np.bincount(tokens[~train], minlength=len(kinds) + 1) > 0)
        nulls = np.array([i is None for i in ids])
        row = (base + k, np.array([i or 0 for i in ids], np.int64).tobytes(), nulls.tobytes(), out.tobytes(), ends.astype(np.int64).tobytes(), _pack(_small(tokens)), np.append(kinds, _U(END)).tobytes(), counts.astype(np.int64).tobytes(), len(tokens), int((~out).sum()))
        return next(_sent(CHUNK, [row]))

    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            size, flat = words_of(part.column(2))
            ids += part.column(0).to_pylist()
            held.append(part.column(1).to_numpy(zero_copy_only=False).astype(bool))
            sizes.append(size)
            words.append(flat)
            n += len(flat) + len(size)
            if n >= CHUNK_TOKENS:
                yield flush()
                ids, held, sizes, words, n, k = [], [], [], [], 0, k + 1
    if ids:
        yield flush()


def _words(parts: int):
    """A block a chunk and part of the vocabulary: places in the chunk's words, the words, their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w, n = np.frombuffer(w, np.uint64), np.frombuffer(n, np.int64)
                yield from _sent("part int, chunk long, block binary", [(k, c, _pack(_small(at), w[at], _small(n[at]))) for k, at in _cut(_part(w, parts), parts)])

    return run


def _cut(part: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, the places it has in ascending order) of the parts that have some."""
    if parts < 1 << 16:
        part = part.astype(np.uint16)  # sorted by digits
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [(k, order[cuts[k] : cuts[k + 1]]) for k in np.nonzero(np.diff(cuts))[0].tolist()]


RANKS = "chunk long, block binary, n long, v long, asked long"


def _rank(parts: int):
    """A part of the vocabulary: every chunk's words with rank and training count; the row without chunk sums the part up.

    Ranks start at 1, and the parts deal them out in turn: frequent words low, words that no document to score has last.
    """

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        blocks = [(c, *_unpack(x)) for c, x in zip(t.column("chunk").to_pylist(), t.column("block").to_pylist(), strict=True)]
        kinds, inverse = np.unique(np.concatenate([w for _, _, w, _ in blocks]), return_inverse=True)
        n = np.concatenate([n.astype(np.int64) for *_, n in blocks])
        total = np.bincount(inverse, n >> 1, len(kinds)).astype(np.int64)
        asked = np.bincount(inverse, n & 1, len(kinds)) > 0
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((kinds, -total, ~asked))] = np.arange(len(kinds)) * parts + part + 1
        if int(rank.max(initial=0)) >= 1 << 32:
            raise ValueError("more than 2^32 words")
        rows, at = [], 0
        for c, places, w, _ in blocks:
            k = inverse[at : at + len(w)]
            at += len(w)
            rows.append((c, _pack(places, _small(rank[k]), _small(total[k])), 0, 0, 0))
        rows.append((None, None, int(total.sum()), int((total > 0).sum()), int(asked.sum())))
        return _table(RANKS, list(_sent(RANKS, rows)))

    return run


FULL = "chunk long, ids binary, nulls binary, held binary, ends binary, tokens binary, counts binary"


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their tokens as ranks, and the training counts of their words in the order of the ranks."""
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            blocks = [_unpack(x) for x in row["blocks"]]
            places, ranks, counts = (np.concatenate([x[c] for x in blocks]) for c in range(3))
            rank = np.empty(len(places), np.uint32)
            rank[places] = ranks
            order = np.argsort(ranks)
            row["tokens"] = _pack(rank[_unpack(row["tokens"])[0]])
            row["counts"] = _pack(_small(np.diff(ranks[order], prepend=0)), _small(counts[order]))
            yield next(_sent(FULL, [tuple(row[c.split()[0]] for c in FULL.split(", "))]))


class Chunk:
    """A chunk's documents end to end: s has the rank of each token and, before each document, 0 for its start."""

    def __init__(self, row: dict):
        self.chunk = row["chunk"]
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.held = np.frombuffer(row["held"], bool)
        #: Tokens of each document, with its end; the place of its start in s.
        self.sizes = np.diff(self.ends, prepend=0)
        self.first = self.ends - self.sizes + np.arange(len(self.ends))
        n = int(self.ends[-1]) + len(self.ends)
        real = np.ones(n, bool)
        real[self.first] = False
        self.s = np.zeros(n, np.uint32)
        self.s[real] = _unpack(row["tokens"])[0]
        #: Context length before each place: all tokens of the document before it, and its start.
        self.left = np.arange(n, dtype=np.int32) - np.repeat(self.first, self.sizes + 1).astype(np.int32)
        self._sums: tuple[np.ndarray, np.ndarray] | None = None

    def of_held(self) -> np.ndarray:
        return np.repeat(self.held, self.sizes + 1)

    def before(self, at: np.ndarray, k: int) -> np.ndarray:
        """The token k places before each, 0 at and beyond the document's start."""
        return np.where(self.left[at] > k, self.s[np.maximum(at - k, 0)], 0)

    def hash(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Of the tokens from a to z."""
        if self._sums is None:
            self._sums = sums(self.s)
        total, down = self._sums
        return (total[z] - total[a]) * down[a]


def sums(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes of s and the powers that take a piece's hash back to the start."""
    up = np.full(len(s) + 1, _B, np.uint64)
    up[:1] = 1
    down = np.full(len(s) + 1, pow(_B, -1, 1 << 64), np.uint64)
    down[:1] = 1
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(s.astype(np.uint64) + _U(1)) * np.multiply.accumulate(up)[:-1])]), np.multiply.accumulate(down)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, dict]]:
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            yield Chunk(row), row


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after another."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - upto + sizes, sizes)


# -- whole histories


def _ladder(x: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, length, key) of prefixes of 1, 2, 4, ... tokens."""
    doc, length = [], []
    k = 1
    while (d := np.nonzero(x.sizes >= k)[0]).size:
        doc.append(d)
        length.append(np.full(len(d), k))
        k *= 2
    d, n = np.concatenate(doc), np.concatenate(length)
    return d, n, _history_keys(x, d, n)


def _history_keys(x: Chunk, doc: np.ndarray, length: np.ndarray) -> np.ndarray:
    a = x.first[doc] + 1
    return _mix(x.hash(a, a + length) + _mix(length.astype(np.uint64)))


def _histories(x: Chunk, ladder: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, length, key) of the prefixes up to the first step of the ladder that is not shared; ladder: the sums at its steps, to which
    a training document adds 2 and another one 1."""
    doc, n, _ = _ladder(x)
    shared = ladder > np.where(x.held[doc], 1, 2)
    top = np.zeros(len(x.sizes), np.int64)
    np.maximum.at(top, doc[shared], n[shared])
    size = np.where(top > 0, np.minimum(2 * top - 1, x.sizes), 0)
    d = np.repeat(np.arange(len(size)), size)
    length = spans(np.ones(len(size), np.int64), size)
    return d, length, _history_keys(x, d, length)


TALLY = "part int, chunk long, block binary"


def _ask(keys: np.ndarray, weights: np.ndarray, parts: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, distinct keys' places, keys, summed weights), the same for the same keys."""
    kinds, inverse = np.unique(keys, return_inverse=True)
    n = np.bincount(inverse, weights, len(kinds)).astype(np.int64)
    return [(k, at, kinds[at], n[at]) for k, at in _cut(_part(kinds, parts), parts)]


def _tally(t: pa.Table) -> pa.Table:
    """The sums of the weights of equal keys, in the order of each chunk's keys."""
    blocks = [_unpack(x) for x in t.column("block").to_pylist()]
    kinds, inverse = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([b[1] for b in blocks]), len(kinds)).astype(np.int64)[inverse]
    ends = np.cumsum([len(b[0]) for b in blocks])
    out = [_pack(_small(total[z - len(b[0]) : z])) for b, z in zip(blocks, ends, strict=True)]
    return pa.table({"part": t.column("part"), "chunk": t.column("chunk"), "block": pa.array(out, pa.binary())}).cast(_schema(TALLY))


def _told(keys: np.ndarray, got: list[dict], parts: int) -> np.ndarray:
    """The sums that a tally has for these keys."""
    kinds, inverse = np.unique(keys, return_inverse=True)
    out = np.zeros(len(kinds), np.int64)
    blocks = {r["part"]: r["block"] for r in got}
    for k, at in _cut(_part(kinds, parts), parts):
        out[at] = _unpack(blocks[k])[0]
    return out[inverse]


def _shared(x: Chunk, row: dict, parts: int) -> np.ndarray:
    """For each place, the training documents that start with its document's tokens up to and with it."""
    n = np.where(x.of_held(), 0, 1)
    doc, length, key = _histories(x, _told(_ladder(x)[2], row["ladder"], parts))
    if len(key):
        n[x.first[doc] + length] = _told(key, row["histories"], parts)
    return n


def _scout(parts: int, least: int):
    """The ladder's keys, and the contexts of 1 to 3 tokens that are frequent in the chunk's training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _rows(batches):
            doc, _, key = _ladder(x)
            yield from _sent(TALLY, [(k, x.chunk, _pack(kinds, _small(n))) for k, _, kinds, n in _ask(key, np.where(x.held[doc], 1, 2), parts)])

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _rows(batches):
            at = np.nonzero(~x.of_held() & (x.left > 1))[0]
            kinds, n = np.unique(x.s[at - 1], return_counts=True)
            at = at[np.isin(x.s[at - 1], kinds[n >= least])]
            gram = np.zeros(len(at), np.uint64)
            for k in range(1, DEPTH):
                c = x.before(at, k)
                at, gram, c = at[c > 0], gram[c > 0], c[c > 0]
                gram = _mix(gram + _U(1) + c * _U(_B))
                kinds, inverse, n = np.unique(gram, return_inverse=True, return_counts=True)
                keep = n >= least
                if not keep.any():
                    break
                yield _batch("level int, gram long, n long", level=np.full(int(keep.sum()), k), gram=kinds[keep].view(np.int64), n=n[keep])
                at, gram = at[keep[inverse]], gram[keep[inverse]]

    return run, hot


def _ask_histories(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, row in _rows(batches):
            doc, _, key = _histories(x, _told(_ladder(x)[2], row["ladder"], parts))
            yield from _sent(TALLY, [(k, x.chunk, _pack(kinds, _small(n))) for k, _, kinds, n in _ask(key, ~x.held[doc], parts)])

    return run


# -- contexts of up to DEPTH tokens


def _grams(back: list[np.ndarray], hot: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(key of the shard, number of lengths for which the context is spread over shards, by length from 1 the places spread so and their contexts' keys).

    A key has as many tokens as it takes to be not frequent; where a frequent context is preceded by the document's start, any shard will do.
    """
    g = _mix(_U(1) + back[0] * _U(_B))
    key, spread, levels = g, np.zeros(len(at), np.int8), []
    hit = np.nonzero(np.isin(g, hot[0]))[0] if len(hot[0]) else np.zeros(0, np.int64)
    g = g[hit]
    for k in range(DEPTH - 1):
        levels.append((hit, g))
        spread[hit] = k + 1
        c = back[k + 1][hit]
        more = _mix(g + _U(1) + c * _U(_B))
        key[hit] = np.where(c > 0, more, _mix(at[hit].astype(np.uint64) + _U(7)))
        go = (c > 0) & np.isin(more, hot[k + 1]) if k + 2 < DEPTH else np.zeros(len(hit), bool)
        hit, g = hit[go], more[go]
    return key, spread, levels


MOVED = "shard int, chunk long, block binary"


def _positions(hot: list[np.ndarray], shards: int, parts: int, last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, row in _rows(batches):
            shared = _shared(x, row, parts)
            held = x.of_held()
            # of documents to score only what no training document's start settles, of others what one to score may ask for
            before = np.arange(len(held)) - 1
            at = np.nonzero((x.left > 1) & np.where(held, shared[before] == 0, x.s[before] <= last))[0]
            back = [x.before(at, k) for k in range(1, DEPTH + 1)]
            shard = _part(_grams(back, hot, at)[0], shards)
            rows = []
            for s, p in _cut(shard, shards):
                # a shard has few of the last tokens: these travel as numbers into a list
                firsts, first = np.unique(back[0][p], return_inverse=True)
                a = at[p]
                rows.append((s, x.chunk, _pack(_small(np.diff(a, prepend=0)), held[a].astype(np.uint8), firsts, _small(first), *[b[p] for b in back[1:]], x.s[a])))
            yield from _sent(MOVED, rows)

    return run


def log_p(pair: np.ndarray, context: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log10 of the smoothed probability; without a context that of the unigram."""
    m = np.where(length > 0, np.array(MASS)[np.clip(length, 1, len(MASS)) - 1], 1.0)
    return np.log10((pair + m * p) / (context + m))


def _unigram(c: np.ndarray, total: int, kinds: int) -> np.ndarray:
    return (c + 0.5) / (total + 0.5 * (kinds + 1))


#: kind 0: places with length, count of the context and of context and token; 1: places whose context goes on; 2: places that wait for
#: (gram, word); 3: training counts of such pairs; 4: ranges that are the same as others.
FOUND = "kind int, chunk long, block binary, gram long, word long, n long"


def _by_chunk(kind: int, chunks: list[int], own: np.ndarray, at: np.ndarray, *columns: np.ndarray) -> list[pa.RecordBatch]:
    rows = []
    for k, hit in _cut(own, len(chunks)):
        hit = hit[np.argsort(at[hit], kind="stable")]
        rows.append((kind, chunks[k], _pack(_small(np.diff(at[hit], prepend=0)), *[_small(c[hit]) for c in columns])))
    return list(_sent(FOUND, rows))


def _settle(hot: list[np.ndarray]):
    """A shard of short contexts: sorted, so that every context is a range; an asked one takes the longest that training positions have."""

    def run(shard: pa.Table) -> pa.Table:
        chunks = shard.column("chunk").to_pylist()
        blocks = [_unpack(b) for b in shard.column("block").to_pylist()]
        own = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(b[0]) for b in blocks])
        at = np.concatenate([np.cumsum(b[0], dtype=np.int64) for b in blocks])
        held = np.concatenate([b[1] for b in blocks]).astype(bool)
        back = [np.concatenate([b[2][b[3]] for b in blocks]), *[np.concatenate([b[k] for b in blocks]) for k in range(4, 3 + DEPTH)]]
        w = np.concatenate([b[3 + DEPTH] for b in blocks])
        del blocks
        a, b = (back[k].astype(np.uint64) << _U(32) | back[k + 1] for k in (0, 2))
        order = np.lexsort((b, a))
        back, held, w, at, own = [x[order] for x in back], held[order], w[order], at[order], own[order]
        del a, b, order
        n = len(at)
        train = ~held
        # splits per place: keys of sorted shards are recomputed, since blocks don't carry them
        _, spread, levels = _grams(back, hot, at)
        fresh = np.zeros(n, bool)
        fresh[:1] = True
        length, group, ctx = np.zeros(n, np.int8), [], []
        for k, x in enumerate(back):
            fresh[1:] |= x[1:] != x[:-1]
            g = np.cumsum(fresh, dtype=np.int32) - 1
            group.append(g)
            ctx.append(np.bincount(g[train], minlength=int(g[-1]) + 1).astype(np.int32)[g])
            # a context that ends before the document's start; longer ones that hold it are whole histories, settled before
            length[(x > 0) & ((ctx[k] > 0) | (spread > k))] = k + 1
        deep = held & (length == DEPTH)
        goes = deep.copy()
        goes[train] = np.bincount(group[-1][deep], minlength=int(group[-1][-1]) + 1)[group[-1][train]] > 0
        goes &= back[-1] > 0
        wait = held & (length > 0) & (length <= spread) & ~deep
        context, pair = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(1, DEPTH):
            q = np.nonzero(held & (length == k) & ~wait)[0]
            if len(q):
                key = group[k - 1].astype(np.uint64) << _U(32) | w
                corpus = np.sort(key[train])
                pair[q] = np.searchsorted(corpus, key[q], "right") - np.searchsorted(corpus, key[q], "left")
                context[q] = ctx[k - 1][q]
        done = np.nonzero(held & (length > 0) & ~wait & ~deep)[0]
        out = _by_chunk(0, chunks, own[done], at[done], length[done], context[done], pair[done])
        hit = np.nonzero(goes)[0]
        out += _by_chunk(1, chunks, own[hit], at[hit])
        for k, (i, gram) in enumerate(levels, 1):
            asked = wait[i] & (length[i] == k)
            q = i[asked]
            if len(q):
                out.append(_batch(FOUND, kind=np.full(len(q), 2), chunk=np.array(chunks)[own[q]], gram=gram[asked].view(np.int64), word=w[q].astype(np.int64), n=at[q] * DEPTH + k))
            mine, v = gram[train[i]], w[i[train[i]]]
            if len(mine):
                key, first, many = np.unique(_mix(mine) ^ v, return_index=True, return_counts=True)
                out.append(_batch(FOUND, kind=np.full(len(key), 3), gram=mine[first].view(np.int64), word=v[first].astype(np.int64), n=many))
        return _table(FOUND, out)

    return run


# -- windows


def _flags(x: Chunk, found: list[dict], last: list[dict]) -> np.ndarray:
    """Places whose contexts go on: found's, and the ranges that were sent as others; last: the ranges that were the same."""
    on = np.zeros(len(x.s), bool)
    for r in found:
        on[np.cumsum(_unpack(r["block"])[0], dtype=np.int64)] = True
    for r in last:
        here, there, n = _unpack(r["block"])
        on[spans(here.astype(np.int64), n.astype(np.int64))] |= on[spans(there.astype(np.int64), n.astype(np.int64))]
    return on


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """At each place the least of the w values that end there."""
    out, have = v.copy(), 1
    while have < w:
        step = min(have, w - have)
        out[step:] = np.minimum(out[step:], out[:-step])
        have += step
    return out


def _cells(x: Chunk, on: np.ndarray, w: int, common: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys): places that share their last w tokens have equal keys, and neighbours often have.

    Up to 4 tokens the key is the rarest one's, or, if all are among the common ones, all tokens'; of more it is that of the least-hashed
    four in a row.
    """
    at = np.nonzero(on)[0]
    if w <= 4:
        top = ~_least(~x.s, w)[at - 1]
        key = _mix(top.astype(np.uint64) + _U(3))
        few = np.nonzero(top <= common)[0]
        key[few] = _mix(x.hash(at[few] - w, at[few]) + _U(5))
        return at, key
    g = np.zeros(len(x.s), np.uint64)
    i = np.arange(3, len(x.s))
    g[3:] = _mix(x.hash(i - 3, i + 1))
    return at, _mix(_least(g, w - 3)[at - 1] + _U(1))


def _windows(w: int, k: int, shards: int, common: int):
    """Segments of flagged neighbours with one key and up to k tokens before them; equal ones of a chunk travel once, with a weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, row in _rows(batches):
            at, key = _cells(x, _flags(x, row["on"], row["same"] or ()), w, common)
            if not len(at):
                continue
            held = x.of_held()[at]
            new = np.concatenate([[True], (np.diff(at) > 1) | (key[1:] != key[:-1])])
            i = np.nonzero(new)[0]
            a, n = at[i], np.diff(i, append=len(at))
            c = np.minimum(x.left[a], k)
            whole = _mix(x.hash(a - c, a + n) ^ _mix((c * 4 + held[i]).astype(np.uint64) << _U(32) | n.astype(np.uint64)))
            _, first, inverse, weight = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            same = np.nonzero(first[inverse] != np.arange(len(a)))[0]
            shard = _part(key[i][first], shards)
            rows = []
            if len(same):
                rows.append((int(x.chunk % shards), x.chunk, b"=" + _pack(*map(_small, (a[same], a[first[inverse[same]]], n[same])))))
            for s, p in _cut(shard, shards):
                u = first[p]
                rows.append((s, x.chunk, b"+" + _pack(_small(a[u]), _small(c[u]), _small(n[u]), held[i][u].astype(np.uint8), _small(weight[p]), x.s[spans(a[u] - c[u], c[u] + n[u])])))
            yield from _sent(MOVED, rows)

    return run


def _farthest(holds: Callable, bound: np.ndarray) -> np.ndarray:
    """For each row the greatest d from 0 to bound for which holds(rows, d), which is monotone and true for 0: steps double, then halve."""
    lo, hi = np.zeros(len(bound), np.int64), bound + 1
    act, step = np.nonzero(bound > 0)[0], 1
    while len(act):
        d = np.minimum(step, bound[act])
        ok = holds(act, d)
        lo[act[ok]] = d[ok]
        hi[act[~ok]] = d[~ok]
        act = act[ok & (d < bound[act])]
        step *= 2
    act = np.nonzero(hi - lo > 1)[0]
    while len(act):
        d = (lo[act] + hi[act]) // 2
        ok = holds(act, d)
        lo[act[ok]] = d[ok]
        hi[act[~ok]] = d[~ok]
        act = act[hi[act] - lo[act] > 1]
    return lo


class Texts:
    """Segments end to end; a context is the place i after it and its length."""

    def __init__(self, t: np.ndarray):
        self.t = t
        self.total, self.down = sums(t)

    def hash(self, i: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.total[i] - self.total[i - length]) * self.down[i - length]

    def common(self, i: np.ndarray, j: np.ndarray, bound: np.ndarray, least: int | np.ndarray) -> np.ndarray:
        """How many tokens the contexts before i and j share, at least least and at most bound."""
        least = np.broadcast_to(least, i.shape)
        return least + _farthest(lambda r, d: self.hash(i[r], least[r] + d) == self.hash(j[r], least[r] + d), bound - least)

    def order(self, i: np.ndarray, left: np.ndarray, group: np.ndarray, share: int) -> np.ndarray:
        """Distinct contexts in the order of their tokens backwards, by ascending group; those of a group share that many tokens.

        Each round takes one of a group: the others come before or after it by the token where they part, nearer the more they share,
        and those that part from it alike at one place are a group of the next round.
        """
        order = np.argsort(group, kind="stable")
        g = group[order]
        new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        start = np.nonzero(new)[0]
        size = np.diff(start, append=len(g))
        known = np.full(len(start), share)
        while True:
            keep = size > 1
            start, size, known = start[keep], size[keep], known[keep]
            if not len(start):
                return order
            at = spans(start, size)
            of = np.repeat(np.arange(len(start)), size)
            me, pivot = order[at], order[start + size // 2][of]
            n = self.common(i[me], i[pivot], np.minimum(left[me], left[pivot]), known[of])
            own = me == pivot
            x, y = self.t[np.maximum(i[me] - n - 1, 0)], self.t[np.maximum(i[pivot] - n - 1, 0)]
            top = int(left.max()) + 1
            side = np.where(own, top, np.where(x < y, n, 2 * top - n)).astype(np.int64)
            sort = np.lexsort((side, of))
            order[at] = me[sort]
            key = of[sort] * (2 * top + 1) + side[sort]
            cut = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            start, size, known = at[cut], np.diff(cut, append=len(key)), n[sort][cut]


class Index:
    """A suffix array of distinct contexts that share at least w tokens with others, and the weights of the tokens that follow them."""

    def __init__(self, texts: Texts, i: np.ndarray, left: np.ndarray, word: np.ndarray, weight: np.ndarray, w: int):
        self.texts, self.w = texts, w
        whole, first, self.inverse = np.unique(texts.hash(i, left), return_index=True, return_inverse=True)
        i, left = i[first], left[first]
        order = texts.order(i, left, texts.hash(i, np.full(len(i), w)), w)
        self.i, self.left, self.whole = i[order], left[order], whole
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place = place[self.inverse]
        h = texts.hash(self.i, np.full(len(order), w))
        starts = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else np.zeros(0, np.int64)
        by = np.argsort(h[starts])
        self.keys, self.lo, self.hi = h[starts][by], starts[by], np.append(starts[1:], len(h))[by]
        self.upto = np.concatenate([[0], np.cumsum(np.bincount(place, weight, len(order)).astype(np.int64))])
        # pairs of the following token and the place in the order, for the weight of a token after a range of contexts
        by = np.lexsort((place, word))
        self.pairs = word[by].astype(np.uint64) << _U(32) | place[by].astype(np.uint64)
        self.pair_upto = np.concatenate([[0], np.cumsum(weight[by])])

    def longest(self, i: np.ndarray, left: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per asked context: the longest that the index has, its weight, and the weight with that word after it.

        Binary search in the range of the last w tokens for the context's place, then for the ends of the range that shares the length.
        """
        x, n = self.texts, len(i)
        best, context, pair = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n or not len(self.keys):
            return best, context, pair
        h = x.hash(i, np.full(n, self.w))
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        row = np.nonzero(self.keys[k] == h)[0]
        first, last = self.lo[k[row]], self.hi[k[row]]
        p, bound = i[row], left[row]
        lo, hi, act = first.copy(), last.copy(), np.arange(len(row))
        near, top = first.copy(), np.zeros(len(row), np.int64)
        while len(act):
            mid = (lo[act] + hi[act]) // 2
            j, q = self.i[mid], p[act]
            m = x.common(q, j, np.minimum(bound[act], self.left[mid]), self.w)
            more = m > top[act]
            top[act[more]], near[act[more]] = m[more], mid[more]
            q_ends, c_ends = m == bound[act], m == self.left[mid]
            right = ~q_ends & (c_ends | (x.t[np.maximum(j - m - 1, 0)] < x.t[np.maximum(q - m - 1, 0)]))
            lo[act[right]] = mid[right] + 1
            hi[act[~right]] = mid[~right]
            act = act[lo[act] < hi[act]]
        want = x.hash(p, top)

        def fits(r: np.ndarray, at: np.ndarray) -> np.ndarray:
            same = self.left[at] >= top[r]
            return same & (x.hash(self.i[at], np.where(same, top[r], 0)) == want[r])

        a = near - _farthest(lambda r, d: fits(r, near[r] - d), near - first)
        z = near + _farthest(lambda r, d: fits(r, near[r] + d), last - 1 - near) + 1
        v = word[row].astype(np.uint64) << _U(32)
        best[row], context[row] = top, self.upto[z] - self.upto[a]
        pair[row] = self.pair_upto[np.searchsorted(self.pairs, v | z.astype(np.uint64))] - self.pair_upto[np.searchsorted(self.pairs, v | a.astype(np.uint64))]
        return best, context, pair


def _look_up(w: int, k: int):
    """A shard of windows: an index of its training contexts, and what it has for the asked ones."""

    def run(shard: pa.Table) -> pa.Table:
        chunks, blocks, out = [], [], []
        for c, b in zip(shard.column("chunk").to_pylist(), shard.column("block").to_pylist(), strict=True):
            if b[:1] == b"=":
                out.append(_batch(FOUND, kind=[4], chunk=[c], block=[b[1:]]))
            else:
                chunks.append(c)
                blocks.append(_unpack(b[1:]))
        if not blocks:
            return _table(FOUND, out)
        own = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(b[0]) for b in blocks])
        a, c, n, held, weight = (np.concatenate([b[x].astype(np.int64) for b in blocks]) for x in range(5))
        x = Texts(np.concatenate([b[5] for b in blocks]))
        del blocks
        start = np.cumsum(c + n) - n
        # every place of every segment
        step = spans(np.zeros(len(n), np.int64), n)
        own, at, i, held, weight = np.repeat(own, n), np.repeat(a, n) + step, np.repeat(start, n) + step, np.repeat(held, n).astype(bool), np.repeat(weight, n)
        left = np.minimum(np.repeat(c, n) + step, k)
        word = x.t[i]
        t = np.nonzero(~held)[0]
        q = np.nonzero(held)[0]
        index = Index(x, i[t], left[t], word[t], weight[t], w)
        best, context, pair = index.longest(i[q], left[q], word[q])
        # a context that reaches the document's start goes no further
        on = (best == k) & (x.t[np.maximum(i[q] - k, 0)] > 0)
        full = np.unique(x.hash(i[q[on]], np.full(int(on.sum()), k)))
        goes = np.isin(index.whole, full)[index.inverse] & (left[t] == k)
        done = q[~on]
        out += _by_chunk(0, chunks, own[done], at[done], best[~on], context[~on], pair[~on])
        hit = np.concatenate([q[on], t[goes]])
        out += _by_chunk(1, chunks, own[hit], at[hit])
        return _table(FOUND, out)

    return run


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _score(total: int, kinds: int, documents: int, parts: int):
    """Each document's scores, from what was found of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, row in _rows(batches):
            ranks, seen = _unpack(row["counts"])
            c = seen.astype(np.int64)[np.searchsorted(np.cumsum(ranks, dtype=np.int64), x.s[x.left > 0])]
            shared = _shared(x, row, parts)
            length, context, pair = (np.zeros(len(x.s), np.int64) for _ in range(3))
            steps: dict[int, tuple[list, list]] = {}
            for r in row["found"] or ():
                steps.setdefault(r["step"], ([], []))[r["kind"] == 4].append(_unpack(r["block"]))
            for step in sorted(steps):
                for at, *values in steps[step][0]:
                    at = np.cumsum(at, dtype=np.int64)
                    for into, v in zip((length, context, pair), values, strict=True):
                        into[at] = v
                for here, there, n in steps[step][1]:
                    i, j = (spans(p.astype(np.int64), n.astype(np.int64)) for p in (here, there))
                    for into in (length, context, pair):
                        into[i] = into[j]
            for r in row["waited"] or ():
                length[r["at"]], context[r["at"]], pair[r["at"]] = r["length"], r["context"], r["pair"]
            # whole histories: the start of a document is the context of its first token
            before = np.concatenate([[0], shared[:-1]])
            before[x.first + 1] = documents
            at = np.nonzero((x.left > 0) & (before > 0))[0]
            length[at], context[at], pair[at] = x.left[at], before[at], shared[at]
            real = x.left > 0
            p = _unigram(c, total, kinds)
            value = log_p(pair[real], context[real], length[real], p)
            starts = x.ends - x.sizes
            known, base, score = (np.add.reduceat(v, starts) for v in ((c > 0).astype(np.int64), np.log10(p), value))
            ids = [None if n else int(i) for i, n in zip(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool), strict=True)]
            yield _batch(OUT, doc_id=ids, held_out=x.held, n_tokens=x.sizes, n_known=known, base=base, score=score)

    return run


def _listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """A row a chunk (k) with the rows of df as a list of structs."""
    return df.groupBy(F.col("chunk").alias("k")).agg(F.collect_list(F.struct(*columns)).alias(name))


def _with(chunks: DataFrame, *lists: DataFrame) -> DataFrame:
    for x in lists:
        chunks = chunks.join(x.hint("merge"), F.col("chunk") == F.col("k"), "left").drop("k")
    return chunks


def score_documents(docs: DataFrame, fold: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text; null and empty texts are just their end.

    Repeated rows are documents of their own; a null id counts as the empty text for the fold.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    text_batches(spark)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id"), fold) == held_out).alias("held"), "text")
    chunks_path = write_staged(named.mapInArrow(_chunks, CHUNK), "chunks")
    chunks = read_staged(spark, chunks_path)
    r = chunks.agg(F.sum("n").alias("n"), F.sum("train").alias("train"), F.count(F.lit(1)).alias("chunks")).first()
    if not r.n:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    documents = r.train
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-r.n // RANGE_TOKENS))
    # counts and ranks of all words: a chunk's words are exchanged once each, in blocks, not a row per token
    of_parts = chunks.select("chunk", "words", "counts").mapInArrow(_words(shards), "part int, chunk long, block binary")
    ranks_path = write_staged(of_parts.groupBy("part").applyInArrow(_rank(shards), RANKS), "ranks")
    ranks = read_staged(spark, ranks_path)
    s = ranks.where("chunk is null").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.max("asked").alias("asked")).first()
    total, kinds = s.n, s.v
    # no document to score has a word of a higher rank
    last = s.asked * shards
    blocks = ranks.where("chunk is not null").groupBy(F.col("chunk").alias("k")).agg(F.collect_list("block").alias("blocks"))
    full_path = write_staged(chunks.drop("words", "counts", "n", "train").join(blocks.hint("merge"), F.col("chunk") == F.col("k")).drop("k").mapInArrow(_ranked, FULL), "ranked")
    full = read_staged(spark, full_path)
    thin = full.drop("ids", "nulls", "counts")
    remove(spark, chunks_path)
    remove(spark, ranks_path)
    release(spark)
    # whole histories
    ladder_keys, hot_rows = _scout(shards, max(2, RANGE_TOKENS // 4 // max(1, r.chunks)))
    ladder = staged(thin.mapInArrow(ladder_keys, TALLY).groupBy("part").applyInArrow(_tally, TALLY), "ladder")
    with_ladder = _with(thin, _listed(ladder, "ladder", "part", "block"))
    histories = staged(with_ladder.mapInArrow(_ask_histories(shards), TALLY).groupBy("part").applyInArrow(_tally, TALLY), "histories")
    told = (_listed(ladder, "ladder", "part", "block"), _listed(histories, "histories", "part", "block"))
    release(spark)
    # contexts that are too frequent for a shard: at most a few for each RANGE_TOKENS tokens, by counts that miss at most half
    often = thin.mapInArrow(hot_rows, "level int, gram long, n long").groupBy("level", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= RANGE_TOKENS // 2).collect()
    hot = [np.array(sorted(o.gram for o in often if o.level == k), np.int64).view(np.uint64) for k in range(1, DEPTH)]
    moved = _with(thin, *told).mapInArrow(_positions(hot, shards, shards, last), MOVED)
    found = [staged(moved.groupBy("shard").applyInArrow(_settle(hot), FOUND), "found")]
    release(spark)
    # frequent contexts: counts of context and token summed over the shards
    pairs = found[0].where("kind = 3").groupBy("gram", "word").agg(F.sum("n").alias("pair"))
    contexts = pairs.groupBy("gram").agg(F.sum("pair").alias("context"))
    wait = found[0].where("kind = 2").select("chunk", "gram", "word", "n").join(pairs, ["gram", "word"], "left").join(contexts, "gram")
    wait = wait.select("chunk", F.expr(f"n div {DEPTH}").alias("at"), (F.col("n") % DEPTH).alias("length"), "context", F.coalesce("pair", F.lit(0)).alias("pair"))
    waited = _listed(wait, "waited", "at", "length", "context", "pair")
    # windows, until no context goes on
    w, k, same = DEPTH, 4 * DEPTH, None
    while True:
        on = found[-1].where("kind = 1")
        n = on.agg(F.sum(F.length("block"))).first()[0] or 0
        if not n:
            break
        lists = thin.join(_listed(on, "on", "block").hint("merge"), F.col("chunk") == F.col("k")).drop("k")
        lists = _with(lists, _listed(same, "same", "block")) if same is not None else lists.withColumn("same", F.lit(None).cast("array<struct<block:binary>>"))
        parts = _parts(n, w, k, shards)
        moved = lists.mapInArrow(_windows(w, k, parts, shards + 4 * len(hot[0])), MOVED)
        found.append(staged(moved.groupBy("shard").applyInArrow(_look_up(w, k), FOUND), "found"))
        release(spark)
        same = found[-1].where("kind = 4")
        w, k = k, GROWTH * k
    every = None
    for step, f in enumerate(found):
        f = f.where("kind in (0, 4)").select("chunk", F.lit(step).alias("step"), "kind", "block")
        every = f if every is None else every.unionByName(f)
    rows = _with(full, *told, _listed(every, "found", "step", "kind", "block"), waited).mapInArrow(_score(total, kinds, documents, shards), OUT)
    rows = staged(rows, "scores")
    remove(spark, full_path)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def _parts(block_bytes: int, w: int, k: int, least: int) -> int:
    """Shards for windows: a flagged place takes about a byte of its blocks, and a share of k tokens in its segment of about w / 2 places."""
    tokens = block_bytes * (1 + k / max(1.0, (w + 1) / 2))
    return max(1, min(least, int(block_bytes // 20_000) + 1), int(tokens // SHARD_TOKENS))
