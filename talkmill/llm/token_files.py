"""Token ids in ORC: run-length encoded integers in stripes, row indexes and Bloom filters on the document id.

Documents are range-partitioned by id, sorted, encoded and written, so the files and their rows ascend by id; `row` numbers the rows
of a file. Readers may split a file by stripe and skip stripes and row groups by the id's statistics and Bloom filter.

Byte-level BPE encodes the pieces of a text that its split pattern yields independently of each other. The texts of a batch are cut
into pieces by the kinds of their bytes, equal pieces are found by a dictionary encoding, and only pieces that a worker hasn't met are
given to the tokenizers library. Texts with characters whose kind might be told otherwise by the library, or with the content of an
added token, are given to it whole.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.llm.common import need, new_path, staged, text_batches, trim

END_ID = 2
#: Bytes of text of a file, on average.
PART_BYTES = 24 << 20
#: Bytes of text that are cut into pieces at once.
BLOCK_BYTES = 3 << 20
#: Pieces that a worker remembers; then it starts anew.
MEMO_PIECES = 700_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Kinds of characters: letters, digits, the space, other white space, others; characters of no known kind are UNKNOWN.
LETTER, DIGIT, SPACE, WHITE, OTHER, UNKNOWN = range(1, 7)
_KEPT: dict[str, Encoder] = {}
#: Byte -> character of byte-level vocabularies: printable bytes stand for themselves, the others for characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


def _kinds() -> np.ndarray:
    """Of the code points below 0x2100 on which all versions of Unicode agree: ASCII without odd controls, Latin letters, some punctuation."""
    out = np.full(0x2100, UNKNOWN, np.uint8)
    for a, z in ((0x20, 0x7E), (0xA1, 0xA9), (0xAB, 0xAC), (0xAE, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)):
        out[a : z + 1] = OTHER
    for a, z in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)):
        out[a : z + 1] = LETTER
    out[0x30:0x3A], out[0x20], out[0x09:0x0E] = DIGIT, SPACE, WHITE
    return out


_KINDS = _kinds()
_ASCII = np.concatenate([_KINDS[:128], np.full(128, UNKNOWN, np.uint8)])


def kinds_of(raw: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8; all bytes of a character have its kind."""
    out = _ASCII[raw]
    lead = np.nonzero(raw >= 0xC0)[0]
    if len(lead):
        b = raw[lead].astype(np.int32)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        at = lambda k: raw[np.minimum(lead + k, len(raw) - 1)].astype(np.int32) & 0x3F
        point = np.where(size == 2, (b & 0x1F) << 6 | at(1), np.where(size == 3, (b & 0x0F) << 12 | at(1) << 6 | at(2), 0x2100))
        kind = np.where(point < 0x2100, _KINDS[np.minimum(point, 0x20FF)], UNKNOWN).astype(np.uint8)
        for k in range(3):
            more = size > k + 1
            out[lead[more] + k + 1] = kind[more]
        out[lead] = kind
    return out


def cuts(raw: np.ndarray, kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of PATTERN begin in texts end to end; starts: those of the texts, in ascending order."""
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[starts] = True
    kind = np.where(kinds == SPACE, WHITE, kinds)
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | first[1:n]
    # of white space before something else the last character is apart; a space then goes along with what follows
    white = np.nonzero(kind == WHITE)[0]
    ends = white[(white + 1 < n) & ~first[white + 1]]
    ends = ends[kind[ends + 1] != WHITE]
    new[ends] = True
    new[ends[kinds[ends] == SPACE] + 1] = False
    # an apostrophe at the start of a piece and the letters of a contraction
    for i in np.nonzero((raw == 39) & new)[0].tolist():
        for word in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
            z = i + 1 + len(word)
            if raw[i + 1 : z].tobytes() == word and not first[i + 1 : z].any():
                new[i + 1] = False
                if z < n:
                    new[z] = True
                    # what comes next is a piece of its own kind; a space there goes along with what follows it, which stands as it was
                break
    return np.nonzero(new)[0]


class Encoder:
    """Ids of texts as little-endian 32-bit integers, with the end id, by the tokenizer of a file."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        pre = self.library.pre_tokenizer
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # the memo is the cache
        # only a byte-level pre-tokenizer with the standard pattern, no prefix space and no normalizer splits as PATTERN does
        self.by_piece = self.library.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and getattr(pre, "use_regex", True)
        self._clear()

    def _clear(self) -> None:
        #: 128-bit hashes of the pieces known, sorted by their first half, and their places; where each place's ids begin and end.
        self.high, self.low, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.ends = array("I"), array("q", [0])

    @staticmethod
    def of(file: str) -> Encoder:
        if file not in _KEPT:
            _KEPT[file] = Encoder(file)
        return _KEPT[file]

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), ">u8").reshape(-1, 2).astype(np.uint64)
        high, low = hashes[:, 0], hashes[:, 1]
        out = np.empty(len(pieces), np.int64)
        hit = np.zeros(len(pieces), bool)
        if len(self.high):
            k = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
            hit = (self.high[k] == high) & (self.low[k] == low)
            out[hit] = self.place[k[hit]]
        new = np.nonzero(~hit)[0]
        if len(new):
            tokenize, first = self.library.model.tokenize, len(self.ends) - 1
            for k in new.tolist():
                # the model alone takes bytes as the characters of _BYTES: a piece needs no further splitting
                self.flat.extend([t.id for t in tokenize(pieces[k].decode("latin-1").translate(_BYTES))])
                self.ends.append(len(self.flat))
            out[new] = np.arange(first, first + len(new))
            new = new[np.argsort(high[new])]
            at = np.searchsorted(self.high, high[new])
            self.high, self.low, self.place = np.insert(self.high, at, high[new]), np.insert(self.low, at, low[new]), np.insert(self.place, at, out[new].astype(np.int32))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each with its end id; where each text's ids end). Null texts are empty."""
        texts = texts.take(pa.array(np.arange(len(texts)))).fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[: off[-1]] if data is not None else np.zeros(0, np.uint8)
        kinds = kinds_of(raw)
        size = np.diff(off)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        whole = np.zeros(len(texts), bool)
        whole[owner[np.nonzero(kinds == UNKNOWN)[0]]] = True
        if not self.by_piece:
            whole[:] = True
        view = raw.tobytes()
        for a in self.added:
            at = view.find(a)
            while at >= 0:
                # also where it begins in one text and ends in the next: that costs time only
                whole[owner[at]] = True
                at = view.find(a, at + 1)
        if len(self.high) > MEMO_PIECES:
            self._clear()
        ids = np.zeros(0, np.uint32)
        count = np.ones(len(texts), np.int64)
        plain = np.nonzero(~whole & (size > 0))[0]
        parts: list[np.ndarray] = []
        if len(plain):
            begin = cuts(raw, kinds, off[:-1][size > 0])
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(raw)).astype(np.int64)), data]).filter(pa.array(~whole[owner[begin]])).dictionary_encode()
            at = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            ends = np.frombuffer(self.ends, np.int64)
            first, n = ends[at], ends[at + 1] - ends[at]
            of = owner[begin[~whole[owner[begin]]]]
            count += np.bincount(of, n, len(texts)).astype(np.int64)
            upto = np.cumsum(n)
            ids = np.frombuffer(self.flat, np.uint32)[np.arange(upto[-1]) + np.repeat(first - upto + n, n)]
            del ends
        others = np.nonzero(whole)[0]
        got = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([texts[int(k)].as_py() for k in others], add_special_tokens=False)] if len(others) else []
        count[others] += np.array([len(g) for g in got], np.int64)
        stop = np.cumsum(count)
        out = np.empty(stop[-1] if len(stop) else 0, np.uint32)
        inner = np.ones(len(out), bool)
        inner[stop - 1] = False
        for k, g in zip(others, got, strict=True):
            out[stop[k] - count[k] : stop[k] - 1] = g
            inner[stop[k] - count[k] : stop[k] - 1] = False
        out[stop - 1] = END_ID
        out[inner] = ids
        return out, stop


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of about BLOCK_BYTES of text, or one longer text: the larger a block, the oftener it has a piece again."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < whole.num_rows:
            before = int(upto[at - 1]) if at else 0
            n = max(1, int(np.searchsorted(upto, before + BLOCK_BYTES - size, "right")) - at) if size < BLOCK_BYTES else 0
            if n:
                held.append(whole.slice(at, n))
                at += n
                size += int(upto[at - 1]) - before
            if size >= BLOCK_BYTES or at < whole.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _encode(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, row = Encoder.of(file), 0
        for b in _blocks(batches):
            flat, ends = encoder.encode(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.arange(row, row + b.num_rows)), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.view(np.int32)))], names=["doc_id", "row", "ids"]
            )
            row += b.num_rows
        trim()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str) -> None:
    """Writes doc_id, row, ids of whole texts (null: empty, so just the end id) in ascending id order, null ids first.

    Rows of one id follow each other in the order of their text's hash; even a single id's rows may spread over several files.
    """
    need(docs, "doc_id", "text")
    text_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    # files follow the bytes, whatever the session's number of partitions
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    in_order = keyed.repartitionByRange(-(-size // PART_BYTES) or 1, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    rows = in_order.mapInArrow(_encode(tokenizer_file), "doc_id long, row long, ids array<int>")
    rows.write.option("compression", "zstd").option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, row, ids and the file's name; filters on doc_id are pushed to the stripes."""
    return spark.read.schema("doc_id long, row long, ids array<int>").orc(path).select("doc_id", "row", "ids", F.col("_metadata.file_name").alias("file"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(2)
        ends = lists.offsets.to_numpy()
        flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        crc = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        n = pc.subtract(lists.offsets[1:], lists.offsets[:-1]).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), n, pa.array(crc, pa.int64())], names=["doc_id", "row", "file", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files, read once: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Files ascend by the number in their name as their ids do."""
    rows = read_tokens(spark, path).select("doc_id", "row", "ids", "file").mapInArrow(_digest, "doc_id long, row long, file string, n_tokens long, ids_crc32 long")
    rows = staged(rows, "digest")
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    # a row per file: the only window over a whole table
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("upto", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files.select(F.col("file").alias("f"), "before"), F.col("file") == F.col("f")).select("doc_id", (F.col("before") + F.col("upto")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Writes the ORC files to the shared folder and returns the digest of what is read back from them."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file)
    return token_digest(docs.sparkSession, path)
