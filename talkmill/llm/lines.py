"""Line dedup by a segment-partition edit join.

Lines (between \\n, ASCII white space at their ends dropped, blank ones left out) that are equal are a class from the start. Two classes
link if their edit distance is at most TAU, however short they are. The shorter line of a linked pair, cut into TAU + 1
segments, has a segment that occurs in the longer one near its own place, so its segments are the index and the longer line probes it
with the few substrings that the multi-match-aware bounds leave for each length; a line of up to TAU characters has an empty segment, which all
lines of fit length share. Keys are hashes of (length, segment, substring),
matched by an equi-join that adaptive execution splits where a segment is common. An exact filter goes along with every key: one edit
flips at most four bits of the parity of a line's hashed bigrams, so of the lines that share a segment only those within 4 TAU bits
come out. These are verified by banded bit-parallel edit distance over the lines' texts, for many pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import components, fresh, need, release, staged, text_batches

#: Only blank lines are too short to link.
TAU, MIN_CHARS = 2, 1
_SPACE = " \t\n\x0b\x0c\r"
_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)


def lines_of(text: str) -> list[str]:
    """The lines of a text without white space at their ends; blank ones are ''."""
    return [x.strip(_SPACE) for x in text.split("\n")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(length difference, segment from 0, shift of the substring's start) that find every pair within tau edits."""
    out = []
    for d in range(tau + 1):
        for i in range(1, tau + 2):
            for o in range(max(1 - i, d - (tau + 1 - i)), min(i - 1, d + tau + 1 - i) + 1):
                out.append((d, i - 1, o))
    return out


def signatures(lines: list[str], tau: int = TAU) -> tuple[np.ndarray, np.ndarray, list[tuple[bool, np.ndarray, np.ndarray]]]:
    """Of lines of at least MIN_CHARS: ids, bigram parities, and (is it an index key, indices of lines, keys)."""
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    end = np.cumsum(length)
    start = end - length
    up, down = _powers(_B, len(code) + 1), _powers(_INV, len(code) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up[:-1])])

    def piece(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return (total[z] - total[a]) * down[a]

    ids = _mix(piece(start, end) ^ _mix(length.astype(np.uint64)))
    bit = np.uint64(1) << (_mix(code[:-1] * np.uint64(0x100000001B3) + code[1:]) >> np.uint64(58))
    bit = np.concatenate([bit, np.zeros(1, np.uint64)])
    bit[end - 1] = 0
    parity = np.bitwise_xor.reduceat(bit, start)

    def segment(n: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        base, more = n // (tau + 1), n % (tau + 1)
        short = tau + 1 - more  # the first ones have base characters, the others one more
        return i * base + np.maximum(0, i - short), base + (i >= short)

    out = []
    for d, i, o in [(-1, i, 0) for i in range(tau + 1)] + probes(tau):
        n = length - max(d, 0)
        at, size = segment(n, i)
        at = at + o
        ok = np.nonzero((n >= MIN_CHARS) & (at >= 0) & (at + size <= length))[0]
        a = start[ok] + at[ok]
        key = _mix(piece(a, a + size[ok]) + _mix((n[ok] * (tau + 1) + i).astype(np.uint64)))
        out.append((d < 0, ok, key))
    return ids, parity, out


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: an index key, 1: a probe; n: characters of the line. A line that a task meets again isn't sent again, as far as it remembers."""
    known: set[str] = set()
    held = 0
    for b in batches:
        fresh: list[str] = []
        for t in b.column(0).to_pylist():
            for x in dict.fromkeys(lines_of(t)) if t else ():
                if len(x) >= MIN_CHARS and x not in known:
                    known.add(x)
                    fresh.append(x)
        held += sum(map(len, fresh))
        if held > 8_000_000:
            known.clear()
            held = 0
        if not fresh:
            continue
        ids, parity, keys = signatures(fresh)
        for index, ok, key in keys:
            kind = pa.array(np.full(len(ok), 0 if index else 1, np.int8))
            yield pa.RecordBatch.from_arrays([kind, pa.array(key.view(np.int64)), pa.array(ids[ok].view(np.int64)), pa.array(parity[ok].view(np.int64))], names=["kind", "key", "id", "parity"])


def _ids(lines: list[str]) -> np.ndarray:
    """Ids of any lines, '' included; the same as signatures' for those it takes."""
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    end = np.cumsum(length)
    start = end - length
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * _powers(_B, len(code)))])
    down = _powers(_INV, len(code) + 1)
    return _mix(((total[end] - total[start]) * down[start]) ^ _mix(length.astype(np.uint64))).view(np.int64)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, pos, lines = [], [], []
        for k, t in enumerate(b.column(2).to_pylist()):
            # a document without lines has the place -1
            got = [(i, x) for i, x in enumerate(lines_of(t)) if x] if t else []
            for i, x in got or [(-1, "")]:
                row.append(k)
                pos.append(i)
                lines.append(x)
        if row:
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32()), pa.array(_ids(lines))], names=["row", "doc_id", "pos", "id"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = list(dict.fromkeys(x for t in b.column(0).to_pylist() if t for x in lines_of(t) if len(x) >= MIN_CHARS))
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(_ids(lines)), pa.array(lines, pa.string())], names=["id", "line"])


def within(a: list[str], b: list[str], tau: int = TAU) -> np.ndarray:
    """Whether each pair's edit distance is at most tau: Myers' bit vectors over the 2 tau + 1 diagonals about the main one, all pairs in step."""
    n = len(a)
    if not n:
        return np.zeros(0, bool)
    la, lb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    swap = la > lb
    s = [y if w else x for x, y, w in zip(a, b, swap, strict=True)]  # the shorter
    t = [x if w else y for x, y, w in zip(a, b, swap, strict=True)]
    ls, lt = np.minimum(la, lb), np.maximum(la, lb)
    wide = int(lt.max()) + 2 * tau + 2
    p, q = np.zeros((n, wide + 2 * tau), np.uint32), np.full((n, wide), 1 << 30, np.uint32)
    for k in range(n):  # the pattern has tau cells in front, so that cell j + b is its character j - tau + b
        p[k, tau : tau + lt[k]] = np.frombuffer(t[k].encode("utf-32-le", "surrogatepass"), np.uint32)
        q[k, : ls[k]] = np.frombuffer(s[k].encode("utf-32-le", "surrogatepass"), np.uint32)
    p[:, :tau] = (1 << 30) + 1
    for k in range(n):
        p[k, tau + lt[k] :] = (1 << 30) + 2
    one, top = np.uint64(1), np.uint64(2 * tau)
    # bit c is the row j + c - tau of column j: at column 0 the rows above the first don't exist
    full = np.uint64((1 << (2 * tau + 1)) - 1)
    vp = np.full(n, ((1 << (tau + 1)) - 1) << tau, np.uint64)
    vn = np.zeros(n, np.uint64)
    score = np.full(n, tau, np.int64)  # of the band's lowest cell
    done = np.full(n, 1 << 20, np.int64)
    for j in range(int(ls.max()) if n else 0):
        x = np.zeros(n, np.uint64)
        for c in range(2 * tau + 1):
            x |= (p[:, j + c] == q[:, j]).astype(np.uint64) << np.uint64(c)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        score += ((d0 >> top) & one) == 0
        last = ls == j + 1
        if last.any():
            # from the lowest cell up to the row of the whole pattern, along the column, whose vertical deltas are of the unshifted rows
            v_hp, v_hn = hp, hn
            nvp, nvn = (v_hn | ~((d0 >> one) | v_hp)) & full, (d0 >> one) & v_hp & full
            r = score.copy()
            lowest = j + 1 + tau
            for up in range(2 * tau):
                go = lowest - up > lt
                # bit 2 tau - 1 - up of the shifted vectors is the delta between the rows lowest - up and the one above
                sh = np.uint64(2 * tau - 1 - up)
                r = np.where(go, r - ((nvp >> sh) & one).astype(np.int64) + ((nvn >> sh) & one).astype(np.int64), r)
            done = np.where(last, r, done)
        vp, vn = (hn | ~((d0 >> one) | hp)) & full, (d0 >> one) & hp
    empty = ls == 0
    done[empty] = lt[empty]
    return (done <= tau) & (lt - ls <= tau)


def links(docs: DataFrame) -> DataFrame:
    """(a, b): ids of the different lines within TAU edits of each other, each pair once."""
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select("text").where("text is not null")
    keys = texts.mapInArrow(_emit, "kind byte, key long, id long, parity long")
    left = keys.where("kind = 0").select("key", F.col("id").alias("a"), F.col("parity").alias("p"))
    right = keys.where("kind = 1").select(F.col("key").alias("k"), F.col("id").alias("b"), F.col("parity").alias("q"))
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= 4 * TAU
    met = left.join(right, (F.col("key") == F.col("k")) & (F.col("a") != F.col("b")) & near)
    pairs = staged(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    release(spark)
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()
    lines = texts.mapInArrow(_texts, "id long, line string").join(wanted.hint("merge"), F.col("id") == F.col("w"), "left_semi").groupBy("id").agg(F.first("line").alias("line"))
    lines = staged(lines, "lines")
    release(spark)
    both = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = x.tolist(), y.tolist()
        out = np.zeros(len(a), bool)
        order = sorted(range(len(a)), key=lambda k: max(len(a[k]), len(b[k])))
        k = 0
        while k < len(order):  # pairs of like length together, as many as fit a few million cells
            step = max(1, min(len(order) - k, 2_000_000 // (len(a[order[k]]) + 64)))
            part = order[k : k + step]
            out[part] = within([a[i] for i in part], [b[i] for i in part])
            k += step
        return pd.Series(out)

    return both.where(close("x", "y")).select("a", "b")


def repeated_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences of lines with row, doc_id, pos, id, repeated; links). An occurrence is repeated if an equal or linked line, or one
    that is linked to it over others, comes before it in the order of (doc_id, row, pos), null ids first."""
    need(docs, "doc_id", "text")
    text_batches(docs.sparkSession)
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = staged(named.mapInArrow(_occurrences, "row long, doc_id long, pos int, id long"), "places")
    linked = staged(links(docs), "linked")
    roots = staged(components(linked), "roots")
    rooted = places.join(roots, F.col("id") == F.col("node"), "left").select("row", "doc_id", "pos", "id", F.coalesce("root", "id").alias("class"))
    here = F.struct("doc_id", "row", "pos")
    first = rooted.where("pos >= 0").groupBy(F.col("class").alias("c")).agg(F.min(here).alias("first"))
    out = rooted.join(first, F.col("class") == F.col("c"), "left")
    return out.select("row", "doc_id", "pos", "id", ((F.col("pos") >= 0) & (here != F.col("first"))).alias("repeated")), linked


def dedup_lines(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_lines (not blank), n_repeated (lines with an equal or near line before them), n_linked (lines
    near to a different one) and n_links (different lines that these are near to). Null and empty texts have no lines."""
    places, linked = repeated_lines(docs)
    degree = linked.select(F.col("a").alias("l")).unionAll(linked.select("b")).groupBy("l").agg(F.count(F.lit(1)).alias("d"))
    rows = places.join(degree, F.col("id") == F.col("l"), "left").groupBy("row", "doc_id")
    is_line = F.col("pos") >= 0
    return rows.agg(
        F.count_if(is_line).alias("n_lines"),
        F.count_if("repeated").alias("n_repeated"),
        F.count_if(is_line & F.col("d").isNotNull()).alias("n_linked"),
        F.coalesce(F.sum(F.when(is_line, F.col("d"))), F.lit(0)).cast("long").alias("n_links"),
    ).drop("row")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines cut from the texts. Rows of one id are treated alike: a place is cut if it is repeated in all of them."""
    places, _ = repeated_lines(docs)
    cut = places.where("pos >= 0").groupBy("doc_id", "pos").agg(F.min("repeated").alias("r")).where("r").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("pos").alias("__cut"))
    key, at = fresh(docs, "__id"), fresh(docs, "__cut")
    cut = staged(cut, "cut").select(F.col("__id").alias(key), F.col("__cut").alias(at))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.coalesce(at, F.array().cast("array<int>")), i)), "\n")
    return docs.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left").withColumn("text", F.when(F.col(at).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
