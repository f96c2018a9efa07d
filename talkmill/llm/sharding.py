"""Histogram sort: shards of near-equal bytes by exact splitters over a total order of the rows.

The order is (hash of the text, id, ordinal in the staged key table). Equal texts are neighbours, so a group of copies stays in
one shard unless a splitter has to fall inside it to meet the tolerance. Each pass counts exact bytes and rows between candidate
boundaries in every partition (a partial count per partition, summed by key) and refines only the brackets whose best boundary is
still off. The rows are exchanged once, by sub-ranges far smaller than a shard, so no task ever holds a whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import fresh, need, read_staged, write_staged
from talkmill.session import ship

TOP = 1 << 192
#: Rows that one task of the exchange sorts, about; the boundaries in hand are the shards' and one for so many rows.
RANGE_ROWS = 500_000


def _keys(h: np.ndarray, i: np.ndarray, o: np.ndarray) -> np.ndarray:
    """24-byte keys whose byte order is the order of the three signed numbers."""
    flip = np.uint64(1 << 63)
    cols = [(x.astype(np.int64).view(np.uint64) ^ flip).astype(">u8") for x in (h, i, o)]
    return np.ascontiguousarray(np.column_stack(cols)).view("S24").ravel()


def _bytes(k: int) -> bytes:
    return k.to_bytes(24, "big")


def _array(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_bytes, keys)), dtype="S24")


def _counter(probes: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _array(probes)
        n = len(at) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least: dict[int, bytes] = {}
        most: dict[int, bytes] = {}
        for b in batches:
            if not b.num_rows:
                continue
            k = _keys(*(b.column(c).to_numpy(zero_copy_only=False) for c in range(3)))
            s = b.column(3).to_numpy(zero_copy_only=False)
            order = np.argsort(k, kind="stable")
            k, s = k[order], s[order]
            cuts = np.concatenate([[0], np.searchsorted(k, at, side="left"), [len(k)]])
            for t in np.nonzero(np.diff(cuts))[0]:
                a, z = cuts[t], cuts[t + 1]
                size[t] += s[a:z].sum()
                rows[t] += z - a
                lo, hi = k[a].ljust(24, b"\0"), k[z - 1].ljust(24, b"\0")
                least[t] = min(lo, least.get(t, lo))
                most[t] = max(hi, most.get(t, hi))
        got = sorted(least)
        yield pa.RecordBatch.from_arrays(
            [pa.array(got, pa.int32()), pa.array(size[got]), pa.array(rows[got]), pa.array([least[t] for t in got], pa.binary()), pa.array([most[t] for t in got], pa.binary())],
            names=["part", "size", "rows", "least", "most"],
        )

    return count


def _count(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(interval, bytes, rows, least key, greatest key) of each interval that has rows; the result has at most a row per interval."""
    parts = keys.select("__h", "__i", "__o", "__s").mapInArrow(_counter(probes), "part int, size long, rows long, least binary, most binary")
    got = parts.groupBy("part").agg(F.sum("size"), F.sum("rows"), F.min("least"), F.max("most")).collect()
    return sorted((p, s, r, int.from_bytes(a, "big"), int.from_bytes(z, "big")) for p, s, r, a, z in got)


def _refined(lo: int, hi: int, n: int) -> list[int]:
    """Up to n boundaries in (lo, hi]: on text hashes if these differ, else on ids, else on ordinals. The last key there always gets one of its own."""
    for low in (128, 64, 0):
        if lo >> low != hi >> low:
            a, z = lo >> low, hi >> low
            return sorted({(a + (z - a) * t // n) << low for t in range(1, n + 1)} - {a << low})
    return []


def splitters(keys: DataFrame, shards: int, tolerance: float, probes: int, range_rows: int) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """The shards - 1 boundaries, and for each candidate ever counted the exact bytes and rows below it."""
    first = max(shards * 2, 64)
    at = [TOP * t // first >> 128 << 128 for t in range(1, first)]
    below: dict[int, tuple[int, int]] = {}
    best: dict[int, int] = {}
    open_ = set(range(1, shards))
    while True:
        parts = _count(keys, at)
        total = rows = 0
        spans = []  # (bytes before, bytes after, least, most, rows)
        had = {p: x for p, *x in parts}
        for t in range(len(at) + 1):
            s, r, a, z = had.get(t, (0, 0, 0, 0))
            if r:
                spans.append((total, total + s, a, z, r))
            total, rows = total + s, rows + r
            if t < len(at):
                below[at[t]] = (total, rows)
        if not total:
            return [TOP - 1] * (shards - 1), {}
        nth = {j: total * j / shards for j in range(1, shards)}
        allowed = tolerance * total / shards
        known = sorted(below.items(), key=lambda x: x[1][0])
        sizes = np.array([c for _, (c, _) in known], dtype=float)
        more: set[int] = set()
        for j in sorted(open_):
            t = int(np.searchsorted(sizes, nth[j]))
            near = min((known[x] for x in (t - 1, t) if 0 <= x < len(known)), key=lambda x: (abs(x[1][0] - nth[j]), x[0]))
            best[j] = near[0]
            span = next((s for s in spans if s[0] < nth[j] < s[1]), None)
            fresh = [x for x in _refined(span[2], span[3], probes) if x not in below] if span else []
            if abs(near[1][0] - nth[j]) <= allowed or not fresh:
                open_.discard(j)
            else:
                more |= set(fresh)
        wide = [x for *_, lo, hi, r in spans if r > 2 * range_rows for x in _refined(lo, hi, min(probes, r // range_rows + 1)) if x not in below]
        if not open_ and not wide:
            return sorted(best.values()), below
        # with all boundaries so far, so that the next spans lie within these
        at = sorted(more.union(wide, below))


def histogram_shards(df: DataFrame, hash_col: Column, id_col: str, size_col: str, shards: int = 24, tolerance: float = 0.005, probes: int = 32, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 within the shard); the bytes of the shards differ by about tolerance, or by a row.

    hash_col orders the rows first (ties: id_col, then an ordinal), range_rows is about the rows that one task of the exchange sorts.
    A null id or hash counts as the least number, a null size as zero. Rows equal in every column are interchangeable and may be
    split. An empty table stays empty. Columns of df pass through, whatever their names; shard and slot are replaced if there.
    """
    need(df, id_col, size_col)
    least = F.lit(-(1 << 63)).cast("long")
    kept = df.drop("shard", "slot")
    row = fresh(df, "__row")
    keyed = df.select(
        F.struct(*kept.columns).alias(row), F.coalesce(hash_col, least).alias("__h"), F.coalesce(F.col(id_col).cast("long"), least).alias("__i"), F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long")).alias("__s"), F.monotonically_increasing_id().alias("__o")
    )
    spark = df.sparkSession
    ship(spark)
    path = write_staged(keyed, "keys")
    keys = read_staged(spark, path)
    cuts, below = splitters(keys, shards, tolerance, probes, range_rows)
    # sub-ranges: splitters, and the counted boundaries between them at least range_rows apart
    ends, last = [], 0
    for k in sorted(set(cuts) | set(below)):
        if k in cuts or below[k][1] - last >= range_rows:
            ends.append(k)
            last = below.get(k, (0, last))[1]
    rows = {k: below.get(k, (0, 0))[1] for k in ends}
    shard_of, offset, start, n = [], [], 0, 0
    for t in range(len(ends) + 1):
        before = rows[ends[t - 1]] if t else 0
        now = sum(c <= ends[t - 1] for c in cuts) if t else 0
        if now != n:
            n, start = now, before
        shard_of.append(n)
        offset.append(before - start)

    @F.pandas_udf("struct<part:int,shard:int,base:long>")
    def place(h: pd.Series, i: pd.Series, o: pd.Series) -> pd.DataFrame:
        part = np.searchsorted(_array(ends), _keys(h.to_numpy(), i.to_numpy(), o.to_numpy()), side="right")
        return pd.DataFrame({"part": part.astype(np.int32), "shard": np.array(shard_of, np.int32)[part], "base": np.array(offset, np.int64)[part]})

    w = Window.partitionBy("__part").orderBy("__h", "__i", "__o")
    placed = keys.withColumn("__p", place("__h", "__i", "__o")).withColumn("__part", F.col("__p.part"))
    slot = (F.col("__p.base") + F.row_number().over(w) - 1).cast("long")
    return placed.select(*[F.col(row)[c].alias(c) for c in kept.columns], F.col("__p.shard").alias("shard"), slot.alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.005) -> DataFrame:
    """Digest of the sharding of whole documents: doc_id, size (UTF-8 bytes of the text, null: none, plus 8), text_crc32, law, shard, slot, grown_shard."""
    need(docs, "doc_id", "text")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select(F.col("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    out = histogram_shards(sized, F.col("text_hash"), "doc_id", "size", shards, tolerance)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
