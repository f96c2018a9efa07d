"""SimHash near-duplicates by vantage-point trees.

A fingerprint has 64 bits; a link is at most 3 differing bits, so in one of its two halves a linked pair differs by at most 1 bit.
There is a vantage-point tree for each half, searched with radius 1 (the radius 3 search of whole fingerprints would overlap the
boundary for over half of all points at every level, this one for about a quarter). The top of each tree is built on the driver from
a bounded sample, which only decides how even the shards are. Every distinct fingerprint has one home shard and visits, by the
triangle bound, each shard whose boundary it may overlap; inside a shard the tree goes on, and surviving pairs are compared exactly.
The first tree reports the pairs within 1 bit in the first half, the second the others, so each ordered pair is met once.

Documents of one fingerprint are a class from the start. A task reports link counts and a forest of the links, never all pairs.
Home points of a crowded shard are split by a hash of the fingerprint and its visitors sent to each part; visitors are streamed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import components, fresh, need, rebatched, staged, text_batches, trim

BITS, HALF_RADIUS, SEED, SHINGLE = 3, 1, 42, 3
#: Home points of a part of a shard, at most; most leaves of a tree's top (fuller ones are split by hash); sampled points per leaf.
LEAF_POINTS, MAX_LEAVES, SAMPLE_PER_LEAF = 16_384, 16_384, 32


def fingerprint(text: bytes) -> int:
    """Unsigned fingerprint of a whole text in UTF-8: A-Z lower-cased, 3-word shingles with repeats."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    body = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(body, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_digest
    cut = memoryview(body)
    ones = np.zeros(64, np.int64)
    m = n - SHINGLE + 1
    a, z = starts[:m].tolist(), ends[SHINGLE - 1 :].tolist()
    for k in range(0, m, 1 << 15):  # blocks keep the bit table of a long text small; the counts are of all shingles
        digests = b"".join([h(cut[i:j], SEED) for i, j in zip(a[k : k + (1 << 15)], z[k : k + (1 << 15)], strict=True)])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.array([fingerprint(t or b"") for t in pc.cast(b.column(1), pa.binary()).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f), *b.columns[2:]], names=["doc_id", "fp", "th"][: b.num_columns])
    trim()


def fingerprints(docs: DataFrame, text_hash: Column | None = None) -> DataFrame:
    """(doc_id, fp), with text_hash also th: the fingerprint's bits as a signed long; null and wordless texts have 0."""
    need(docs, "doc_id", "text")
    text_batches(docs.sparkSession)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")] + ([] if text_hash is None else [text_hash.alias("th")])
    return docs.select(*columns).mapInArrow(_prints, "doc_id long, fp long" + ("" if text_hash is None else ", th long"))


def _half(fp: np.ndarray, tree: int) -> np.ndarray:
    u = fp.view(np.uint64)
    return ((u >> np.uint64(32)) if tree == 0 else (u & np.uint64(0xFFFFFFFF))).astype(np.uint32)


@dataclass
class Top:
    """The top of a tree: inner nodes (vantage point, radius, near child, far child); a negative child is a leaf."""

    nodes: list[tuple[int, int, int, int]] = field(default_factory=list)
    leaves: int = 0

    @staticmethod
    def build(points: np.ndarray, depth: int) -> Top:
        top = Top()

        def grow(p: np.ndarray, d: int) -> int:
            cut = _vantage(p) if d and len(p) > 2 else None
            if cut is None:
                top.leaves += 1
                return -top.leaves
            v, m, near = cut
            at = len(top.nodes)
            top.nodes.append((v, m, 0, 0))
            children = grow(p[near], d - 1), grow(p[~near], d - 1)
            top.nodes[at] = (v, m, *children)
            return at

        grow(points, depth)
        return top

    def route(self, x: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, indices): points within radius of a leaf's region; with radius 0 each point has one leaf."""
        stack = [(0 if self.nodes else -1, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            if not len(rows):
                continue
            if at < 0:
                yield -at - 1, rows
                continue
            v, m, near, far = self.nodes[at]
            d = np.bitwise_count(x[rows] ^ np.uint32(v)).astype(np.int16)
            stack += [(near, rows[d - radius <= m]), (far, rows[d + radius > m])]


def _vantage(p: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """A vantage point among the points, the radius that halves them best, and which are within; none if they can't be split."""
    best = None
    for k in (len(p) // 2, 0, len(p) - 1):
        d = np.bitwise_count(p ^ p[k])
        m = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        for r in (m, m - 1):
            n = int((d <= r).sum())
            if 0 < n < len(p) and (best is None or abs(2 * n - len(p)) < best[0]):
                best = (abs(2 * n - len(p)), int(p[k]), r, d <= r)
        if best and best[0] < len(p) // 4:
            break
    return best and best[1:]


def close_pairs(home: np.ndarray, seen: np.ndarray, tree: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (indices of seen, indices of home) of the linked, different pairs that this tree reports."""
    h, s = _half(home, tree), _half(seen, tree)
    hu, su = home.view(np.uint64), seen.view(np.uint64)
    stack = [(np.arange(len(home)), np.arange(len(seen)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        cut = _vantage(h[p]) if len(p) > 48 and len(p) * len(q) > 4096 else None
        if cut:
            v, m, near = cut
            d = np.bitwise_count(s[q] ^ np.uint32(v)).astype(np.int16)
            stack += [(p[near], q[d - HALF_RADIUS <= m]), (p[~near], q[d + HALF_RADIUS > m])]
            continue
        step = max(1, (1 << 20) // len(p))
        for k in range(0, len(q), step):
            part = q[k : k + step]
            x = su[part][:, None] ^ hu[p][None, :]
            ok = np.bitwise_count(x) <= BITS
            near = np.bitwise_count(x >> np.uint64(32)) <= HALF_RADIUS
            ok &= near & (x != 0) if tree == 0 else ~near
            i, j = np.nonzero(ok)
            if len(i):
                yield part[i], p[j]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node reachable) that connect what the links (a, b) connect."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _send(tops: list[Top], parts: list[list[int]] | None):
    """Home rows (visit 0) and visiting rows (visit 1) with their cell; without parts only the sizes of the leaves."""
    base = [0]
    for t in range(2):
        for n in parts[t] if parts else []:
            base.append(base[-1] + n)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[tuple[int, int], int] = {}
        for b in rebatched(batches):
            fp = b.column(0).to_numpy()
            n = b.column(1).to_numpy()
            for tree, top in enumerate(tops):
                x = _half(fp, tree)
                for visit in (0, 1) if parts else (0,):
                    for leaf, rows in top.route(x, HALF_RADIUS * visit):
                        if not parts:
                            sizes[tree, leaf] = sizes.get((tree, leaf), 0) + len(rows)
                            continue
                        k = parts[tree][leaf]
                        first = base[leaf + (len(parts[0]) if tree else 0)]
                        cells = [(first + (fp[rows].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(k)).astype(np.int32)] if not visit else [np.full(len(rows), first + c, np.int32) for c in range(k)]
                        for c in cells:
                            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.full(len(rows), tree, np.int8)), pa.array(np.full(len(rows), visit, np.int8)), pa.array(fp[rows]), pa.array(n[rows])], names=["cell", "tree", "visit", "fp", "n"])
        if not parts:
            got = sorted(sizes)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.int32()), pa.array([x for _, x in got], pa.int32()), pa.array([sizes[g] for g in got], pa.int64())], names=["tree", "leaf", "n"])

    return send


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per visitor its links' documents; per block of links a forest. Rows come sorted by cell, home rows first; visitors are streamed."""
    cell, tree, home, weight = None, 0, [], []
    ready: tuple[np.ndarray, np.ndarray] | None = None
    for b in rebatched(batches, 50_000):
        cells, trees, visits, fps, ns = (b.column(k).to_numpy() for k in range(5))
        cuts = np.concatenate([[0], np.nonzero(np.diff(cells) | np.diff(visits))[0] + 1, [len(cells)]])
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if cells[a] != cell:
                cell, tree, home, weight, ready = cells[a], int(trees[a]), [], [], None
            if not visits[a]:
                home.append(fps[a:z])
                weight.append(ns[a:z])
                continue
            if not home:
                continue
            if ready is None:
                ready = np.concatenate(home), np.concatenate(weight)
            p, w = ready
            q = np.ascontiguousarray(fps[a:z])
            count = np.zeros(len(q), np.int64)
            linked = []
            for i, j in close_pairs(p, q, tree):
                np.add.at(count, i, w[j])
                linked.append(forest(q[i], p[j]))
            got = np.nonzero(count)[0]
            if len(got):
                zero = np.zeros(len(got), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q[got]), pa.array(zero), pa.array(count[got])], names=["fp", "other", "n"])
                x, y = forest(np.concatenate([f[0] for f in linked]), np.concatenate([f[1] for f in linked]))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.zeros(len(x), np.int64))], names=["fp", "other", "n"])


def link(prints: DataFrame) -> DataFrame:
    """Of (doc_id, fp): a row per distinct fingerprint with fp, n_near (documents linked to one of its documents), component_id, root.

    component_id is the least id reachable, null where no reachable document has an id; root is a fingerprint that names the component.
    """
    text_batches(prints.sparkSession)
    kinds = staged(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "kinds")
    total = kinds.count()
    depth = 0
    while total / 2**depth > LEAF_POINTS and 2**depth < MAX_LEAVES:
        depth += 1
    some = kinds.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_PER_LEAF * 2**depth).toPandas().fp.to_numpy(np.int64)
    tops = [Top.build(np.unique(_half(some, t)), depth) if len(some) else Top(leaves=1) for t in (0, 1)]
    narrow = kinds.select("fp", "n")
    parts = [[1] * t.leaves for t in tops]
    for r in narrow.mapInArrow(_send(tops, None), "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        parts[r.tree][r.leaf] = max(1, -(-r.n // LEAF_POINTS))
    sent = narrow.mapInArrow(_send(tops, parts), "cell int, tree byte, visit byte, fp long, n long").repartition("cell").sortWithinPartitions("cell", "visit")
    found = staged(sent.mapInArrow(_search, "fp long, other long, n long"), "links")
    counts = found.where("n > 0").groupBy("fp").agg(F.sum("n").alias("linked")).withColumnRenamed("fp", "__a")
    roots = components(found.where("n = 0").select(F.col("fp").alias("a"), F.col("other").alias("b")))
    roots = staged(roots, "roots")
    heads = kinds.join(roots, kinds.fp == roots.node).groupBy("root").agg(F.min("least").alias("head")).withColumnRenamed("root", "__r")
    of = roots.join(heads, roots.root == heads["__r"]).select(F.col("node").alias("__b"), "head", F.col("root").alias("__root"))
    all_ = kinds.join(counts, F.col("fp") == F.col("__a"), "left").join(of, F.col("fp") == F.col("__b"), "left")
    return all_.select("fp", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_near"), F.when(F.col("__b").isNull(), F.col("least")).otherwise(F.col("head")).alias("component_id"), F.coalesce("__root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), n_near, component_id of every document; repeated rows are documents of their own, a null text is empty."""
    prints = staged(fingerprints(docs), "prints")
    kinds = link(prints).withColumnRenamed("fp", "__fp")
    return prints.join(kinds, F.col("fp") == F.col("__fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs of each group of near-duplicates: that of least (id, text hash), null ids last; all columns as they are.

    Rows are told apart by id and text, so different texts of one id are judged each by their own group. Of rows that repeat id and
    text one stays, that of least hash over all columns.
    """
    need(docs, "doc_id", "text")
    at, th = F.col("doc_id").cast("long"), F.xxhash64("text")
    prints = staged(fingerprints(docs.select("doc_id", "text"), th), "prints")
    kinds = link(prints).select(F.col("fp").alias("__fp"), "root")
    # least in each group, then every other (id, text) of the group
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    rows = prints.groupBy("doc_id", "fp", "th").agg(F.count(F.lit(1)).alias("n")).join(kinds, F.col("fp") == F.col("__fp")).withColumn("place", place)
    rows = staged(rows.select("doc_id", "th", "n", "root", "place"), "judged")
    first = rows.groupBy(F.col("root").alias("__r")).agg(F.min("place").alias("first"))
    key, hash_ = fresh(docs, "__doc_id"), fresh(docs, "__th")
    same = at.eqNullSafe(F.col(key)) & (th == F.col(hash_))
    copies = rows.join(first, F.col("root") == F.col("__r")).where("place <> first").select(F.col("doc_id").alias(key), F.col("th").alias(hash_))
    kept = docs.join(staged(copies, "copies"), same, "left_anti")
    again = staged(rows.where("n > 1").select(F.col("doc_id").alias(key), F.col("th").alias(hash_)), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    row = F.struct(*docs.columns)
    one = kept.join(again, same, "left_semi").groupBy(at.alias(key), th.alias(hash_)).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias(fresh(docs, "__row")))
    return kept.join(again, same, "left_anti").select(*docs.columns).unionByName(one.select(f"{fresh(docs, '__row')}.*"))
