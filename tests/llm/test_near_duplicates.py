import random

import numpy as np
import pytest
import xxhash
from llm_data import frame, prose

from talkmill.llm import near_duplicates as N
from talkmill.llm.common import components


def brute_fp(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(fps, ids):
    f = np.array(fps, np.uint64)
    m = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    label = np.arange(len(f))
    while True:
        new = np.array([label[m[k]].min() for k in range(len(f))])
        if (new == label).all():
            break
        label = new
    least = {}
    for k, c in enumerate(label):
        if ids[k] is not None:
            least[c] = min(ids[k], least.get(c, ids[k]))
    return m.sum(1) - 1, [least.get(c) for c in label]


def test_matches_brute_force(docs, rows):
    got = N.near_duplicates(docs).collect()
    near, comp = brute([brute_fp(t) for _, t, _ in rows], [i for i, _, _ in rows])
    want = sorted((str(i), f"{brute_fp(t):016x}", int(n), str(c)) for (i, t, _), n, c in zip(rows, near, comp, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.n_near, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("leaf", [16, 200])
def test_tree_finds_every_link(spark, monkeypatch, leaf):
    """Crowded and random fingerprints, many shards and parts, against all pairs."""
    monkeypatch.setattr(N, "LEAF_POINTS", leaf)
    rng = random.Random(leaf)
    fps = [rng.getrandbits(64) for _ in range(400)]
    for k in range(300):  # clusters and chains of up to 4 bits
        x = fps[k % 20]
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps += [0, 1, 3, 7, 15, 31, 0, (1 << 64) - 1]
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp & ((1 << 64) - 1): (r.n_near, r.component_id) for r in N.link(df).collect()}
    near, comp = brute(fps, list(range(len(fps))))
    assert all(got[f] == (n, c) for f, n, c in zip(fps, near, comp, strict=True))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901), (901, 900), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(301)} | {900: 900, 901: 900}
    assert components(edges.limit(0)).count() == 0


def test_one_of_each_group_stays(docs, rows):
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    _, comp = brute([brute_fp(t) for _, t, _ in rows], [i for i, _, _ in rows])
    assert got == sorted({c for c in comp if c is not None})
    # the other row without an id is an empty text, of which one with an id stays
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["a text without an id"]


def test_no_text_is_lost_with_repeated_ids(spark):
    rng = random.Random(31)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(3, b, "s"), (5, a, "s"), (5, b, "s"), (7, c, "s"), (7, d, "t"), (7, d, "u"), (8, d, "s"), (None, e, "s"), (None, e, "s"), (None, c, "s"), (9, None, "s"), (9, "", "s")]
    for order in (rows, rows[::-1]):
        kept = [(r.doc_id, r.text) for r in N.keep_one(frame(spark, order)).collect()]
        assert sorted(kept, key=str) == sorted([(3, b), (5, a), (7, c), (7, d), (None, e), (9, kept_text(kept, 9))], key=str)
    one = {r.source for r in N.keep_one(frame(spark, rows)).where("doc_id = 7").collect()}
    assert one == {r.source for r in N.keep_one(frame(spark, rows[::-1])).where("doc_id = 7").collect()}


def kept_text(kept, i):
    return next(t for k, t in kept if k == i)


def test_nothing(empty, spark):
    assert N.near_duplicates(empty).count() == 0 and N.keep_one(empty).count() == 0
    one = N.near_duplicates(frame(spark, [(7, None, None)])).first()
    assert (one.doc_id, one.fingerprint, one.n_near, one.component_id) == (7, "0" * 16, 0, 7)
