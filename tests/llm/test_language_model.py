import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_data import frame, prose

from talkmill.llm import language_model as M

START, END = b"\0start", b"\0end"


def brute(rows):
    """Longest contexts by walking all occurrences; a document's start is a token of its contexts."""
    docs = [(zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1, [START, *(t or "").encode().lower().split(), END]) for i, t, _ in rows]
    c = Counter(w for held, t in docs if not held for w in t[1:])
    total, kinds = sum(c.values()), len(c)
    after = defaultdict(list)
    for k, (held, t) in enumerate(docs):
        if not held:
            for j in range(1, len(t)):
                after[t[j - 1]].append((k, j))
    out = []
    for held, t in docs:
        base = score = 0.0
        for i, w in enumerate(t[1:], 1):
            p = (c[w] + 0.5) / (total + 0.5 * (kinds + 1))
            base += math.log10(p)
            hits, n = after.get(t[i - 1], []), 1
            if not hits:
                score += math.log10(p)
                continue
            while more := [(k, j) for k, j in hits if j > n and i > n and docs[k][1][j - n - 1] == t[i - n - 1]]:
                hits, n = more, n + 1
            pair = sum(docs[k][1][j] == w for k, j in hits)
            m = M.MASS[min(n, len(M.MASS)) - 1]
            score += math.log10((pair + m * p) / (len(hits) + m))
        out.append((held, len(t) - 1, sum(c[w] > 0 for w in t[1:]), total, base, score))
    return out


def corpus():
    """Phrases in many documents, copies, near copies, repeats within a text, held-out and training ones alike."""
    rng = random.Random(9)
    phrase = prose(rng, 25)
    rows = []
    for k in range(150):
        t = prose(rng, rng.randint(1, 60))
        if k % 4 == 0:
            t = f"{t} {phrase} {t[:80]}"
        if k % 9 == 0:
            t = rows[k // 2][1] + " " + rng.choice(["river", "stone quiet lamp"]) if rows else t
        rows.append((k, t, "s"))
    return rows + [(200 + k, rows[8][1], "s") for k in range(12)] + [(300, None, "s"), (301, "", "s"), (302, "the " * 300, "s"), (303, "the " * 299, "s"), (None, "the river", "s"), (304, "nowords atall", "s")]


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many chunks, ranges and shards, hot contexts everywhere
        monkeypatch.setattr(M, "CHUNK_TOKENS", 400)
        monkeypatch.setattr(M, "RANGE_TOKENS", 300)
        monkeypatch.setattr(M, "SHARD_TOKENS", 500)
        monkeypatch.setattr(M, "GROWTH", 2)
    rows = corpus()
    got = sorted(M.score_documents(frame(spark, rows).repartition(3)).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    want = [w for _, w in sorted(zip(rows, brute(rows), strict=True), key=lambda x: (str(x[0][0]), x[1][1]))]
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:4] for w in want]
    assert np.allclose([(r.base_score, r.score) for r in got], [w[4:] for w in want], atol=1e-9)


def test_odd_rows(docs, rows, empty):
    assert M.score_documents(docs).count() == len(rows) and M.score_documents(empty).count() == 0


def test_blocks_round_trip():
    arrays = [np.arange(1000, dtype=np.uint32), np.zeros(0, np.int64), np.array([-5, 7], np.int64), np.array([1, 0], np.uint8)]
    for a, b in zip(arrays, M._unpack(M._pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_order_of_contexts():
    """Against sorting the contexts themselves, with long shared parts and contexts that end at different depths."""
    rng = random.Random(4)
    base = [rng.randint(1, 3) for _ in range(300)]
    t = np.array([0, *base, 0, *base[:150], 9, *base[100:], 0, *[5] * 200], np.uint32)
    i = np.arange(8, len(t) + 1)
    left = np.array([min(40, next((n for n in range(1, 41) if t[e - n] == 0), 40)) for e in i])
    want = {}
    for e, n in zip(i.tolist(), left.tolist(), strict=True):
        if n >= 4:
            want.setdefault(tuple(t[e - n : e][::-1].tolist()), (e, n))
    i, left = (np.array(x) for x in zip(*want.values(), strict=True))
    x = M.Texts(t)
    group = x.hash(i, np.full(len(i), 4))
    got = [tuple(t[i[k] - left[k] : i[k]][::-1].tolist()) for k in x.order(i, left, group, 4)]
    for g in np.unique(group):
        mine = [y for y in got if y[:4] == next(z for z, k in zip(want, group, strict=True) if k == g)[:4]]
        assert mine == sorted(mine)
    assert sorted(got) == sorted(want)


def test_words_of_slices():
    texts = ["  One two\n\nTHREE É\x1cx ", "", None, " ", "É", "last One"] * 3
    for a in range(len(texts)):
        size, flat = M.words_of(pa.array(texts).slice(a))
        want = [(t or "").encode().lower().split() for t in texts[a:]]
        assert size.tolist() == [len(w) for w in want] and [x.encode() for x in flat.to_pylist()] == [x for w in want for x in w]
