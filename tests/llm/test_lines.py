import random

import numpy as np
from llm_data import frame, prose

from talkmill.llm import lines as S


def distance(a, b):
    r = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        n = [i]
        for j, y in enumerate(b, 1):
            n.append(min(r[j - 1] + (x != y), r[j] + 1, n[-1] + 1))
        r = n
    return r[-1]


def edited(rng, s, n):
    b = list(s)
    for _ in range(n):
        k = rng.randrange(len(b))
        how = rng.random()
        if how < 0.34:
            b.insert(k, rng.choice("abcé"))
        elif how < 0.67:
            del b[k]
        else:
            b[k] = rng.choice("abcé")
    return "".join(b)


def pairs(rng, n):
    out = []
    while len(out) < n:
        a = "".join(rng.choice(rng.choice(["ab", "abcdefgh é"])) for _ in range(rng.choice([0, 2, 8, 30, 70])))
        b = edited(rng, a, rng.randint(0, 4)) if len(a) > 4 else a + "x" * rng.randint(0, 3)
        out.append((a, b))
    return out


def test_banded_bit_vectors():
    ps = pairs(random.Random(2), 1500)
    got = S.within([a for a, _ in ps], [b for _, b in ps])
    assert (got == np.array([distance(a, b) <= S.TAU for a, b in ps])).all()


def test_segments_and_parity_lose_no_pair():
    for a, b in pairs(random.Random(4), 1500):
        if a != b and min(len(a), len(b)) >= S.MIN_CHARS and distance(a, b) <= S.TAU:
            _, parity, keys = S.signatures([a, b])
            index, probe = [set(), set()], [set(), set()]
            for is_index, ok, key in keys:
                for k, x in zip(ok, key, strict=True):
                    (index if is_index else probe)[k].add(int(x))
            assert index[0] & probe[1] or index[1] & probe[0]
            assert bin(int(parity[0]) ^ int(parity[1])).count("1") <= 4 * S.TAU


def corpus(rng):
    lines = [prose(rng, rng.randint(4, 12)) for _ in range(60)] + ["short", "shirt", "x"]
    rows = []
    for k in range(80):
        got = [rng.choice(lines) for _ in range(rng.randint(0, 6))]
        got = [edited(rng, x, rng.randint(1, 3)) if rng.random() < 0.3 and len(x) > 10 else x for x in got]
        rows.append((k, "\n".join(x + rng.choice(["", "  ", "\r"]) for x in got), "s"))
    return rows + [(90, None, "s"), (91, "\n\n \n", "s"), (92, rows[3][1], "s"), (None, rows[4][1], "s"), (92, rows[3][1], "s")]


def test_matches_brute_force(spark):
    rows = corpus(random.Random(6))
    got = S.dedup_lines(frame(spark, rows)).collect()
    kinds = sorted({x for _, t, _ in rows if t for x in S.lines_of(t) if x})
    near = {a: [b for b in kinds if a != b and min(len(a), len(b)) >= S.MIN_CHARS and distance(a, b) <= S.TAU] for a in kinds}
    root = {a: a for a in kinds}
    while True:
        new = {a: min([root[a], *(root[b] for b in near[a])]) for a in kinds}
        if new == root:
            break
        root = new
    seen, want = set(), []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ls = [x for x in S.lines_of(t) if x] if t else []
        again = 0
        for x in ls:
            again += root[x] in seen
            seen.add(root[x])
        want.append((str(i), len(ls), again, sum(bool(near[x]) for x in ls), sum(len(near[x]) for x in ls)))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    assert sum(w[4] for w in want) > 20


def test_short_lines_link(spark):
    """Against brute force without a least length: every length from 1, and pairs that cross what was the bound."""
    rng = random.Random(8)
    kinds = ["Read more here.", "Read more here!", "a", "b", "ab", "xyzw", "é", "abc", "abcde", "12345678", "12345689"]
    for n in [*range(1, 27)] * 3:
        x = "".join(rng.choice("abcdé ") for _ in range(n)).strip() or "d"
        kinds += [x, edited(rng, x, min(2, len(x))).strip() or "d"]
    kinds = sorted(set(kinds))
    got = {r.doc_id: (r.n_linked, r.n_links) for r in S.dedup_lines(frame(spark, [(k, x, "s") for k, x in enumerate(kinds)])).collect()}
    near = [sum(a != b and distance(a, b) <= S.TAU for b in kinds) for a in kinds]
    assert got == {k: (int(n > 0), n) for k, n in enumerate(near)}


def test_dropping_repeated_lines(spark):
    rng = random.Random(1)
    one, two, three = (prose(rng, 9) for _ in range(3))
    out = S.drop_repeated_lines(frame(spark, [(1, f"{one}\n\n{two}", "s"), (2, f"{two}x\n{three}", "s"), (3, one, "s"), (4, None, "s"), (5, "", "s")]))
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{one}\n\n{two}", 2: three, 3: "", 4: None, 5: ""}
    assert "__id" not in out.columns and "__doc_id" in out.columns


def test_odd_rows(docs, rows, empty):
    assert S.dedup_lines(docs).count() == len(rows) and S.dedup_lines(empty).count() == 0
