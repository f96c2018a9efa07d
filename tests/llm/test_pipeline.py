"""corpus_pipeline.run against the stages by brute force, and over odd and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_data import frame, prose
from test_decontamination_licences import smith_waterman
from test_near_duplicates import brute, brute_fp
from test_sharding_mixing import brute_targets
from test_token_files import ids_of

import corpus_pipeline
from talkmill.llm import decontamination as D


def write(spark, at, rows, labels, items):
    frame(spark, rows).select(*corpus_pipeline.COLUMNS).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{at}/benchmark.parquet")


def made(rng):
    """(rows, labels, items, are the rows good by themselves)."""
    items = [(k, prose(rng, rng.randint(22, 30))) for k in range(5)] + [(9, None), (None, "x"), (8, "")]
    rows, good = [], []

    def add(i, t, s, ok=True):
        rows.append((i, t, s))
        good.append(ok)

    for k in range(160):
        t = prose(rng, rng.randint(60, 110))
        bad = k % 4 == 0
        if bad:
            t = [" ".join(w + "&&&" for w in t.split()), t.upper().replace(" ", "!! "), t.replace(" ", " | ")][k // 4 % 3]
        add(k, t, "hot" if k % 3 else [None, "s1", "s2"][k // 3 % 3], not bad)
    for k in range(12):  # copies, near copies, and copies without an id
        t = rows[4 * k + 1][1]
        add(200 + k, t, "s1")
        add(230 + k, t + " quartz", "hot")
        add(None, t, "s2")
    for k in range(12):  # leaks, exact and edited
        words = items[k % 5][1].split()
        if k % 2:
            words = ["velvet" if n % 5 == 4 else w for n, w in enumerate(words)]
        add(300 + k, f"{prose(rng, 40)} {' '.join(words)} {prose(rng, 30)}", "s1")
    other = prose(rng, 90)
    add(5, other, "s4")  # an id with another text, which nothing is like
    add(400, prose(rng, 70), "s4")
    add(None, prose(rng, 70), "s4")
    add(401, None, "s1", False)
    add(402, "", None, False)
    add(403, "too short", "s1", False)
    add(404, (prose(rng, 12) + "\n") * 10, "s1", False)  # over half of it repeats
    labels = [(i, int(ok), 0) for (i, _, _), ok in zip(rows[:160], good, strict=False) if i % 3]
    return rows, labels, items, good


def test_run_is_the_stages_by_brute_force(spark, tmp_path):
    rows, labels, items, good = made(random.Random(17))
    write(spark, tmp_path, rows, labels, items)
    # quality rules: the junk goes
    docs = [r for r, ok in zip(rows, good, strict=True) if ok]
    # near-duplicates: the least (id, text) of each group, null ids last
    label = brute([brute_fp(t) for _, t, _ in docs], list(range(len(docs))))[1]
    groups = defaultdict(list)
    for r, g in zip(docs, label, strict=True):
        groups[g].append(r)
    docs = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    # decontamination: every item against every document
    asked = [D.words_of(t.encode()) for i, t in items if i is not None and t]
    leaks = lambda t: any(smith_waterman(x, w := D.words_of(t.encode()))[0] >= 2 * D.THRESHOLD * len(x) for x in asked)  # noqa: E731, F841
    docs = [r for r in docs if not leaks(r[1])]
    assert 60 < len(docs) < 140 and not any(r[0] and 300 <= r[0] < 312 for r in docs) and sum(r[0] == 5 for r in docs) == 2
    # mixing: whole documents in the order of their hash, up to the target
    size = lambda r: len(r[1].split())
    by = defaultdict(list)
    for r in docs:
        by[r[2]].append(r)
    target = brute_targets({s: sum(map(size, x)) for s, x in by.items()})
    taken = Counter()
    for s, x in by.items():
        whole, left = divmod(round(target[s]), sum(map(size, x)))
        for r in sorted(x, key=lambda r: (hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), size(r))):
            taken[r] += whole + (left * 2 >= size(r))
            left -= size(r)
    mixed = [r for r, n in taken.items() for _ in range(n)]
    # token files
    want = Counter((r[0], len(e), zlib.crc32(e.tobytes())) for r, e in zip(mixed, ids_of([r[1] for r in mixed]), strict=True))
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


@pytest.mark.parametrize("name", ["nothing", "nulls", "no labels"])
def test_odd_tables_run_through(spark, tmp_path, name):
    rows, labels, items, _ = made(random.Random(5))
    if name == "nothing":
        rows, labels, items = [], [], []
    if name == "nulls":
        rows = [(None, None, None), (1, None, "s"), (1, None, "s"), (2, "", None), (None, "a b", "s")]
    if name == "no labels":
        rows, labels = rows[:40], []
    write(spark, tmp_path, rows, labels, items)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert (got.count() > 0) == (name == "no labels")


def test_stages_keep_all_columns(spark, tmp_path):
    rows, labels, items, _ = made(random.Random(6))
    write(spark, tmp_path, rows, labels, items)
    docs = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
