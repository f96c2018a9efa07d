import random
from collections import Counter

import numpy as np
from llm_data import frame, prose

from talkmill.llm import quality as Q
from talkmill.llm import toxicity as T


def brute_stats(t):
    t = t or ""
    w = t.encode().split()
    n, c, mark = len(w), Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(n - 2):
        if c[(w[k], w[k + 1], w[k + 2])] > 1:
            mark |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return n, sum(len(x.decode()) for x in w), sum(t.count(x) for x in "#*$%&|<>"), dup, len(mark)


def labelled(spark, n=900):
    """Clean prose and three kinds of junk; ids labelled twice, oddly or not at all."""
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(n):
        t = prose(rng, rng.randint(60, 200))
        bad = k % 4 == 0
        if bad:
            t = [" ".join(w + "&&&" for w in t.split()), t.upper().replace(" ", "!! "), t.replace(" ", " | ")][k // 4 % 3]
        rows.append((k, t, "s"))
        if k % 3:
            labels.append((k, 0 if bad else 1, 0))
    labels += [(1, 0, None), (None, 1, 1), (2, 7, 7), (10**9, 0, 1)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_stats(docs, rows):
    got = Counter((r.doc_id, *r[1:6]) for r in Q.text_stats(docs).collect())
    assert got == Counter((i, *brute_stats(t)) for i, t, _ in rows)


def test_rules_separate_junk(spark):
    docs, labels, rows = labelled(spark)
    out = {r.doc_id: r for r in Q.judge_documents(docs, labels).collect()}
    assert len(out) == len(rows)
    right = sum(out[k].kept == (k % 4 != 0) for k in range(len(rows)))
    assert right > 0.98 * len(rows)
    assert all(out[k].kept for k in range(len(rows)) if k % 4)
    kept = Q.keep_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in out.items() if r.kept}


def test_rules_are_an_ordered_expression_that_numpy_reads_alike(spark):
    docs, labels, _ = labelled(spark)
    rules = Q.learned_rules(docs, labels)
    assert rules and rules == Q.learned_rules(docs.repartition(7), labels.repartition(3))
    pdf = Q.text_stats(docs).selectExpr("doc_id", *[f"{e.format(p='')} as {f}" for f, e in Q.RATIOS.items()]).toPandas()
    hit = np.zeros(len(pdf), bool)
    for r in rules:
        hit |= r.holds({f: pdf[f].to_numpy() for f in Q.RATIOS})
    got = {r.doc_id: r.v for r in Q.text_stats(docs).select("doc_id", Q.verdict(rules).alias("v")).collect()}
    assert got == dict(zip(pdf.doc_id, (~hit).tolist(), strict=True))


def test_quality_without_labels_or_documents(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.judge_documents(docs, none).collect()
    assert len(got) == len(rows) and all(r.kept != r.base_failed for r in got)
    _, labels, _ = labelled(spark, 30)
    assert Q.judge_documents(empty, labels).count() == 0 and Q.keep_documents(empty, labels).count() == 0


def toxic_corpus(spark, n=900):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        words = prose(rng, rng.randint(30, 300)).split()
        bad = k % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grobian", "nitwit,", "Lummox", "dunce"]))
        rows.append((k, " ".join(words), "s"))
        labels.append((k, int(bad), 1))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), rows


def test_toxicity_on_held_out_rows(spark):
    docs, labels, rows = toxic_corpus(spark)
    out = {r.doc_id: r for r in T.score_documents(docs, labels).collect()}
    held = [k for k in range(len(rows)) if out[k].held_out]
    assert 0.2 < len(held) / len(rows) < 0.5
    assert sum(out[k].predicted == (k % 5 == 0) for k in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())


def test_toxicity_never_learns_from_the_held_out_fold(spark):
    import zlib

    docs, labels, _ = toxic_corpus(spark, 400)
    flipped = spark.createDataFrame([(r.doc_id, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.toxic) for r in labels.collect()], "doc_id long, toxic int")
    one = {r.doc_id: r.score for r in T.score_documents(docs, labels).collect()}
    assert one == {r.doc_id: r.score for r in T.score_documents(docs, flipped).collect()}


def test_toxicity_of_odd_texts(spark, docs, rows, empty):
    _, labels, _ = toxic_corpus(spark, 200)
    got = T.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert T.score_documents(empty, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.score_documents(docs, none).collect()} == {0.5}
