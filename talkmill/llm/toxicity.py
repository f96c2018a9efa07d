"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is a character n-gram of a word with its ends marked; a document has it or not. Document counts of the n-grams by label are
summed over the labelled training rows in Spark, the n-grams that tell the labels apart best are kept, each scaled by its log-count
ratio, and a logistic regression weighs them. Scoring walks each whole text once with an automaton of the kept n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import fold_of, need, text_batches

SIZES = (3, 4, 5, 6)
#: Most labelled rows of the training folds that are learned from (least hash of the id), and n-grams kept.
MAX_LABELLED, MAX_FEATURES = 20_000, 6_000
_TO_SPACE = bytes.maketrans(b"".join(bytes([c]) for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(_TO_SPACE).lower().split())


def grams_of(words: set[bytes]) -> set[str]:
    out: set[str] = set()
    for w in words:
        s = f"_{w.decode('utf-8', 'replace')}_"
        for n in SIZES:
            out.update([s[k : k + n] for k in range(len(s) - n + 1)])
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: tuple[dict[str, int], dict[str, int]] = ({}, {})
    known: dict[bytes, tuple[str, ...]] = {}
    for b in batches:
        for t, y in zip(pc.cast(b.column(0), pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
            d, seen = n[y], set()
            for w in words_of(t or b""):
                g = known.get(w)
                if g is None:
                    g = tuple(grams_of({w}))
                    if len(known) < 50_000:
                        known[w] = g
                seen.update(g)
            for g in seen:
                d[g] = d.get(g, 0) + 1
            if len(n[0]) + len(n[1]) > 400_000:  # partial counts are sent on before they fill the worker
                yield _partial(n)
                n[0].clear()
                n[1].clear()
    yield _partial(n)


def _partial(n: tuple[dict[str, int], dict[str, int]]) -> pa.RecordBatch:
    keys = list(n[0].keys() | n[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[0].get(k, 0) for k in keys], pa.int64()), pa.array([n[1].get(k, 0) for k in keys], pa.int64())], names=["gram", "clean", "toxic"])


class Model:
    """Weights of n-grams and a bias. Words are remembered by worker: most have no kept n-gram."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.grams, self.values, self.bias = list(weights), np.array(list(weights.values())), bias
        self._automaton = None
        self._words: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.grams, self.values, self.bias

    def __setstate__(self, state):
        self.grams, self.values, self.bias = state
        self._automaton, self._words = None, {}

    def features(self, text: bytes) -> set[int]:
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for k, g in enumerate(self.grams):
                self._automaton.add_word(g, k)
            if self.grams:
                self._automaton.make_automaton()
        out: set[int] = set()
        if not self.grams:
            return out
        get, known = self._words.get, self._words
        if len(known) > 300_000:
            known.clear()
        for w in words_of(text):
            f = get(w)
            if f is None:
                f = known[w] = tuple({k for _, k in self._automaton.iter(f"_{w.decode('utf-8', 'replace')}_")})
            if f:
                out.update(f)
        return out

    def score(self, text: bytes) -> float:
        f = self.features(text)
        z = self.bias + (float(self.values[sorted(f)].sum()) if f else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(rows: list[np.ndarray], y: np.ndarray, n: int, l2: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent; rows: (features, scaled values) flattened by row ends."""
    ids, vals, ends = rows
    owner = np.repeat(np.arange(len(y)), np.diff(ends))
    w, b = np.zeros(n), 0.0
    norm = np.bincount(owner, vals**2, len(y)).max(initial=0) + 1
    lip = 0.25 * len(y) * norm + l2
    # a row norm is a loose bound; the step grows while the loss falls and halves where it doesn't
    step, t, u, c, last = 20 / lip, 1.0, w, b, np.inf
    for _ in range(steps):
        z = np.bincount(owner, vals * u[ids], len(y)) + c
        loss = np.logaddexp(0, -np.where(y, z, -z)).sum() + 0.5 * l2 * (u**2).sum()
        if loss > last * 1.0001:
            step, t, u, c, last = step / 2, 1.0, w, b, np.inf
            continue
        last = loss
        r = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        w2 = u - step * (np.bincount(ids, vals * r[owner], n) + l2 * u)
        b2 = c - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t, step = w2, b2, t2, step * 1.02
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, fold: int = 3, held_out: int = 1, alpha: float = 0.5) -> Model:
    """The model of the labelled documents outside the held-out fold; without both labels it knows no n-gram and scores the share of toxic rows (none: 0.5)."""
    need(labels, "doc_id", "toxic")
    text_batches(docs.sparkSession)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fold_of(F.col("doc_id"), fold) != held_out)
    given = given.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    there = docs.select(F.col("doc_id").cast("long").alias("__id")).distinct()
    sample = given.join(there, F.col("doc_id") == F.col("__id"), "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toPandas()
    if sample.empty or sample.toxic.nunique() < 2:
        share = float(sample.toxic.mean()) if len(sample) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model({}, float(np.log(share / (1 - share))))
    spark = docs.sparkSession
    ids = spark.createDataFrame(sample.astype({"doc_id": "int64", "toxic": "int32"})).withColumnRenamed("doc_id", "__id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("text", F.col("toxic").cast("int").alias("toxic"))
    n = rows.groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in n}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        share = min(max(n1 / (n0 + n1), 1e-3), 1 - 1e-3) if n0 + n1 else 0.5
        return Model({}, float(np.log(share / (1 - share))))
    counts = rows.mapInArrow(_count, "gram string, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic >= 3")
    # how far the n-gram's share among toxic rows is from its share among clean ones, in standard deviations
    p = (F.col("clean") + F.col("toxic")) / F.lit(float(n0 + n1))
    z = F.abs(F.col("toxic") / F.lit(float(n1)) - F.col("clean") / F.lit(float(n0))) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)))
    kept = counts.orderBy(z.desc(), "gram").limit(max_features).toPandas()
    ratio = np.log((kept.toxic + alpha) / (n1 + 2 * alpha)) - np.log((kept.clean + alpha) / (n0 + 2 * alpha))
    finder = Model(dict(zip(kept.gram, ratio, strict=True)), 0.0)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [sorted(finder.features(t or b"")) for t in pc.cast(b.column(0), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([np.array(x, "<u2").tobytes() for x in f], pa.binary())], names=["toxic", "found"])

    got = rows.mapInArrow(find, "toxic int, found binary").toPandas().sort_values(["toxic", "found"], kind="stable")
    found = [np.frombuffer(x, "<u2") for x in got.found]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    ids_ = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
    w, bias = fit((ids_, finder.values[ids_], ends), (got.toxic == 1).to_numpy(), len(finder.values))
    return Model(dict(zip(finder.grams, (w * finder.values).tolist(), strict=True)), bias)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every whole text; null and empty texts have the bias's score."""
    need(docs, "doc_id", "text")
    text_batches(docs.sparkSession)
    model = train(docs, labels, fold=fold, held_out=held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t or b"") for t in pc.cast(b.column(1), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id"), fold) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
