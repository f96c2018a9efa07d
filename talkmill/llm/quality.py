"""Quality rules: a learned decision list over whole-text statistics.

One pass over the texts makes the statistics (a narrow table, staged). Sequential covering on a bounded sample of labelled rows grows
conjunctions of thresholds for low quality, prunes each on rows held back, and removes what it covers. The list is emitted as one
ordered CASE expression, which Spark evaluates over the statistics of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import fresh, need, text_batches

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_upper", "n_marks", "n_digits", "n_lines", "n_distinct", "n_bare")
SCHEMA = "doc_id long, " + ", ".join(f"{s} long" for s in STATS)
SPACE, SYMBOLS, UPPER, MARKS, DIGITS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91)), b"!?", b"0123456789"
#: Most labelled rows that the list is learned from, those with the least hash of the id.
MAX_LABELLED = 20_000


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words in 3-word windows that occur twice or more, distinct words)."""
    n = len(words)
    kinds = dict.fromkeys(words)
    v = len(kinds)
    if n < 4 or v == n:
        return 0, v
    number = dict(zip(kinds, range(v), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * v + ids[1:]
    if v > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    codes = pairs[:-1] * v + ids[2:]
    s = np.sort(codes)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0, v
    hit = np.isin(codes, again)
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k : n - 2 + k] |= hit
    return int(marked.sum()), v


def stats_of(text: bytes) -> tuple[int, ...]:
    """The numbers of STATS of a text in UTF-8."""
    words = text.split()
    less = lambda b, drop: len(b) - len(b.translate(None, drop))
    body = text.translate(None, SPACE)
    # code points: bytes that don't continue a character
    points = len(body) if body.isascii() else len(body.translate(None, bytes(range(128, 192))))
    seen: set[bytes] = set()
    dup = bare = lines = 0
    for line in text.split(b"\n"):
        if line.strip(SPACE):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat, distinct = repeated_words(words)
    bare = words.count(b"|") + words.count(b"-") + words.count(b"*")
    return (len(words), points, less(body, SYMBOLS), dup, repeat, len(text), less(body, UPPER), less(body, MARKS), less(body, DIGITS), lines, distinct, bare)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [stats_of(t or b"") for t in pc.cast(b.column(1), pa.binary()).to_pylist()]
        cols = np.array(rows, np.int64).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(cols[:, k]) for k in range(len(STATS))]], names=["doc_id", *STATS])


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text; a null text counts as empty."""
    need(docs, "doc_id", "text")
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stats, SCHEMA)


#: Features of the rules: SQL over the statistics, whose names follow {p}.
RATIOS = {
    "symbols_per_word": "{p}n_symbols / ({p}n_words + 1D)",
    "dup_line_share": "{p}n_dup_lines / ({p}n_lines + 1D)",
    "repeat_share": "{p}n_repeat_words / ({p}n_words + 1D)",
    "word_length": "{p}word_chars / ({p}n_words + 1D)",
    "upper_share": "{p}n_upper / ({p}word_chars + 1D)",
    "marks_per_word": "{p}n_marks / ({p}n_words + 1D)",
    "digit_share": "{p}n_digits / ({p}word_chars + 1D)",
    "distinct_share": "{p}n_distinct / ({p}n_words + 1D)",
    "bare_share": "{p}n_bare / ({p}n_words + 1D)",
    "words": "{p}n_words * 1D",
}


@dataclass(frozen=True)
class Rule:
    """Rejects if every (feature, above, threshold) holds."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, above, at in self.terms:
            out &= (x[f] > at) if above else (x[f] <= at)
        return out

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for f, above, at in self.terms:
            c = F.expr(RATIOS[f].format(p=prefix))
            out = out & ((c > F.lit(at)) if above else (c <= F.lit(at)))
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, terms: int) -> Rule:
    """Adds the threshold with the largest FOIL gain until the rule covers only bad rows or has enough terms."""
    rule: tuple[tuple[str, bool, float], ...] = ()
    inside = np.ones(len(bad), bool)
    for _ in range(terms):
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not n0 or not p0:
            break
        best = None
        for f in x:
            v, y = x[f][inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            edge = np.nonzero(v[1:] > v[:-1])[0]
            if not len(edge):
                continue
            low_p = np.cumsum(y)[edge].astype(float)
            low_n = np.cumsum(~y)[edge].astype(float)
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
                k = int(np.argmax(gain))
                if best is None or gain[k] > best[0] + 1e-9:
                    best = (gain[k], f, above, float((v[edge[k]] + v[edge[k] + 1]) / 2))
        if best is None or best[0] <= 1e-9:
            break
        rule += (best[1:],)
        inside &= Rule((best[1:],)).holds(x)
    return Rule(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = rule.holds(x)
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, max_rules: int = 12, terms: int = 4, precision: float = 0.95) -> list[Rule]:
    """Sequential covering: grow on the rows outside prune, drop last terms while that doesn't lower the worth on prune, keep a rule of that precision."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules and (left & bad).sum() >= 3:
        g, h = left & ~prune, left & prune
        if not (g & bad).any():
            break
        rule = _grow({f: v[g] for f, v in x.items()}, bad[g], terms)
        held = {f: v[h] for f, v in x.items()}
        while len(rule.terms) > 1 and _worth(Rule(rule.terms[:-1]), held, bad[h]) >= _worth(rule, held, bad[h]):
            rule = Rule(rule.terms[:-1])
        hit = rule.holds(x) & left
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if not rule.terms or p < 2 or p / (p + n) < precision or _worth(rule, held, bad[h]) < 2 * precision - 1 and (rule.holds(held) & bad[h]).any():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learned_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The list learned from at most max_labelled labelled ids that docs has; empty without rows of both kinds.

    Ids labelled both 0 and 1, null ids and other labels are left out. The sample is the ids of least hash, so it is the same on
    each run; its size bounds what is broadcast and what comes to the driver.
    """
    need(labels, "doc_id", "quality")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    given = given.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    there = docs.select(F.col("doc_id").cast("long").alias("__id")).distinct()
    sample = given.join(there, F.col("doc_id") == F.col("__id"), "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toPandas()
    if sample.empty or sample.quality.nunique() < 2:
        return []
    ids = docs.sparkSession.createDataFrame(sample[["doc_id"]].astype("int64")).withColumnRenamed("doc_id", "__id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left_semi")
    pdf = text_stats(rows).select("doc_id", *[F.expr(e.format(p="")).alias(f) for f, e in RATIOS.items()]).toPandas()
    pdf = pdf.drop_duplicates("doc_id").merge(sample, on="doc_id").sort_values("doc_id", key=lambda x: (x * 0x9E3779B1) % (1 << 32), kind="stable")
    if pdf.empty or pdf.quality.nunique() < 2:
        return []
    x = {f: pdf[f].to_numpy(float) for f in RATIOS}
    return learn(x, (pdf.quality == 0).to_numpy(), np.arange(len(pdf)) % 3 == 0)


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The list as one ordered expression: false at the first rule that holds, else true."""
    out = None
    for r in rules:
        out = F.when(r.column(prefix), False) if out is None else out.when(r.column(prefix), False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n)


def judge_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every document; repeated rows are judged each, a null text is empty (base_failed)."""
    rules = learned_rules(docs, labels, max_labelled)
    return text_stats(docs).select("doc_id", *STATS[:5], base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are; only the text goes through Python."""
    need(docs, "doc_id", "text")
    text_batches(docs.sparkSession)
    rules = learned_rules(docs, labels, max_labelled)

    @F.pandas_udf("struct<" + ",".join(f"{s}:long" for s in STATS) + ">")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([stats_of(b"" if t is None else t.encode()) for t in texts], columns=list(STATS), dtype="int64")

    st = fresh(docs, "__st")
    return docs.withColumn(st, of("text")).where(~base_failed(f"{st}.") & verdict(rules, f"{st}.")).select(*docs.columns)
