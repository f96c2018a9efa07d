"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, a cut at each source's exact budget.

Sources by code point, null last, weigh 5, 2, 1, repeating, and share all words. A target stops at `most` times its source's words;
the excess is shared by weight among the others until none is above. With r = most * size / weight ascending, the capped sources are
a prefix of that order, so the level of the rest is found by one pass of prefix sums over the table of sources.

The order of a source is by md5 of seed and id (ties: id, size, text hash), so reruns agree. Ranges of the hash are the unit of the
prefix sums: per-range sums are added up over the ranges, rows only within one range, so a source with a third of all rows is spread
over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import fresh, need, staged, word_count

WEIGHTS = (5, 2, 1)
#: What the mix adds; columns of these names are replaced.
NEW = ("size", "source_size", "target", "taken")
#: Rows that one hash range of the largest source should hold on average.
RANGE_ROWS = 20_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Of a table (source, source_size), one row a source: target, the words that the mix takes of it. It has a row per source, so its windows are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    s = sizes.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(most))).withColumn("__r", F.col("__cap") / F.col("__w"))
    upto = Window.orderBy("__r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumns(
        {
            "__all": F.sum("source_size").over(whole).cast("double"),
            "__weights": F.sum("__w").over(whole),
            "__capped": F.coalesce(F.sum("__cap").over(upto), F.lit(0.0)),
            "__capped_w": F.coalesce(F.sum("__w").over(upto), F.lit(0.0)),
        }
    )
    # the level if exactly the sources before this one are capped; the first one whose own ratio reaches it sets the level of all
    s = s.withColumn("__level", (F.col("__all") - F.col("__capped")) / (F.col("__weights") - F.col("__capped_w")))
    s = s.withColumn("__level", F.min(F.when(F.col("__r") >= F.col("__level"), F.struct("__r", "source", "__level"))).over(whole)["__level"])
    target = F.least(F.col("__w") * F.col("__level"), F.col("__cap"))
    return s.select("source", "source_size", F.coalesce(target, F.col("__cap"), F.lit(0.0)).alias("target"))


def mix(df: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: str = "mix", cut: str = "words", tie: Column | None = None) -> DataFrame:
    """df (doc_id, source, ...) with size, source_size, target and taken: the words that the mix takes of a document, repeats counted.

    A source is taken whole as often as its target allows (epochs), then in hash order up to the rest. cut: "words" takes of the
    document at the cut just the words that still fit, so a source's total is its target rounded; "documents" takes it once more
    if at least half of it fits, so every document is taken whole. Null and empty texts have size 0 and taken 0; a null source is a
    source of its own; repeated rows are rows of their own. Other columns pass through, whatever their names.
    """
    need(df, "doc_id", "source")
    if cut not in ("words", "documents"):
        raise ValueError(f"cut must be words or documents, not {cut!r}")
    kept = [c for c in df.columns if c not in NEW]
    inner = df.select(F.struct(*kept).alias("__row"), "doc_id", "source", size.alias("__words"), (tie if tie is not None else F.lit(0)).alias("__tie"))
    rows = _placed(inner, F.col("__words"), weights, most, seed, cut, F.col("__tie"))
    taken = F.when(F.col("size") > 0, F.col("__epochs") * F.col("size") + F.col("__rest")).otherwise(0).cast("long")
    return rows.withColumn("taken", taken).select(*[F.col("__row")[c].alias(c) for c in kept], *NEW)


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _placed(df: DataFrame, size: Column, weights: tuple[float, ...], most: float, seed: str, cut: str, tie: Column | None) -> DataFrame:
    """Rows with size, source_size, target, __epochs (times that the whole source is taken) and __rest (what the last, partial one takes)."""
    keyed = df.withColumns({"size": size, "__k": _key(seed), "__t": tie if tie is not None else F.lit(0)}).drop("source_size", "target", "taken")
    keyed = staged(keyed, "sized")
    sizes = keyed.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("__n"))
    # the number of ranges is a power of 16: a range is a prefix of the key's hexadecimal digits
    most_rows = sizes.agg(F.max("__n")).first()[0] or 0
    digits = 0
    while most_rows / 16**digits > RANGE_ROWS:
        digits += 1
    keyed = keyed.withColumn("__b", F.substring("__k", 1, digits))
    ranges = keyed.groupBy("source", "__b").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    goal = targets(sizes.drop("__n"), weights, most)
    ranges = ranges.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    ranges = ranges.select(F.col("r.source").alias("__source"), F.col("r.__b").alias("__range"), "__before", "source_size", "target")
    inside = Window.partitionBy("source", "__b").orderBy("__k", "doc_id", "size", "__t").rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn("__upto", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__b") == F.col("__range")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("__before") - F.col("__upto")
    if cut == "words":
        rest = F.least(F.greatest(left, F.lit(0)), F.col("size"))
    else:
        rest = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0)
    return rows.withColumns({"__epochs": epochs, "__rest": rest})


#: Sources up to which the table of cuts, a row of about 100 bytes each, is broadcast.
BROADCAST_SOURCES = 50_000


def mixed(docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The rows of docs as often as the mix takes them, whole documents with all columns.

    Where a source's partial epoch ends is one key in its order, so a row's copies follow from its own key and a table with a row a
    source; the texts are not exchanged. Documents without words are taken never. Rows equal in id, size and text go together.
    """
    need(docs, "doc_id", "source", "text")
    tie = F.xxhash64("text")
    narrow = docs.select("doc_id", "source", size.alias("__words"), tie.alias("__h"))
    rows = _placed(narrow, F.col("__words"), weights, most, seed, "documents", F.col("__h"))
    place = F.struct(F.col("__k").alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("s"), F.col("__h").alias("h"))
    last = F.max(F.when((F.col("__rest") > 0) & (F.col("size") > 0), place))
    cuts = staged(rows.groupBy(F.col("source").alias("source")).agg(F.max("__epochs").cast("int").alias("epochs"), last.alias("last")), "cuts")
    cut = fresh(docs, "__cut")
    cuts = cuts.select(F.struct("source", "epochs", "last").alias(cut))
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    joined = docs.join(cuts, F.col("source").eqNullSafe(F.col(f"{cut}.source")))
    words = size
    mine = F.struct(_key(seed).alias("k"), F.col("doc_id").alias("d"), words.alias("s"), tie.alias("h"))
    more = F.when(mine <= F.col(f"{cut}.last"), 1).otherwise(0)
    times = F.when(words > 0, F.col(f"{cut}.epochs") + F.coalesce(more, F.lit(0))).otherwise(0)
    each = fresh(docs, "__each")
    return joined.withColumn(each, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


def mix_documents(docs: DataFrame) -> DataFrame:
    """Digest of the mix of whole documents: doc_id, size, source_size, target, taken."""
    need(docs, "doc_id", "text", "source")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("__words"), F.xxhash64("text").alias("__h"))
    return mix(sized, F.col("__words"), tie=F.col("__h")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB over the same tables; both engines compute the same doubles in the same order.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, cap / w AS r, (sum(source_size) OVER ())::DOUBLE AS every, sum(w) OVER () AS ws,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_w FROM s1),
s3 AS (SELECT *, (every - capped) / (ws - capped_w) AS level FROM s2),
s4 AS (SELECT *, (SELECT level FROM s3 WHERE r >= level ORDER BY r, source NULLS LAST LIMIT 1) AS lv FROM s3),
s AS (SELECT source, source_size, least(w * lv, cap) AS target FROM s4),
t AS (SELECT d.doc_id, d.size, s.source_size, s.target, round(s.target)::BIGINT AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size > 0 THEN (budget // source_size) * size + least(greatest(budget % source_size - upto, 0), size) ELSE 0 END)::BIGINT AS taken FROM t
"""
