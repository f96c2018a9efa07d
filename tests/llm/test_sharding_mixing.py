import zlib
from collections import defaultdict

import pytest
from llm_data import frame  # noqa: F401
from pyspark.sql import functions as F

from talkmill.llm import mixing, sharding


def test_shards(spark, docs, rows):
    got = sharding.shard_documents(docs, 6).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in by[k]) - total / 6) <= largest for k in range(6))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_shards_keep_groups_and_meet_the_tolerance(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 4000).cast("string").alias("text"))
    got = sharding.shard_documents(df, 24, tolerance=0.01)
    sizes = [r.s for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 24 and max(sizes) / min(sizes) < 1.05
    assert got.groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0


def test_one_hot_key_is_split(spark):
    """All rows have one text and one id: the ordinal of the staged table still splits them."""
    df = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard_documents(df, 8).groupBy("shard").count().collect()
    assert len(got) == 8 and max(r["count"] for r in got) - min(r["count"] for r in got) <= 2 * 3000 * 0.005 + 2


def test_shards_of_nothing_and_of_one_row(spark, empty):
    assert sharding.shard_documents(empty).count() == 0
    assert sharding.shard_documents(spark.createDataFrame([(1, "x")], "doc_id long, text string")).count() == 1


def test_operator_replaces_its_columns(docs):
    sized = docs.withColumn("bytes", F.lit(10))
    out = sharding.histogram_shards(sized, F.xxhash64("text"), "doc_id", "bytes", 3)
    assert out.columns.count("shard") == 1 and out.count() == docs.count()


def test_columns_of_any_name_pass_through(docs):
    own = {"__h": F.lit("a"), "__s": F.lit(2.5), "__o": F.lit(1), "__k": F.lit("k"), "__row": F.col("doc_id"), "__rest": F.lit(7), "__part": F.lit("p"), "__source": F.lit("z")}
    odd = docs.withColumns(own).withColumn("bytes", F.lit(10))
    out = sharding.histogram_shards(odd, F.xxhash64("text"), "doc_id", "bytes", 3)
    rest = [c for c in odd.columns if c != "shard"]
    assert sorted(map(str, out.select(*rest).collect())) == sorted(map(str, odd.select(*rest).collect()))
    mixed = mixing.mix(odd, F.lit(3))
    rest = [c for c in odd.columns if c not in mixing.NEW]
    assert sorted(map(str, mixed.select(*rest).collect())) == sorted(map(str, odd.select(*rest).collect()))


def test_many_ranges_change_no_law(spark):
    """Ranges far smaller than a shard: slots stay gapless and bytes equal."""
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), (F.col("id") % 50 + 8).alias("size"))
    got = sharding.histogram_shards(df, F.xxhash64("doc_id"), "doc_id", "size", 7, range_rows=100)
    by = got.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m"), F.sum("size").alias("s")).collect()
    assert len(by) == 7 and all(r.n == r.d == r.m + 1 for r in by) and max(r.s for r in by) / min(r.s for r in by) < 1.02


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over


@pytest.mark.parametrize("cut", ["words", "documents"])
def test_mix(spark, docs, rows, cut):
    from talkmill.llm.common import word_count

    got = mixing.mix(docs.withColumn("__w", word_count(F.col("text"))), F.col("__w"), cut=cut).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    target = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        assert cut == "words" or not r["size"] or r.taken % r["size"] == 0
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= (1 if cut == "words" else largest[s] / 2 + 1)


def test_mixed_rows_are_the_documents_cut(docs):
    from collections import Counter

    from talkmill.llm.common import word_count

    words = word_count(F.col("text"))
    taken = mixing.mix(docs.withColumn("__h", F.xxhash64("text")), words, cut="documents", tie=F.col("__h"))
    want = Counter()
    for r in taken.where("taken > 0").collect():
        want[r.doc_id, r.text] += r.taken // r["size"]
    out = mixing.mixed(docs, words)
    assert out.columns == docs.columns and Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_mix_is_the_same_again_and_in_ranges(spark, docs, monkeypatch):
    key = lambda df: sorted(map(str, df.collect()))
    one = key(mixing.mix_documents(docs))
    assert one == key(mixing.mix_documents(docs.repartition(3)))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    assert one == key(mixing.mix_documents(docs))


def test_mix_of_nothing(spark, empty):
    assert mixing.mix_documents(empty).count() == 0
    one = mixing.mix_documents(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first()
    assert (one["size"], one.taken, one.target) == (0, 0, 0.0)
