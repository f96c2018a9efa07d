"""Archives end to end: listing, lines, filters, counts, parents, sinks, resume, integrity."""

import csv
import io
import json
import random
from pathlib import Path

import corpora as C
import pytest
import zstandard
from pyspark.sql import functions as F

from talkmill import manifests
from talkmill.cli import main
from talkmill.operators import aggregate, analytics, bucketing, parents, project
from talkmill.plans.query import Predicate, Query
from talkmill.sinks import files as sinks
from talkmill.sources import integrity
from talkmill.sources.lines import read_jsonl, read_lines, window_log
from talkmill.sources.listing import Archive
from talkmill.sources.records import parse, scan


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    return Archive.at(str(C.basic(tmp_path_factory.mktemp("corpus"))))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_listing(archive, tmp_path):
    assert [(j.kind, j.month) for j in archive.discover()] == [("comment", "2006-01"), ("comment", "2006-02"), ("submission", "2006-01")]
    assert [j.month for j in archive.plan(("comment",), "2006-02")] == ["2006-02"]
    with pytest.raises(FileNotFoundError):
        archive.plan(start="2010-01")
    with pytest.raises(FileNotFoundError):
        Archive.at(str(tmp_path)).plan()
    assert archive.describe()[-1]["files"] == 3
    (tmp_path / "comments").write_text("x")
    with pytest.raises(NotADirectoryError):
        Archive.at(str(tmp_path)).discover()


QUERIES = [
    ({}, ["c1", "c2", "c4", "c5", "s1", "s2"]), ({"include_pseudo_users": True}, ["c1", "c2", "c3", "c4", "c5", "s1", "s2"]), ({"subreddits": ("rust",)}, ["c4"]), ({"exclude_common_bots": True}, ["c1", "c2", "c4", "c5", "s1"]),
    ({"ids": ("t1_C1", "s2")}, ["c1", "s2"]), ({"ids": ("t3_c1",)}, []), ({"min_score": 5}, ["c2", "s1", "s2"]), ({"max_score": 1}, ["c1", "c4", "c5"]), ({"start_month": "2006-02"}, ["c4", "c5"]),
    ({"after": C.FEB06, "before": C.FEB06 + 5}, ["c4"]), ({"keywords_any": ("HELLO",)}, ["c1", "c4"]), ({"keywords_any": ("über",)}, ["c5"]), ({"exclude_keywords": ("hello",)}, ["c2", "c5", "s1", "s2"]),
    ({"keywords_all": ("see", "x.org")}, ["c2"]), ({"contains_url": True}, ["c2", "s1", "s2"]), ({"no_url": True}, ["c1", "c4", "c5"]), ({"domains": ("NYTimes.com",)}, ["s2"]), ({"text_regex": "^hel+o$"}, ["c1", "c4"]),
    ({"author_regex": "^[ab]"}, ["c1", "s1"]), ({"json": (Predicate("/distinguished", "exists"),)}, ["c1", "c2", "c4", "c5"]), ({"json": (Predicate("/distinguished", "!=", 1),), "subreddits": ("rust",)}, ["c4"]),
]


@pytest.mark.parametrize(("q", "want"), QUERIES, ids=[str(q) for q, _ in QUERIES])
def test_filters(spark, archive, q, want):
    assert ids(scan(spark, archive, Query(**q))) == want


def test_long_lists_become_joins(spark, archive):
    many = tuple(f"t1_x{k}" for k in range(600))
    df = scan(spark, archive, Query(ids=(*many, "t1_c1", "s2"), exclude_authors=tuple(f"u{k}" for k in range(600))))
    assert ids(df) == ["c1", "s2"]
    assert "LeftSemi" in df._jdf.queryExecution().toString() and "LeftAnti" in df._jdf.queryExecution().toString()


def test_pruning_never_opens_other_months(spark, tmp_path):
    C.basic(tmp_path)
    (tmp_path / "comments" / "RC_2007-01.zst").write_text("not zstd")
    assert ids(scan(spark, Archive.at(str(tmp_path)), Query(before=C.FEB06))) == ["c1", "c2", "s1", "s2"]


def test_random_queries_against_plain_python(spark, tmp_path):
    rng = random.Random(1)
    rows = [C.comment(f"c{k}", author=rng.choice(["a", "B", "[deleted]", "bot"]), subreddit=rng.choice(["x", "Y"]), score=rng.choice([-5, 0, 3, None, "7", 2.0, 2.5]), body=rng.choice(["foo", "BAR foo", "", None]), created=C.JAN06 + rng.randrange(86400)) for k in range(300)]
    C.write(tmp_path, "RC_2006-01", rows)
    records = parse(read_lines(spark, Archive.at(str(tmp_path)).plan())).cache()

    def score(v):
        return int(v) if isinstance(v, (int, float)) and v == int(v) or isinstance(v, str) else None

    for _ in range(12):
        q, tests = {}, [lambda r: r["author"] != "[deleted]"]
        if rng.random() < 0.5:
            n = rng.choice([-1, 2, 3])
            q["min_score"] = n
            tests.append(lambda r, n=n: score(r["score"]) is not None and score(r["score"]) >= n)
        if rng.random() < 0.5:
            q["authors"] = ("b", "A")
            tests.append(lambda r: r["author"].lower() in ("a", "b"))
        if rng.random() < 0.4:
            q["keywords_any"] = ("bar",)
            tests.append(lambda r: "bar" in (r["body"] or "").lower())
        elif rng.random() < 0.5:
            q["exclude_keywords"] = ("foo",)
            tests.append(lambda r: "foo" not in (r["body"] or "").lower())
        assert ids(Query(**q).build().apply(records)) == sorted(r["id"] for r in rows if all(t(r) for t in tests)), q


def test_long_windows_and_frames(spark, tmp_path):
    p = C.write(tmp_path, "RC_2006-01", [C.comment(f"c{k}") for k in range(50)], window_log=29)
    assert window_log(str(p)) == 29
    C.write(tmp_path, "RC_2006-02", [C.comment("d1"), C.comment("d2")], frames=2)
    lines = read_lines(spark, Archive.at(str(tmp_path)).plan())
    assert ids(parse(lines)) == sorted([f"c{k}" for k in range(50)] + ["d1", "d2"])
    assert {r.ordinal for r in lines.where("file_month = '2006-01'").collect()} == set(range(50))


def test_malformed_lines(spark):
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert parse(df('{"id":"a"}', "", "[1]", "7", '{"id":"b","id":"c"}')).count() == 1
    with pytest.raises(Exception, match="malformed JSON"):
        parse(df('{"id":"a"}', "{oops")).collect()
    with pytest.raises(Exception, match="malformed JSON"):
        parse(df('{"id":"a"}', " "), blank="fail").collect()
    assert parse(df("{oops", '{"id":1}'), malformed="skip").first().id is None


def test_counts(spark, archive):
    records = scan(spark, archive, Query(), blank="fail")
    assert [tuple(r) for r in analytics.count_by_month(records).collect()] == [("2006-01", 4), ("2006-02", 2)]
    assert {r.author: r.n for r in analytics.author_counts(records).collect()} == {"alice": 2, "charlie": 1, "bob": 1, "AutoModerator": 1, "Dora": 1}
    assert {r.author: r.first_seen for r in analytics.first_seen(records).collect()}["alice"] == C.JAN06
    assert sorted(analytics.iter_usernames(records)) == ["AutoModerator", "Dora", "alice", "bob", "charlie"]
    assert [r.key for r in analytics.distinct_keys(records, "subreddit").collect()] == ["programming", "rust"]
    s = analytics.key_stats(records, "json:/distinguished")
    assert (s.matched, s.unique, s.missing, s.warns) == (6, 0, 6, True)
    with pytest.raises(ValueError):
        analytics.key_stats(records, "json:/nothing", strict=True)
    assert ids(analytics.subreddit_usernames(records, "r/Rust").withColumnRenamed("author", "id")) == ["alice"]


def jsonl(spark, rows):
    return parse(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))


def test_expression_aggregates(spark):
    rows = [{"subreddit": "a", "created_utc": 10, "x": 1, "t": "p"}, {"subreddit": "a", "created_utc": 5, "x": "2", "t": None}, {"subreddit": "b", "created_utc": 1e9, "x": 2**53 + 1, "t": [1]}, {"subreddit": "b", "created_utc": "7", "x": 1}, {"x": 5}, {"subreddit": "c", "created_utc": 1, "x": "no", "t": 1}]
    out = {r.subreddit: r for r in aggregate.aggregate(jsonl(spark, rows), "subreddit", "count(*),sum(x),min(x),max(/x),distinct(t),first(t),last(t)").collect()}
    assert (out["a"]["count"], out["a"].sum_x, out["a"].sum_x__exact, out["a"].distinct_t, out["a"].first_t, out["a"].last_t) == (2, 3.0, 3, 1, "null", '"p"')
    assert out["b"].sum_x__exact == 2**53 + 2 and out["b"].last_t == "[1]" and out["c"].sum_x is None
    assert aggregate.aggregate(jsonl(spark, rows), "", "count(*)").first()["count"] == 6
    assert aggregate.aggregate(jsonl(spark, rows).limit(0), "", "count(*)").count() == 0
    assert [r.year for r in aggregate.aggregate(jsonl(spark, rows), "year", "count(*)").collect()] == ["1970", "2001"]
    for k, a in (("nope", "count(*)"), ("", "median(x)"), ("month,month", "count(*)"), ("", "sum()")):
        with pytest.raises(aggregate.AggregateError):
            aggregate.aggregate(jsonl(spark, rows), k, a)


def test_rollups(spark):
    rows = [{"subreddit": "a", "n": 10**15}, {"subreddit": "a", "n": "1"}, {"subreddit": "b", "n": 1.5}, {"subreddit": "c", "n": None}, {"n": 4}, {"subreddit": "B", "created_utc": "2006-01-05T00:00:00Z"}, {"subreddit": "b", "n": 2, "created_utc": "1136073600"}, {"created_utc": 1.0}]
    r = jsonl(spark, rows)
    assert [(x.key, x.value, x.n) for x in aggregate.rollup(r, "subreddit").collect()] == [("B", 1.0, 1), ("a", 2.0, 2), ("b", 2.0, 2), ("c", 1.0, 1)]
    assert [(x.key, x.value, x.exact) for x in aggregate.rollup(r, "subreddit", "sum:/n").collect()] == [("a", 1e15 + 1, 10**15 + 1), ("b", 3.5, None)]
    assert [x.key for x in aggregate.rollup(r, "subreddit", "max:/n", top=1).collect()] == ["a"]
    assert [(x.key, x.value) for x in aggregate.rollup(r, "month").collect()] == [("2006-01", 2.0)]
    assert aggregate.rollup(r).first()["count"] == 8 and aggregate.skipped(r, "subreddit") == 2
    assert aggregate.average_text(1, 7) == "0.142857142857142857" and aggregate.average_text(2, 3) == "0.666666666666666667" and aggregate.average_text(4, 2) == "2"
    assert [aggregate.number_text(x) for x in (-0.0, 3.0, 0.1, 1e21, 1e-7)] == ["0", "3", "0.1", "1000000000000000000000", "0.0000001"]


def test_user_aggregator(spark):
    from talkmill.operators.samples import SumOfScores

    lines = spark.createDataFrame([(json.dumps({"score": k}),) for k in range(100)], "value string").repartition(40)
    got = aggregate.run_aggregator(lines, SumOfScores, SumOfScores.from_json, fan_in=4)
    assert (got.total, got.records) == (4950, 100)


def test_parents(spark, archive, tmp_path):
    records = scan(spark, archive, Query(include_pseudo_users=True), kinds=("comment",))
    wanted = parents.collect_parent_ids(records)
    assert sorted((r.kind, r.id) for r in wanted.collect()) == [("comment", "c1"), ("submission", "s1")]
    everything = parse(read_lines(spark, archive.plan()))
    got = parents.attach(records, parents.resolve(everything, wanted))
    assert parents.attach_stats(got) == {"resolved": 5, "unresolved": 0}
    out = {json.loads(r.value)["id"]: json.loads(r.value)["parent"] for r in parents.attached_json(got).collect()}
    assert out["c2"] == {"kind": "comment", "id": "c1", "body": "hello"} and out["c1"] == {"kind": "submission", "id": "s1", "title": "a title", "selftext": ""}
    fields = parents.resolve(everything, wanted, fields=["score", "nothing"]).where("id = 's1'").first()
    assert json.loads(fields.payload) == {"score": 5}
    direct = parents.direct(everything, ["t3_s2", "t1_c1", "t3_none"], full=True).collect()
    assert [r.id for r in direct] == ["t3_s2", "t1_c1"] and json.loads(direct[1].payload)["body"] == "hello"
    with pytest.raises(ValueError):
        parents.parent_ids(spark, ["s1"])
    d = parents.diagnostics(records).first()
    assert (d.records, d.parent_t1, d.parent_t3, d.parent_malformed) == (5, 1, 4, 0)


def test_a_parent_of_several_months(spark):
    ps = spark.createDataFrame([("comment", "p", "2006-01", '{"body":"jan"}'), ("comment", "p", "2006-03", '{"body":"mar"}')], "kind string, id string, file_month string, payload string")
    kids = jsonl(spark, [C.comment("a", parent="t1_p"), C.comment("b", parent="t1_p", created=C.FEB06), C.comment("x", parent="t1_q"), C.comment("y", parent="nonsense")])
    got = {r.id: r.parent_payload for r in parents.attach(kids, ps).collect()}
    assert got == {"a": '{"body":"jan"}', "b": '{"body":"mar"}', "x": None, "y": None}


def test_single_file_sinks(spark, archive, tmp_path):
    records = scan(spark, archive, Query())
    sinks.write_jsonl(records, f"{tmp_path}/o.jsonl")
    lines = Path(tmp_path, "o.jsonl").read_text().splitlines()
    assert [json.loads(x)["id"] for x in lines] == ["c1", "c2", "c4", "c5", "s1", "s2"]
    for pretty in (False, True):
        sinks.write_json(records, f"{tmp_path}/o.json", pretty)
        assert [r["id"] for r in json.loads(Path(tmp_path, "o.json").read_text())] == ["c1", "c2", "c4", "c5", "s1", "s2"]
    sinks.write_json(records.limit(0), f"{tmp_path}/none.json")
    assert json.loads(Path(tmp_path, "none.json").read_text()) == []
    odd = jsonl(spark, [{"id": "1", "body": 'a "b", c\nd', "n": {"x": [1]}}, {"id": "2", "body": " lead"}])
    sinks.write_table(odd, f"{tmp_path}/o.csv", ["id", "body", "/n/x"], order=("id",))
    raw = Path(tmp_path, "o.csv").read_bytes().decode()
    assert raw.startswith('id,body,/n/x\r\n1,"a ""b"", c\nd",[1]\r\n') and list(csv.reader(io.StringIO(raw, newline="")))[2] == ["2", " lead", ""]
    with pytest.raises(Exception, match="field body"):
        sinks.write_table(odd, f"{tmp_path}/o.tsv", ["id", "body"], tsv=True)
    assert not list(tmp_path.glob("*.parts")) and not list(tmp_path.glob(".*inprogress"))
    with pytest.raises(ValueError):
        sinks.write_table(odd, f"{tmp_path}/x.csv", [])
    sinks.write_parquet(records, f"{tmp_path}/p", "zstd:5")
    assert spark.read.parquet(f"{tmp_path}/p").where("id = 'c2'").first().score == 7
    with pytest.raises(ValueError):
        sinks.write_parquet(records, f"{tmp_path}/p", "zip")


@pytest.mark.parametrize("fmt", ["zst", "jsonl", "parquet"])
def test_partitioned_export_reads_back(spark, archive, tmp_path, fmt):
    records = scan(spark, archive, Query(subreddits=("programming",)))
    Path(tmp_path, "comments").mkdir()
    stale = Path(tmp_path, "comments", f"RC_1999-01.{'zst' if fmt == 'zst' else 'jsonl'}")
    stale.write_text("x")
    assert sum(sinks.export_partitioned(records, str(tmp_path), fmt).values()) == 5
    if fmt == "zst":
        assert not stale.exists() and ids(scan(spark, Archive.at(str(tmp_path)), Query())) == ["c1", "c2", "c5", "s1", "s2"]
    with pytest.raises(ValueError):
        sinks.export_partitioned(records, str(tmp_path), "zst", level=99)


def test_spool_and_resume(spark, tmp_path):
    corpus = tmp_path / "corpus"
    C.basic(corpus)
    archive, out = Archive.at(str(corpus)), str(tmp_path / "spool")
    q = Query(subreddits=("rust",))
    paths, n = manifests.resumed_spool(spark, archive, q, out)
    assert [Path(p).name for p in paths] == ["part_RC_2006-01.jsonl", "part_RS_2006-01.jsonl", "part_RC_2006-02.jsonl"] and n == 1
    assert Path(paths[0]).read_bytes() == b"" and [x[:2] for x in sinks.spool_parts(out)] == [("comment", "2006-01"), ("submission", "2006-01"), ("comment", "2006-02")]
    old = Path(paths[2]).stat().st_mtime_ns
    assert manifests.resumed_spool(spark, archive, q, out) == (paths, 1) and Path(paths[2]).stat().st_mtime_ns == old
    Path(paths[2]).write_text("damaged")
    manifests.resumed_spool(spark, archive, q, out)
    assert json.loads(Path(paths[2]).read_text())["id"] == "c4"
    C.write(corpus, "RC_2006-02", [C.comment("n1", subreddit="rust"), C.comment("n2", subreddit="rust")])  # another file: all parts are stale
    assert manifests.resumed_spool(spark, archive, q, out)[1] == 2


def test_integrity_and_partial_reads(spark, tmp_path):
    C.basic(tmp_path)
    archive = Archive.at(str(tmp_path))
    assert integrity.check(spark, archive.plan(), "full").ok
    p = C.write(tmp_path, "RC_2006-03", [C.comment(f"x{k}", body="".join(random.Random(k).choices("abcdefgh", k=200)), created=C.FEB06 + 86400 * 30) for k in range(3000)])
    data = p.read_bytes()
    p.write_bytes(data[:-40])
    flipped = bytearray(data)
    flipped[len(data) // 2] ^= 0xFF
    Path(tmp_path, "comments", "RC_2006-04.zst").write_bytes(bytes(flipped))
    Path(tmp_path, "comments", "RC_2006-05.zst").write_text("plain text")
    bad = []
    full = integrity.check(spark, archive.plan(), "full", sink=lambda path, e: bad.append(path[-11:-4]))
    assert sorted(bad) == ["2006-03", "2006-04", "2006-05"] and full.exit_code == 2
    assert [f[0][-11:-4] for f in integrity.check(spark, archive.plan(), "quick").failures] == ["2006-05"]
    good, report = integrity.sound(spark, archive.plan())
    assert len(good) == 3 and len(report.failures) == 3
    job = archive.plan(start="2006-03", end="2006-03")
    with pytest.raises(Exception):  # noqa: B017
        read_lines(spark, job).count()
    assert 0 < read_lines(spark, job, partial=True).count() < 3000


def test_manifests(archive, tmp_path):
    doc = manifests.corpus_manifest(archive, digests=True)
    assert all(r["state"] == "ok" for r in manifests.corpus_plan(archive, doc, digests=True))
    doc["sources"][0]["last_month"] = "2006-03"
    doc["sources"][0]["files"][0]["size"] += 1
    assert [r["state"] for r in manifests.corpus_plan(archive, doc)] == ["size", "ok", "missing", "ok"]
    assert [r["month"] for r in manifests.corpus_plan(archive, doc, only_missing=True)] == ["2006-03"]
    jobs = archive.plan()
    a = manifests.fingerprint(Query(min_score=1).build(), {"f": 1}, jobs)
    assert a == manifests.fingerprint(Query(min_score=1).build(), {"f": 1}, jobs) != manifests.fingerprint(Query(min_score=2).build(), {"f": 1}, jobs)
    manifests.run_manifest(f"{tmp_path}/a", Query(), {}, jobs, {"records": 1})
    b = manifests.run_manifest(f"{tmp_path}/b", Query(), {}, jobs, {}, upstream=[f"{tmp_path}/a"])
    assert b["upstream"][0]["fingerprint"] == json.loads(Path(tmp_path, "a.manifest.json").read_text())["fingerprint"]
    Path(tmp_path, "p.json").write_text("{oops")
    assert manifests.Progress.load(f"{tmp_path}/p.json", "x").months == {}


def test_bucketing(spark, tmp_path):
    lines = spark.createDataFrame([(f'{{"k":"{k % 7}"}}',) for k in range(100)] + [("{}",)], "value string")
    key = F.get_json_object("value", "$.k")
    s = bucketing.partition_by_key(lines, key, 4, f"{tmp_path}/b")
    assert (s.routed, s.without_key) == (100, 1)
    seen = {}
    for r in spark.read.text(f"{tmp_path}/b").collect():
        assert seen.setdefault(r.value, r["shard"]) == r["shard"]
    parts = bucketing.write_parts(lines, key, 20, str(tmp_path), "x")
    assert len(parts) == 20 and sum(len(Path(p).read_text().splitlines()) for p in parts) == 100 and Path(parts[0]).name == "x_part_000000.ndjson"
    import pandas as pd

    got = bucketing.for_each_group(lines, key, lambda k, pdf: pd.DataFrame({"k": [k], "n": [len(pdf)]}), "k string, n long").collect()
    assert {r.k: r.n for r in got} == {str(k): 15 if k < 2 else 14 for k in range(7)}
    with pytest.raises(Exception, match="tab or line break"):
        analytics.reduce_kv(spark.createDataFrame([("a\tb", 1)], "key string, value long")).collect()


def test_tables(spark):
    df = spark.range(3)
    sinks.load_table(df, "tm_one")
    with pytest.raises(ValueError):
        sinks.load_table(df, "tm_one")
    sinks.load_table(df, "tm_one", if_exists="append")
    assert spark.table("tm_one").count() == 6
    sinks.load_table(df, "tm_view", as_view=True)
    for bad in ({"name": "a;b"}, {"name": "v", "as_view": True, "if_exists": "append"}):
        with pytest.raises(ValueError):
            sinks.load_table(df, **bad)


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from talkmill.streaming.ingest import ingest

    C.basic(tmp_path / "in")
    run = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), Query(subreddits=("programming",))).awaitTermination()
    run()
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == ["c1", "c2", "c5", "s1", "s2"]
    run()
    C.write(tmp_path / "in", "RC_2006-03", [C.comment("c9")])
    run()
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == ["c1", "c2", "c5", "c9", "s1", "s2"]


def test_schema_profile(spark, archive):
    out = {r.field: r for r in analytics.schema_profile(read_lines(spark, archive.plan(("comment",))), 2).collect()}
    assert out["distinguished"].type == "null" and out["score"].type == "number" and out["id"].sampled_records == 4 and out["id"].presence_pct == 100.0


def test_monitor(spark, tmp_path):
    from talkmill.monitor import Monitor

    with Monitor(spark, f"{tmp_path}/e", f"{tmp_path}/s", every=0.05) as m:
        spark.range(1000).count()
        import time

        time.sleep(0.2)
    assert m.exit_code == 0 and [json.loads(x)["event"] for x in Path(tmp_path, "e").read_text().splitlines()] == ["started", "ended"]
    assert "driver_rss_mb" in json.loads(Path(tmp_path, "s").read_text())
    with Monitor(spark, max_seconds=0.1, every=0.05) as m:
        spark.range(1 << 40).selectExpr("sum(hash(id))").collect()
    assert (m.exit_code, m.reason) == (2, "time")


def test_whitelist_and_limits(spark, archive):
    records = scan(spark, archive, Query())
    assert project.unmatched_fields(records, ["id", "nope"]) == ["nope"]
    v = records.where("id = 'c1'").select(project.rewritten(F.col("value"), ["id", "created_utc"], True).alias("v")).first().v
    assert v == '{"id":"c1","created_utc":"2006-01-01T00:00:00Z"}'
    assert analytics.limit(records, 0).count() == 0 and analytics.limit(records.select("id"), 2, ["id"]).collect()[1].id == "c2"
    with pytest.raises(ValueError):
        analytics.limit(records, -1)


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "demo")
    run = lambda *a: main([*a])
    assert run("quickstart", "--corpus", root) == 0 and run("describe", "--corpus", root) == 0
    capsys.readouterr()
    assert run("count", "--corpus", root, "--subreddit", "programming") == 0
    assert capsys.readouterr().out == "2019-12\t4\n2020-01\t4\n"
    assert run("dedupe", "--corpus", root, "--key", "subreddit", "--out", f"{tmp_path}/k.tsv") == 0 and Path(tmp_path, "k.tsv").read_text() == "programming\nrust\n"
    assert run("export", "--corpus", root, "--format", "spool", "--out", f"{tmp_path}/sp", "--source", "comments") == 0
    assert run("parents", "--corpus", root, "--spool", f"{tmp_path}/sp", "--out", f"{tmp_path}/p.jsonl") == 0
    assert all("parent" in json.loads(x) for x in Path(tmp_path, "p.jsonl").read_text().splitlines())
    assert run("aggregate", f"{tmp_path}/p.jsonl", "--group-by", "subreddit", "--agg", "count(*),sum(score)", "--out", f"{tmp_path}/a.jsonl") == 0
    assert [json.loads(x)["count"] for x in Path(tmp_path, "a.jsonl").read_text().splitlines()] == [4, 2]
    assert run("convert", f"{tmp_path}/p.jsonl", "--field", "id", "--field", "parent.title", "--out", f"{tmp_path}/c.csv") == 0
    assert Path(tmp_path, "c.csv").read_bytes().startswith(b"id,parent.title\r\n")
    assert run("integrity", "--corpus", root, "--mode", "full") == 0
    assert run("export", "--corpus", root, "--format", "csv", "--out", "x") == 1 and run("count", "--corpus", root, "--start", "2030-01") == 1
    for bad in (["convert", str(next(Path(root, "comments").glob("*.zst"))), "--field", "id", "--out", "x"], ["count", "--corpus", root, "--min-score", "5", "--max-score", "1"]):
        assert main(bad) == 1


def test_truncated_frames_are_noticed(tmp_path):
    c = zstandard.ZstdCompressor(write_checksum=True)
    whole = c.compress(b"a" * 1000) + c.compress(b"b" * 1000)
    at = tmp_path / "f"
    for data, ok in ((whole, True), (whole[:-1], False), (whole[:9], False), (b"", False)):
        at.write_bytes(data)
        assert (integrity.check_file(str(at), None) is None) == ok


def test_plain_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'{"id":"a"}\r\n\n{"id":"b\\r"}\n')
    assert ids(parse(read_jsonl(spark, str(tmp_path / "x.jsonl")))) == ["a", "b\r"]
