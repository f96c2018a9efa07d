"""Runs that go on where they stopped, preflight, monitoring, build reports, texts of numbers, and warnings."""

import json
from pathlib import Path

import corpora as C
import pyarrow.parquet as pq
import pytest

from talkmill import manifests, resume
from talkmill.cli import main
from talkmill.operators import aggregate, analytics
from talkmill.operators.samples import SumOfScores
from talkmill.plans.query import Query
from talkmill.sinks import files as sinks
from talkmill.sources.lines import read_jsonl, read_lines
from talkmill.sources.listing import Archive
from talkmill.sources.records import malformed_line, parse, scan
from talkmill.streaming.ingest import ingest


@pytest.fixture
def archive(tmp_path):
    return Archive.at(str(C.basic(tmp_path / "in")))


ALL = Query(include_pseudo_users=True)


def test_scan_checkpoints_are_shared_and_checked(spark, archive, tmp_path):
    run = lambda q=ALL: resume.checkpointed_scan(spark, archive, q, str(tmp_path / "cp"))
    want = sorted(r.id for r in scan(spark, archive, ALL).collect())
    records, fresh = run()
    assert fresh == 3 and sorted(r.id for r in records.collect()) == want
    records, fresh = run()
    assert fresh == 0 and sorted(r.id for r in records.collect()) == want
    assert analytics.count_by_month(records).collect() == analytics.count_by_month(scan(spark, archive, ALL)).collect()
    part = next(Path(tmp_path).glob("cp/scan_checkpoints/*/RC_2006-01/*.parquet"))
    part.write_bytes(b"no parquet")
    records, fresh = run()
    assert fresh == 1 and sorted(r.id for r in records.collect()) == want
    assert run(Query(subreddits=("rust",)))[1] == 3
    C.write(tmp_path / "in", "RC_2006-02", [C.comment("c9", created=C.FEB06)])
    assert run()[1] == 3  # the files have changed
    assert run(Query(subreddits=("nowhere",)))[0].count() == 0 == run(Query(subreddits=("nowhere",)))[1]


@pytest.mark.parametrize("fmt", ["jsonl", "json"])
def test_export_goes_on_with_its_parts(spark, archive, tmp_path, fmt, monkeypatch):
    out = str(tmp_path / f"out.{fmt}")
    plain = str(tmp_path / f"plain.{fmt}")
    (sinks.write_jsonl if fmt == "jsonl" else sinks.write_json)(ALL.build().apply(parse(read_lines(spark, archive.plan()))), plain)

    def stopped(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(sinks, "join_lines", stopped)
        m.setattr(sinks, "join_array", stopped)
        with pytest.raises(OSError, match="stopped"):
            resume.resumed_file(spark, archive, ALL, out, fmt)
    assert len(list(Path(f"{out}.parts").glob("part_*.jsonl"))) == 3 and not Path(out).exists()
    Path(f"{out}.parts/part_RC_2006-02.jsonl").write_text("cut")
    seen = []
    real = read_lines
    monkeypatch.setattr("talkmill.sources.lines.read_lines", lambda s, jobs, *a: seen.append([j.month for j in jobs]) or real(s, jobs, *a))
    assert resume.resumed_file(spark, archive, ALL, out, fmt) == 7
    assert seen == [["2006-02"]]
    assert Path(out).read_bytes() == Path(plain).read_bytes() and not Path(f"{out}.parts").exists()


def test_partitioned_export_goes_on(spark, archive, tmp_path):
    out = str(tmp_path / "arc")
    assert resume.resumed_partitioned(spark, archive, ALL, out) == (3, 7)
    assert resume.resumed_partitioned(spark, archive, ALL, out) == (0, 7)
    at = Path(out, "comments", "RC_2006-01.zst")
    raw = bytearray(at.read_bytes())
    raw[-1] ^= 1  # same size, wrong checksum
    at.write_bytes(bytes(raw))
    assert resume.resumed_partitioned(spark, archive, ALL, out) == (1, 7)
    assert sorted(r.id for r in scan(spark, Archive.at(out), ALL).collect()) == ["c1", "c2", "c3", "c4", "c5", "s1", "s2"]
    assert resume.resumed_partitioned(spark, archive, Query(subreddits=("rust",)), out) == (3, 1)
    assert [p.name for p in Path(out).rglob("*.zst")] == ["RC_2006-02.zst"]
    assert resume.resumed_partitioned(spark, archive, Query(subreddits=("rust",)), out) == (0, 1)


def test_parents_go_on(spark, archive, tmp_path, capsys):
    root, sp, out = archive.root if hasattr(archive, "root") else str(tmp_path / "in"), f"{tmp_path}/sp", f"{tmp_path}/p.jsonl"
    assert main(["export", "--corpus", root, "--format", "spool", "--resume", "--out", sp, "--source", "comments", "--include-pseudo-users"]) == 0
    run = lambda *more: main(["parents", "--corpus", root, "--spool", sp, "--out", out, "--resume", "--cache", f"{tmp_path}/cache", *more])
    assert run() == 0
    first = Path(out).read_text()
    assert "a title" in first
    capsys.readouterr()
    assert run() == 0 and "nothing to do" in capsys.readouterr().err
    Path(out).write_text("cut")
    kept = {p: p.stat().st_mtime_ns for p in Path(tmp_path, "cache").rglob("*.parquet")}
    assert run() == 0 and Path(out).read_text() == first
    assert kept == {p: p.stat().st_mtime_ns for p in Path(tmp_path, "cache").rglob("*.parquet")}
    assert run("--field", "title") == 0 and set(kept).isdisjoint(Path(tmp_path, "cache").rglob("*.parquet"))
    doc = json.loads(Path(f"{out}.manifest.json").read_text())
    assert doc["counts"]["resolved"] == 5 and len(doc["upstream"]) == 2


def test_expected_manifests_are_checked_before_a_run(archive, tmp_path, capsys):
    root, at = str(tmp_path / "in"), tmp_path / "expected.json"
    at.write_text(json.dumps(manifests.corpus_manifest(archive)))
    run = lambda *a: main([*a, "--corpus", root, "--expected", str(at)])
    assert run("count", "--subreddit", "programming") == 0 and run("integrity") == 0
    (tmp_path / "in" / "comments" / "RC_2006-02.zst").unlink()
    capsys.readouterr()
    assert run("count") == 1 and run("integrity") == 1
    assert "comment 2006-02: missing" in capsys.readouterr().err
    assert run("count", "--end", "2006-01") == 0 and run("count", "--source", "submissions") == 0
    assert run("describe") == 0 and "comment\t2006-02\tmissing" in capsys.readouterr().out


def test_monitoring_from_the_command_line(archive, tmp_path):
    root, events = str(tmp_path / "in"), tmp_path / "events.jsonl"
    assert main(["count", "--corpus", root, "--events", str(events), "--max-runtime", "600"]) == 0
    assert [json.loads(x)["event"] for x in events.read_text().splitlines()] == ["started", "ended"]
    stop = tmp_path / "stop"
    stop.write_text("")
    assert main(["count", "--corpus", root, "--stop-file", str(stop), "--status-file", str(tmp_path / "status.json")]) in (0, 1)


def test_manifests_of_runs(archive, tmp_path):
    root = str(tmp_path / "in")
    for name, *args in (("scan",), ("dedupe", "--key", "subreddit"), ("count", "--mode", "author"), ("first-seen", "--checkpoint", str(tmp_path / "cp"))):
        out = f"{tmp_path}/{name}.tsv"
        assert main([name, *args, "--corpus", root, "--out", out]) == 0
        doc = json.loads(Path(f"{out}.manifest.json").read_text())
        assert doc["options"]["command"] == name and len(doc["files"]) == 3


def test_build_reports(spark, tmp_path):
    row = lambda n: json.dumps({"score": n}) + "\n"
    whole, part, junk = (tmp_path / n for n in ("a.jsonl", "b.jsonl", "c.jsonl"))
    whole.write_text(row(1) + "\n" + row(2) + "[1]\n")
    part.write_text(row(10) + "{no\n" + row(100))
    junk.write_text("junk\n" + row(1000))
    paths = [str(p) for p in (whole, part, junk, tmp_path / "none.jsonl")]
    build = lambda **k: aggregate.build_aggregate(spark, paths, SumOfScores, SumOfScores.from_json, **k)
    got, report = build()
    assert (got.total, got.records, report.merged, report.records) == (3, 2, 1, 2)
    assert [p for p, _ in report.partial] == [str(part)] and "line 2" in report.partial[0][1] and len(report.fatal) == 2 and report.ok == [str(whole)]
    got, report = build(merge_partial=True)
    assert (got.total, report.merged, report.records) == (13, 2, 3)
    with pytest.raises(aggregate.AggregateError, match="b.jsonl"):
        build(strict=True)
    _, report = aggregate.build_aggregate(spark, [str(junk)], SumOfScores, SumOfScores.from_json)
    assert report.warnings == ["no input has a record"]
    run = lambda *a: main(["aggregate", str(whole), str(part), "--metric", "sum:/score", "--by", "json:/score", *a, "--out", f"{tmp_path}/o.jsonl"])
    keys = lambda: [json.loads(x)["key"] for x in (tmp_path / "o.jsonl").read_text().splitlines()]
    assert run() == 0 and keys() == ["1", "2"]
    assert run("--merge-partial") == 0 and keys() == ["1", "10", "100", "2"]
    assert run("--strict") == 1


def test_texts_of_numbers_in_the_output(tmp_path):
    at = tmp_path / "in.jsonl"
    at.write_text("".join(json.dumps(r) + "\n" for r in ({"author": "a", "n": 1}, {"author": "a", "n": 1}, {"author": "a", "n": 2}, {"author": "b", "n": 1e-7}, {"author": "c", "n": -0.0}, {"author": "d", "n": 10**20})))
    run = lambda *a: main(["aggregate", str(at), "--by", "author", *a, "--out", f"{tmp_path}/o.jsonl"]) or {r["key"]: r["value"] for r in map(json.loads, (tmp_path / "o.jsonl").read_text().splitlines())}
    got = run("--metric", "avg:/n")
    assert got["a"] == "1.333333333333333333" and got["b"] == "0.0000001" and got["d"] == "1" + "0" * 20
    assert run("--metric", "sum:/n")["a"] == "4" and run("--metric", "avg:/n", "--scientific")["b"] == "1e-07"


def test_warnings_and_errors_say_where(archive, tmp_path, capsys):
    root = str(tmp_path / "in")
    assert main(["count", "--corpus", root]) == 0 and "whole corpus" in capsys.readouterr().err
    assert main(["count", "--corpus", root, "--start", "2006-01"]) == 0 and "whole corpus" not in capsys.readouterr().err
    bad = C.write(tmp_path / "in", "RC_2006-03", [C.comment("x"), C.comment("y"), "{oops", C.comment("z")])
    assert malformed_line(str(bad)) == 3
    assert main(["count", "--corpus", root, "--start", "2006-03"]) == 1
    assert f"{bad}, line 3" in capsys.readouterr().err


def test_flags_that_do_not_fit_are_errors(archive, tmp_path):
    root = str(tmp_path / "in")
    for flags in (["--field", "id"], ["--codec", "zstd"], ["--row-group-rows", "5"], ["--zstd-level", "3"], ["--resume", "--limit", "2"], ["--strict-whitelist"], ["--format", "parquet", "--resume"], ["--format", "zst", "--zstd-level", "40"]):
        assert main(["export", "--corpus", root, "--out", f"{tmp_path}/x", *flags]) == 1


def test_row_groups_by_rows(spark, tmp_path):
    records = parse(spark.createDataFrame([(json.dumps(C.comment(f"c{k}")), "comment", None) for k in range(1000)], "value string, kind string, file_month string").coalesce(1))
    sinks.write_parquet(records, str(tmp_path / "p"), row_group_rows=300)
    meta = pq.read_metadata(next(Path(tmp_path, "p").glob("*.parquet")))
    assert max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 300


def test_stale_files_are_swept(archive, tmp_path):
    old = tmp_path / ".x.jsonl.999999999.inprogress"
    old.write_text("")
    assert main(["scan", "--corpus", str(tmp_path / "in"), "--out", str(tmp_path / "names.tsv")]) == 0 and not old.exists()


def test_stream_ingest_keeps_long_lists(spark, tmp_path):
    C.basic(tmp_path / "in")
    for n, want in ((500, []), (501, [])):
        q = Query(ids=tuple(f"t1_zz{k}" for k in range(n)))
        ingest(spark, str(tmp_path / "in"), str(tmp_path / f"out{n}"), str(tmp_path / f"cp{n}"), q).awaitTermination()
        assert [r.id for r in spark.read.schema("id string").parquet(str(tmp_path / f"out{n}")).collect()] == want
    names = tuple(f"nobody{k}" for k in range(600))
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "outx"), str(tmp_path / "cpx"), Query(authors=(*names, "charlie"))).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "outx")).collect()] == ["c2"]
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "outy"), str(tmp_path / "cpy"), Query(exclude_authors=(*names, "charlie"))).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "outy")).collect()) == ["c1", "c4", "c5", "s1", "s2"]


def test_ids_of_a_table(spark, archive):
    ids = spark.createDataFrame([("comment", "c1"), (None, "S1"), ("submission", "c2"), ("comment", "c1")], "kind string, id string")
    assert sorted(r.id for r in Query().build().apply(parse(read_lines(spark, archive.plan())), ids).collect()) == ["c1", "s1"]
    assert read_jsonl is not None
