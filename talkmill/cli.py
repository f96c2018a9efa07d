"""Command line: python -m talkmill.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill import manifests, resume, session
from talkmill.functions import months
from talkmill.monitor import Monitor
from talkmill.operators import aggregate, analytics, parents, project
from talkmill.plans.query import Query, parse_predicate, read_ids
from talkmill.sinks import files as sinks
from talkmill.sources import integrity
from talkmill.sources.lines import read_jsonl, read_lines
from talkmill.sources.listing import Archive
from talkmill.sources.records import malformed_line, parse, scan

KINDS = {"comments": ("comment",), "submissions": ("submission",), "both": ("comment", "submission")}


def spark_session(args: argparse.Namespace) -> SparkSession:
    b = SparkSession.builder.appName("talkmill").config("spark.ui.showConsoleProgress", "false")
    if args.master:
        b = b.master(args.master)
    return session.prepare(b.getOrCreate())


def query_of(a: argparse.Namespace) -> Query:
    many = lambda x: tuple(x) if x else None
    ids = [*(a.id or []), *[i for f in a.ids_file or [] for i in read_ids(f)]]
    return Query(
        subreddits=many(a.subreddit), ids=many(ids), authors=many(a.author), exclude_authors=many(a.exclude_author), exclude_common_bots=a.exclude_common_bots, include_pseudo_users=a.include_pseudo_users,
        author_regex=a.author_regex, min_score=a.min_score, max_score=a.max_score, after=a.after, before=a.before, start_month=a.start, end_month=a.end, keywords_any=many(a.keyword),
        keywords_all=many(a.keyword_all), exclude_keywords=many(a.exclude_keyword), text_regex=a.text_regex, contains_url=a.contains_url, no_url=a.no_url, domains=many(a.domain), json=tuple(a.json or ()),
    ).build()


def warn_of_all(q: Query) -> None:
    if q.unfiltered() and not q.start_month and not q.end_month:
        print("warning: no filter and no date range: the whole corpus is read", file=sys.stderr)


def records_of(spark: SparkSession, a: argparse.Namespace, blank: str = "skip") -> DataFrame:
    q = query_of(a)
    warn_of_all(q)
    if getattr(a, "checkpoint", None):
        if a.allow_partial:
            raise ValueError("--checkpoint keeps whole months, --allow-partial doesn't")
        records, fresh = resume.checkpointed_scan(spark, Archive.at(a.corpus), q, a.checkpoint, KINDS[a.source], blank)
        print(f"{fresh} months scanned", file=sys.stderr)
        return records
    return scan(spark, Archive.at(a.corpus), q, KINDS[a.source], getattr(a, "allow_partial", False), blank)


def expected_or_fail(a: argparse.Namespace) -> None:
    """Before a run: what --expected names has to be there."""
    if getattr(a, "expected", None):
        bad = manifests.preflight(Archive.at(a.corpus), a.expected, False, KINDS[a.source], a.start, a.end)
        if bad:
            raise ValueError("the corpus isn't as expected: " + "; ".join(bad))


def note(a: argparse.Namespace, options: dict, counts: dict[str, int] | None = None, upstream: list[str] = ()) -> None:
    """The manifest beside an output file."""
    if a.out != "-":
        q = query_of(a) if hasattr(a, "subreddit") else None
        jobs = Archive.at(a.corpus).plan(tuple(k for k in KINDS[a.source] if k in q.kinds()), *q.month_range()) if q else []
        manifests.run_manifest(a.out, q, {"command": a.command} | options, jobs, counts or {}, upstream=upstream)


def out(df: DataFrame, columns: list[str], path: str, order: list[str]) -> None:
    """TSV to a file, or streamed to standard output."""
    if path != "-":
        sinks.write_pairs_tsv(df, path, columns, order)
        return
    for r in df.orderBy(*order).toLocalIterator():
        print("\t".join(str(r[c]) for c in columns))


def emit(df: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """Rows as JSON lines, a JSON array or TSV."""
    rows = [r.asDict() for r in df.toLocalIterator()]
    text = json.dumps(rows, default=str, ensure_ascii=False) if fmt == "json" else "\n".join(("\t".join("" if v is None else str(v) for v in r.values()) if fmt == "tsv" else json.dumps(r, default=str, ensure_ascii=False)) for r in rows)
    if path == "-":
        print(text)
    else:
        with sinks.atomic(path) as tmp:
            tmp.write_text(text + "\n")


def describe(a: argparse.Namespace) -> int:
    if a.expected:
        for r in manifests.corpus_plan(Archive.at(a.corpus), json.loads(Path(a.expected).read_text())):
            print("\t".join(str(r[k]) for k in ("source", "month", "state")))
    for row in Archive.at(a.corpus).describe():
        print("\t".join(str(v) for v in row.values()))
    for kind, lacks in Archive.at(a.corpus).missing().items():
        if lacks:
            print(f"{kind} lacks {months.as_ranges(lacks)}")
    return 0


def corpus(a: argparse.Namespace) -> int:
    archive = Archive.at(a.corpus)
    if a.what == "manifest":
        doc: object = manifests.corpus_manifest(archive, a.sha256)
    else:
        doc = manifests.corpus_plan(archive, json.loads(Path(a.expected).read_text()), a.sha256, a.only_missing)
    print(json.dumps(doc, indent=2))
    return 0


def schema(a: argparse.Namespace) -> int:
    spark = spark_session(a)
    jobs = Archive.at(a.corpus).plan(KINDS[a.source], a.start, a.end)
    emit(analytics.schema_profile(read_lines(spark, jobs), a.records), "-", a.format)
    return 0


def sample(a: argparse.Namespace) -> int:
    for r in analytics.sample(records_of(spark_session(a), a).select("value"), a.limit).collect():
        print(r.value)
    return 0


def quickstart(a: argparse.Namespace) -> int:
    make_sample(a.corpus)
    print(f"python -m talkmill.cli count --corpus {a.corpus} --subreddit programming")
    return 0


def make_sample(root: str) -> None:
    """A tiny archive: two months of both kinds."""
    import zstandard

    for month, first in (("2019-12", 1575158400), ("2020-01", 1577836800)):
        for kind, prefix in (("comments", "RC"), ("submissions", "RS")):
            at = Path(root, kind, f"{prefix}_{month}.zst")
            at.parent.mkdir(parents=True, exist_ok=True)
            rows = []
            for k in range(4):
                r = {"id": f"{prefix[1].lower()}{month[-2:]}{k}", "author": ["ana", "bo", "AutoModerator", "[deleted]"][k], "subreddit": ["programming", "rust"][k % 2], "score": k - 1, "created_utc": first + 3600 * k}
                r |= {"body": f"text {k} http://example.com", "parent_id": f"t3_s{month[-2:]}0", "link_id": f"t3_s{month[-2:]}0"} if prefix == "RC" else {"title": f"title {k}", "selftext": "", "url": "https://example.org/x", "domain": "example.org", "is_self": False}
                rows.append(json.dumps(r))
            with sinks.atomic(str(at)) as tmp:
                tmp.write_bytes(zstandard.ZstdCompressor(level=3, write_checksum=True).compress(("\n".join(rows) + "\n").encode()))


def run_scan(a: argparse.Namespace) -> int:
    out(analytics.usernames(records_of(spark_session(a), a, "fail")), ["author"], a.out, ["author"])
    note(a, {})
    return 0


def dedupe(a: argparse.Namespace) -> int:
    records = records_of(spark_session(a), a, "fail")
    s = analytics.key_stats(records, a.key, a.strict_key)
    out(analytics.distinct_keys(records, a.key), ["key"], a.out, ["key"])
    note(a, {"key": a.key}, {"matched": s.matched, "unique": s.unique, "missing": s.missing})
    print(f"{s.matched} records, {s.unique} keys, {s.missing} without" + (": many lack the key" if s.warns else ""), file=sys.stderr)
    return 0


def count(a: argparse.Namespace) -> int:
    records = records_of(spark_session(a), a, "fail")
    if a.mode == "month":
        out(analytics.count_by_month(records), ["month", "n"], a.out, ["month"])
    else:
        out(analytics.author_counts(records), ["author", "n"], a.out, ["author"])
    note(a, {"mode": a.mode})
    return 0


def first_seen(a: argparse.Namespace) -> int:
    out(analytics.first_seen(records_of(spark_session(a), a, "fail")), ["author", "first_seen"], a.out, ["author"])
    note(a, {})
    return 0


def checked_export(a: argparse.Namespace) -> None:
    """Options that the format doesn't know are errors."""
    table = a.format in ("csv", "tsv")
    wrong = [
        ("tables need --field and take no --human-timestamps", table and (a.human_timestamps or not a.field)),
        ("--field and --no-header go with tables", not table and (a.field or a.no_header)),
        ("--zstd-level goes with --format zst", a.zstd_level is not None and a.format != "zst"),
        ("a zstd level is 1 to 22", a.zstd_level is not None and not 1 <= a.zstd_level <= 22),
        ("--codec and --row-group-rows go with --format parquet", a.format != "parquet" and (a.codec or a.row_group_rows is not None)),
        ("--row-group-rows is at least 1", a.row_group_rows is not None and a.row_group_rows < 1),
        ("parquet has fixed columns", a.format.endswith("parquet") and (a.human_timestamps or a.whitelist)),
        ("--resume goes with jsonl, json, spool, zst and partitioned-jsonl", a.resume and a.format not in ("jsonl", "json", "json-pretty", "spool", "zst", "partitioned-jsonl")),
        ("--resume takes no --limit", a.resume and a.limit is not None),
        ("--limit isn't negative", a.limit is not None and a.limit < 0),
        ("--strict-whitelist needs --whitelist", a.strict_whitelist and not a.whitelist),
    ]
    for what, is_so in wrong:
        if is_so:
            raise ValueError(what)


def export(a: argparse.Namespace) -> int:
    checked_export(a)
    spark, archive, q = spark_session(a), Archive.at(a.corpus), query_of(a)
    warn_of_all(q)
    if a.resume:
        options = {"whitelist": a.whitelist, "human_timestamps": a.human_timestamps}
        rewrite = (lambda r: r.withColumn("value", project.rewritten(F.col("value"), a.whitelist, a.human_timestamps))) if a.whitelist or a.human_timestamps else None
        kinds = KINDS[a.source]
        if a.format == "spool":
            _, n = manifests.resumed_spool(spark, archive, q, a.out, options, a.allow_partial, rewrite, kinds)
        elif a.format in ("zst", "partitioned-jsonl"):
            _, n = resume.resumed_partitioned(spark, archive, q, a.out, a.format.removeprefix("partitioned-"), a.zstd_level or 7, options, rewrite, kinds)
        else:
            n = resume.resumed_file(spark, archive, q, a.out, a.format, options, a.allow_partial, rewrite, kinds)
        print(f"{n} records", file=sys.stderr)
        return 0
    jobs = archive.plan(tuple(k for k in KINDS[a.source] if k in q.kinds()), *q.month_range())
    warnings = []
    if a.allow_partial:  # an export drops a damaged month whole
        jobs, report = integrity.sound(spark, jobs)
        warnings = [f"left out {p}: {e}" for p, e in report.failures]
    records = q.apply(parse(read_lines(spark, jobs)))
    if a.whitelist:
        lacks = project.unmatched_fields(records, a.whitelist)
        if lacks and a.strict_whitelist:
            raise ValueError(f"no record has {', '.join(lacks)}")
        warnings += [f"no record has {f}" for f in lacks]
    if a.whitelist or a.human_timestamps:
        records = records.withColumn("value", project.rewritten(F.col("value"), a.whitelist, a.human_timestamps))
    if a.limit is not None:
        records = records.orderBy("kind", "file_month", "ordinal").limit(a.limit)
    if a.format == "jsonl":
        sinks.write_jsonl(records, a.out)
    elif a.format in ("json", "json-pretty"):
        sinks.write_json(records, a.out, a.format == "json-pretty")
    elif a.format in ("csv", "tsv"):
        sinks.write_table(records, a.out, a.field, a.format == "tsv", not a.no_header)
    elif a.format == "parquet":
        sinks.write_parquet(records, a.out, a.codec or "zstd", row_group_rows=a.row_group_rows)
    elif a.format == "spool":
        sinks.export_spool(records, a.out, [(j.kind, j.month) for j in jobs])
    else:
        sinks.export_partitioned(records, a.out, a.format.removeprefix("partitioned-"), a.zstd_level or 7)
    manifests.run_manifest(a.out.rstrip("/"), q, {"format": a.format, "whitelist": a.whitelist, "human_timestamps": a.human_timestamps, "limit": a.limit}, jobs, {}, warnings)
    for w in warnings:
        print(w, file=sys.stderr)
    return 0


def convert(a: argparse.Namespace) -> int:
    for p in a.input:
        with open(p, "rb") as f:
            if p.endswith(".zst") or f.read(4) == b"\x28\xb5\x2f\xfd":
                raise ValueError(f"{p} is compressed; export reads archives")
    lines = read_jsonl(spark_session(a), a.input).where(F.trim("value") != "").withColumn("j", F.try_parse_json("value"))
    sinks.write_table(lines, a.out, a.field, a.format == "tsv", not a.no_header)
    return 0


def sound_inputs(lines: DataFrame, strict: bool, merge_partial: bool) -> DataFrame:
    """The lines that count: inputs with a malformed line are left out unless merge_partial, and then give the lines that are JSON; the report goes to standard error."""
    bad = (F.trim("value") != "") & F.try_parse_json("value").isNull()
    files = lines.groupBy("file_path").agg(F.count_if(F.trim("value") != "").alias("n"), F.count_if(bad).alias("bad")).orderBy("file_path").collect()  # a row an input
    partial = [f.file_path for f in files if f.bad and f.bad < f.n]
    fatal = [f.file_path for f in files if f.bad and f.bad == f.n]
    print(f"{len(files) - len(partial) - len(fatal)} whole inputs, {len(partial)} partial, {len(fatal)} fatal", file=sys.stderr)
    if strict and (partial or fatal):
        raise ValueError("malformed JSON in " + ", ".join(partial + fatal))
    if not any(f.n > f.bad for f in files):
        print("warning: no input has a record", file=sys.stderr)
    drop = fatal if merge_partial else partial + fatal
    return lines.where(~F.col("file_path").isin(drop) & ~bad) if drop or partial else lines


def run_aggregate(a: argparse.Namespace) -> int:
    spark = spark_session(a)
    lines = sound_inputs(read_jsonl(spark, a.input), a.strict, a.merge_partial)
    records = parse(lines, repeated="keep")
    if a.agg:
        df = aggregate.aggregate(records, a.group_by or "", a.agg)
    else:
        df = aggregate.rollup(records, a.by, a.metric, a.top)
        if a.by is not None:
            df = aggregate.shown(df, a.metric, a.scientific)
    emit(df, a.out, a.format)
    if a.out != "-":
        manifests.run_manifest(a.out, None, {"command": "aggregate", "by": a.by, "metric": a.metric, "agg": a.agg, "group_by": a.group_by, "inputs": [manifests.file_identity(p) for p in a.input]}, [], {}, upstream=a.input)
    return 0


def run_parents(a: argparse.Namespace) -> int:
    spark, archive = spark_session(a), Archive.at(a.corpus)
    fields = a.field or None
    if a.id or a.ids_file:
        ids = [*(a.id or []), *[i for f in a.ids_file or [] for i in read_ids(f)]]
        corpus_ = parse(read_lines(spark, archive.plan(start=a.start, end=a.end)))
        emit(parents.direct(corpus_, ids, fields, a.full), a.out)
        return 0
    parts = sinks.spool_parts(a.spool)
    start, end = months.window([m for _, m, _ in parts], a.window_months)
    jobs = archive.plan(start=start, end=end)
    options = {"command": "parents", "fields": fields, "full": a.full, "window": a.window_months, "spool": [manifests.file_identity(p) for _, _, p in parts]}
    mark = manifests.fingerprint(None, options, jobs)
    if a.resume and resume.output_is_current(a.out, mark):
        print("nothing to do", file=sys.stderr)
        return 0
    children = parse(read_jsonl(spark, [p for _, _, p in parts]).withColumns({"kind": F.lit("comment"), "file_month": F.lit(None).cast("string")}))
    find = lambda: parents.resolve(parse(read_lines(spark, jobs)), parents.collect_parent_ids(children), fields, a.full)
    found = resume.kept_parents(children, a.cache, mark, find)[0] if a.cache else find()
    got = parents.attach(children, found)
    sinks.write_jsonl(parents.attached_json(got).select("value", "file_path"), a.out, ("file_path",))
    stats = parents.attach_stats(got)
    manifests.run_manifest(a.out, None, options, jobs, stats | {"bytes": Path(a.out).stat().st_size}, parents.warnings(stats), upstream=[p for _, _, p in parts])
    print(stats, *parents.warnings(stats), file=sys.stderr)
    return 0


def run_integrity(a: argparse.Namespace) -> int:
    report = integrity.check(spark_session(a), Archive.at(a.corpus).plan(KINDS[a.source], a.start, a.end), a.mode, a.bytes, lambda p, e: print(f"{p}\t{e}"))
    print(f"{report.checked} files, {len(report.failures) + report.dropped} damaged", file=sys.stderr)
    return report.exit_code


def load(a: argparse.Namespace) -> int:
    sinks.load_table(spark_session(a).read.parquet(a.input), a.table, a.view, a.if_exists)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="talkmill")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, fn, *aliases: str, corpus: bool = True, query: bool = False) -> argparse.ArgumentParser:
        s = sub.add_parser(name, aliases=aliases)
        s.set_defaults(run=fn)
        s.add_argument("--master")
        if corpus:
            s.add_argument("--corpus", required=True)
            s.add_argument("--source", choices=list(KINDS), default="both")
            s.add_argument("--start", type=months.parse_month)
            s.add_argument("--end", type=months.parse_month)
        if query:
            for o in ("subreddit", "author", "exclude-author", "keyword", "keyword-all", "exclude-keyword", "domain", "id", "ids-file"):
                s.add_argument(f"--{o}", action="append")
            for o in ("author-regex", "text-regex"):
                s.add_argument(f"--{o}")
            for o in ("min-score", "max-score"):
                s.add_argument(f"--{o}", type=int)
            for o in ("after", "before"):
                s.add_argument(f"--{o}", type=months.parse_time)
            for o in ("exclude-common-bots", "include-pseudo-users", "contains-url", "no-url", "allow-partial"):
                s.add_argument(f"--{o}", action="store_true")
            s.add_argument("--json", action="append", type=parse_predicate)
        if corpus:
            s.add_argument("--expected")
        for o in ("events", "status-file", "stop-file"):
            s.add_argument(f"--{o}")
        s.add_argument("--max-rss-mb", type=int)
        s.add_argument("--max-runtime", type=float)
        return s

    add("describe", describe, "ls")
    s = add("corpus", corpus)
    s.add_argument("what", choices=["plan", "manifest"])
    s.add_argument("--sha256", action="store_true")
    s.add_argument("--only-missing", action="store_true")
    s = add("schema", schema)
    s.add_argument("--records", type=int, default=100)
    s.add_argument("--format", choices=["tsv", "json"], default="tsv")
    s = add("sample", sample, "preview", "head", query=True)
    s.add_argument("--limit", type=int, default=10)
    add("quickstart", quickstart, "demo")
    s = add("scan", run_scan, query=True)
    s.add_argument("--checkpoint")
    s.add_argument("--out", default="-")
    s = add("dedupe", dedupe, "unique", "distinct", query=True)
    s.add_argument("--checkpoint")
    s.add_argument("--key", default="author")
    s.add_argument("--strict-key", action="store_true")
    s.add_argument("--out", default="-")
    s = add("count", count, query=True)
    s.add_argument("--checkpoint")
    s.add_argument("--mode", choices=["month", "author"], default="month")
    s.add_argument("--out", default="-")
    s = add("first-seen", first_seen, query=True)
    s.add_argument("--checkpoint")
    s.add_argument("--out", default="-")
    s = add("export", export, query=True)
    s.add_argument("--format", choices=["jsonl", "json", "json-pretty", "csv", "tsv", "parquet", "spool", "zst", "partitioned-jsonl", "partitioned-parquet"], default="jsonl")
    s.add_argument("--out", required=True)
    s.add_argument("--whitelist", action="append")
    s.add_argument("--strict-whitelist", action="store_true")
    s.add_argument("--human-timestamps", action="store_true")
    s.add_argument("--field", action="append")
    s.add_argument("--no-header", action="store_true")
    s.add_argument("--limit", "--head", type=int)
    s.add_argument("--zstd-level", type=int)
    s.add_argument("--codec")
    s.add_argument("--row-group-rows", type=int)
    s.add_argument("--resume", action="store_true")
    s = add("convert", convert, corpus=False)
    s.add_argument("input", nargs="+")
    s.add_argument("--format", choices=["csv", "tsv"], default="csv")
    s.add_argument("--field", action="append", required=True)
    s.add_argument("--no-header", action="store_true")
    s.add_argument("--out", required=True)
    s = add("aggregate", run_aggregate, corpus=False)
    s.add_argument("input", nargs="+")
    s.add_argument("--by")
    s.add_argument("--metric", default="count")
    s.add_argument("--top", type=int)
    s.add_argument("--group-by")
    s.add_argument("--agg")
    for o in ("scientific", "strict", "merge-partial"):
        s.add_argument(f"--{o}", action="store_true")
    s.add_argument("--format", choices=["tsv", "jsonl", "json"], default="jsonl")
    s.add_argument("--out", default="-")
    s = add("parents", run_parents)
    s.add_argument("--spool")
    s.add_argument("--id", action="append")
    s.add_argument("--ids-file", action="append")
    s.add_argument("--field", action="append")
    s.add_argument("--full", action="store_true")
    s.add_argument("--window-months", type=int, default=3)
    s.add_argument("--resume", action="store_true")
    s.add_argument("--cache")
    s.add_argument("--out", default="-")
    s = add("integrity", run_integrity)
    s.add_argument("--mode", choices=["quick", "full"], default="quick")
    s.add_argument("--bytes", type=int, default=integrity.QUICK_BYTES)
    s = add("load", load, corpus=False)
    s.add_argument("input")
    s.add_argument("--table", required=True)
    s.add_argument("--view", action="store_true")
    s.add_argument("--if-exists", choices=["fail", "replace", "append"], default="fail")
    return p


def monitored(a: argparse.Namespace) -> int:
    """Runs the command, under a monitor if a monitoring option is given."""
    if not any((a.events, a.status_file, a.stop_file, a.max_rss_mb, a.max_runtime)):
        return a.run(a)
    with Monitor(spark_session(a), a.events, a.status_file, a.max_rss_mb, a.max_runtime, a.stop_file) as m:
        code = a.run(a)
    return m.exit_code if m.reason else code


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if getattr(args, "out", "-") != "-":
            sinks.sweep(str(Path(args.out).parent))
        if args.command not in ("corpus", "describe", "ls"):
            expected_or_fail(args)
        return monitored(args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except PySparkException as e:
        at = re.search(r"malformed JSON in (\S+)", str(e))
        path = at and re.sub(r"^file:/+", "/", at[1])
        if not path or not Path(path).exists():
            raise
        print(f"error: malformed JSON in {path}, line {malformed_line(path)}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
