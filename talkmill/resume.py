"""Runs that go on where an earlier one stopped: scan checkpoints, exports by month, parents.

What is finished is told by a fingerprint over the query, the options and the identities of the files, so a change of any makes it stale.
"""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill import manifests
from talkmill.plans.query import Query
from talkmill.sinks import files as sinks
from talkmill.sources.lines import SCHEMA, read_lines
from talkmill.sources.listing import PREFIX, Archive, FileJob
from talkmill.sources.records import parse

KINDS = ("comment", "submission")


def _jobs(archive: Archive, q: Query, kinds: tuple[str, ...]) -> list[FileJob]:
    return archive.plan(tuple(k for k in kinds if k in q.kinds()), *q.month_range())


def _rows(path: str) -> int:
    """Rows of a Parquet folder by its footers; -1 if one can't be read."""
    import pyarrow.parquet as pq

    try:
        return sum(pq.read_metadata(p).num_rows for p in Path(path).glob("*.parquet"))
    except (OSError, ValueError):
        return -1


def checkpointed_scan(spark: SparkSession, archive: Archive, query: Query, folder: str, kinds: tuple[str, ...] = KINDS, blank: str = "fail") -> tuple[DataFrame, int]:
    """(the matching records, months that had to be scanned): matched lines are kept by kind and month under folder/scan_checkpoints.

    Scans, counts, key and first-seen runs of one query share them. A month whose kept part isn't whole is scanned again.
    """
    q = query.build()
    jobs = _jobs(archive, q, kinds)
    mark = manifests.fingerprint(q, {"blank": blank}, jobs)
    root = Path(folder, "scan_checkpoints", mark[:16])
    progress = manifests.Progress.load(str(root / "_progress.json"), mark)
    part = lambda j: str(root / progress.key(j))
    todo = [j for j in jobs if (m := progress.months.get(progress.key(j))) is None or m["lines"] != (_rows(part(j)) if m["lines"] else 0)]
    if todo:
        staging = str(root / f"staging-{uuid.uuid4().hex}")
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        q.apply(parse(read_lines(spark, todo), blank=blank)).select(*columns, F.col("kind").alias("__kind"), F.col("file_month").alias("__month")).write.option("compression", "zstd").partitionBy("__kind", "__month").parquet(staging)
        for j in todo:
            src, at = Path(staging, f"__kind={j.kind}", f"__month={j.month}"), part(j)
            shutil.rmtree(at, ignore_errors=True)
            if src.exists():
                os.replace(src, at)
            progress.note(j, _rows(at) if src.parent.exists() and Path(at).exists() else 0)
        shutil.rmtree(staging, ignore_errors=True)
    there = [part(j) for j in jobs if progress.months[progress.key(j)]["lines"]]
    lines = spark.read.schema(SCHEMA).parquet(*there) if there else spark.createDataFrame([], SCHEMA)
    return parse(lines, blank=blank), len(todo)


def resumed_file(spark: SparkSession, archive: Archive, query: Query, path: str, fmt: str = "jsonl", options: dict[str, Any] | None = None, partial: bool = False, rewrite=None, kinds: tuple[str, ...] = KINDS) -> int:
    """One JSONL or JSON file made of parts by month in path.parts; finished parts are kept until the file is whole. Returns its lines."""
    if fmt not in ("jsonl", "json", "json-pretty"):
        raise ValueError(f"no parts for {fmt!r}")
    folder = f"{path}.parts"
    parts, n = manifests.resumed_spool(spark, archive, query, folder, options, partial, rewrite, kinds)
    parts.sort(key=lambda p: (Path(p).name[5:7] != "RC", Path(p).name))
    if fmt == "jsonl":
        sinks.join_lines([Path(p) for p in parts], path)
    else:
        sinks.join_array([Path(p) for p in parts], path, fmt == "json-pretty")
    shutil.rmtree(folder)
    return n


def _whole(path: Path) -> bool:
    """Whether a zstd file decodes to its end, checksums included."""
    from talkmill.sources.integrity import check_file

    return path.exists() and check_file(str(path), None) is None


def resumed_partitioned(spark: SparkSession, archive: Archive, query: Query, folder: str, fmt: str = "zst", level: int = 7, options: dict[str, Any] | None = None, rewrite=None, kinds: tuple[str, ...] = KINDS) -> tuple[int, int]:
    """An archive of the matching records whose finished months are kept. Returns (months written now, records of all months).

    A kept zst month must have its size and decode to the end, a kept JSONL month its size; a month without records has no file.
    """
    if fmt not in ("zst", "jsonl"):
        raise ValueError(f"no months for {fmt!r}")
    q = query.build()
    jobs = _jobs(archive, q, kinds)
    progress = manifests.Progress.load(f"{folder}/_progress.json", manifests.fingerprint(q, {"format": fmt, "level": level} | (options or {}), jobs))
    at = lambda j: Path(folder, "comments" if j.kind == "comment" else "submissions", f"{PREFIX[j.kind]}_{j.month}.{fmt}")

    def kept(j: FileJob) -> bool:
        m = progress.months.get(progress.key(j))
        if m is None:
            return False
        return not at(j).exists() if not m["lines"] else at(j).exists() and at(j).stat().st_size == m["size"] and (fmt != "zst" or _whole(at(j)))

    todo = [j for j in jobs if not kept(j)]
    if todo:
        records = q.apply(parse(read_lines(spark, todo)))
        for j in todo:
            at(j).unlink(missing_ok=True)
        done = sinks.export_partitioned(rewrite(records) if rewrite else records, folder, fmt, level, owned=False)
        for j in todo:
            progress.note(j, done.get(f"{at(j).parent.name}/{at(j).name}", 0), at(j).stat().st_size if at(j).exists() else 0)
    return len(todo), sum(progress.months[progress.key(j)]["lines"] for j in jobs)


def kept_parents(records: DataFrame, folder: str, mark: str, make) -> tuple[DataFrame, bool]:
    """(resolved parents, were they kept): the payloads under folder/parents/<fingerprint>, made by make() if not there as a whole.

    Those of other fingerprints are out of date and go.
    """
    root = Path(folder, "parents")
    at = root / mark[:16]
    spark = records.sparkSession
    there = (at / "_SUCCESS").exists()
    if not there:
        shutil.rmtree(root, ignore_errors=True)
        make().write.option("compression", "zstd").parquet(str(at))
    return spark.read.schema("kind string, id string, file_month string, payload string").parquet(str(at)), there


def output_is_current(path: str, mark: str) -> bool:
    """Whether an output has its recorded size and a manifest of this fingerprint."""
    import json

    doc, out = Path(f"{path}.manifest.json"), Path(path)
    if not doc.exists() or not out.exists():
        return False
    try:
        got = json.loads(doc.read_text())
    except ValueError:
        return False
    return got.get("fingerprint") == mark and got.get("counts", {}).get("bytes") == out.stat().st_size
