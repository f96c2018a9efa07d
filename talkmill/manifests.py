"""Provenance and resume: fingerprints, run sidecars, progress of monthly outputs, expected corpora."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from talkmill.functions import months
from talkmill.sinks.files import atomic
from talkmill.sources.listing import PREFIX, Archive, FileJob


def file_identity(path: str) -> dict[str, Any]:
    s = Path(path).stat()
    return {"path": str(path), "size": s.st_size, "mtime_ns": s.st_mtime_ns}


def _plain(x: Any) -> Any:
    if dataclasses.is_dataclass(x):
        return {f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x) if f.compare}
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    return {k: _plain(v) for k, v in x.items()} if isinstance(x, dict) else x


def fingerprint(query: Any, options: dict[str, Any], jobs: list[FileJob]) -> str:
    """Of a query, the output's options and the identities of its files: any change makes earlier parts stale."""
    doc = {"query": _plain(query), "options": options, "files": [file_identity(j.path) for j in jobs]}
    return hashlib.sha256(json.dumps(doc, sort_keys=True, default=str).encode()).hexdigest()


def sha256_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_doc(doc: dict[str, Any], path: str) -> None:
    with atomic(path) as tmp:
        tmp.write_text(json.dumps(doc, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")


def preflight(archive: Archive, expected: str, digests: bool = False, kinds: tuple[str, ...] = ("comment", "submission"), start: str | None = None, end: str | None = None) -> list[str]:
    """What an expected manifest names in the range and the archive lacks or has otherwise, a line each."""
    bad = []
    for r in corpus_plan(archive, json.loads(Path(expected).read_text()), digests):
        if r["source"] in kinds and r["state"] in ("missing", "size", "sha256") and not (start and r["month"] < start or end and r["month"] > end):
            bad.append(f"{r['source']} {r['month']}: {r['state']}")
    return bad


def run_manifest(output: str, query: Any, options: dict[str, Any], jobs: list[FileJob], counts: dict[str, int], warnings: list[str] = (), upstream: list[str] = ()) -> dict[str, Any]:
    """Writes <output>.manifest.json: what ran over which files, what came out, and the manifests of its inputs."""
    links = []
    for u in upstream:
        at = Path(f"{u}.manifest.json")
        links.append({"path": u, "fingerprint": json.loads(at.read_text())["fingerprint"] if at.exists() else None})
    doc = {
        "version": 1, "written": datetime.now(UTC).isoformat(), "query": _plain(query), "options": options, "files": [file_identity(j.path) for j in jobs], "counts": counts,
        "warnings": list(warnings), "upstream": links, "fingerprint": fingerprint(query, options, jobs),
    }
    write_doc(doc, f"{output}.manifest.json")
    return doc


@dataclass
class Progress:
    """Finished months of an output, valid for one fingerprint. A malformed or unknown file counts as none; an unreadable one is an error."""

    path: str
    fingerprint: str
    months: dict[str, dict[str, Any]] = field(default_factory=dict)

    @staticmethod
    def load(path: str, fingerprint: str) -> Progress:
        out = Progress(path, fingerprint)
        if Path(path).exists():
            try:
                doc = json.loads(Path(path).read_text())
            except ValueError:
                return out
            if isinstance(doc, dict) and doc.get("version") == 1 and doc.get("fingerprint") == fingerprint and isinstance(doc.get("months"), dict):
                out.months = doc["months"]
        return out

    def key(self, job: FileJob) -> str:
        return f"{PREFIX[job.kind]}_{job.month}"

    def done(self, job: FileJob, part: str) -> bool:
        """Whether the month's part is there as it was written."""
        m, p = self.months.get(self.key(job)), Path(part)
        return bool(m) and p.exists() and p.stat().st_size == m["size"] and (m.get("sha256") is None or sha256_of(part) == m["sha256"])

    def note(self, job: FileJob, lines: int, size: int = 0) -> None:
        """Records a finished month."""
        self.months[self.key(job)] = {"size": size, "lines": lines, "sha256": None}
        write_doc({"version": 1, "fingerprint": self.fingerprint, "months": self.months}, self.path)

    def finish(self, job: FileJob, part: str, lines: int, digest: bool = False) -> None:
        self.months[self.key(job)] = {"size": Path(part).stat().st_size, "lines": lines, "sha256": sha256_of(part) if digest else None}
        write_doc({"version": 1, "fingerprint": self.fingerprint, "months": self.months}, self.path)


def resumed_spool(spark, archive: Archive, query: Any, folder: str, options: dict[str, Any] | None = None, partial: bool = False, rewrite=None, kinds: tuple[str, ...] = ("comment", "submission")) -> tuple[list[str], int]:
    """A spool whose finished months are kept: only months without a valid part are scanned. Returns paths in order and all lines."""
    from talkmill.sinks.files import export_spool
    from talkmill.sources.integrity import sound
    from talkmill.sources.lines import read_lines
    from talkmill.sources.records import parse

    q = query.build()
    jobs = archive.plan(tuple(k for k in kinds if k in q.kinds()), *q.month_range())
    if partial:
        jobs, _ = sound(spark, jobs)
    p = Progress.load(f"{folder}/_progress.json", fingerprint(q, options or {}, jobs))
    part = lambda j: f"{folder}/part_{PREFIX[j.kind]}_{j.month}.jsonl"
    todo = [j for j in jobs if not p.done(j, part(j))]
    if todo:
        Path(folder).mkdir(parents=True, exist_ok=True)
        records = q.apply(parse(read_lines(spark, todo)))
        export_spool(rewrite(records) if rewrite else records, folder, [(j.kind, j.month) for j in todo])
        for j in todo:
            with open(part(j), "rb") as f:
                n = sum(1 for _ in f)
            p.finish(j, part(j), n)
    return [part(j) for j in sorted(jobs, key=lambda j: (j.month, part(j)))], sum(m["lines"] for m in p.months.values())


def corpus_manifest(archive: Archive, digests: bool = False) -> dict[str, Any]:
    """Version 1: by source the folder, prefix, first and last month and the files with sizes, digests if asked."""
    found = archive.discover()
    out = []
    for kind, folder in (("comment", archive.comments), ("submission", archive.submissions)):
        js = [j for j in found if j.kind == kind]
        files = [{"month": j.month, "name": Path(j.path).name, "size": j.size} | ({"sha256": sha256_of(j.path)} if digests else {}) for j in js]
        out.append({"source": kind, "directory": folder, "prefix": PREFIX[kind], "first_month": min((j.month for j in js), default=None), "last_month": max((j.month for j in js), default=None), "unavailable": [], "files": files})
    return {"version": 1, "sources": out}


def corpus_plan(archive: Archive, expected: dict[str, Any], digests: bool = False, only_missing: bool = False) -> list[dict[str, Any]]:
    """Expected against local: a row a month with state ok, missing, size, sha256, unavailable or extra."""
    if expected.get("version") != 1:
        raise ValueError("not a corpus manifest of version 1")
    local = {(j.kind, j.month): j for j in archive.discover()}
    out = []
    for s in expected["sources"]:
        files = {f["month"]: f for f in s.get("files", [])}
        first, last = s.get("first_month"), s.get("last_month")
        for m in months.months(first, last) if first and last else []:
            j, f = local.pop((s["source"], m), None), files.get(m, {})
            if j is None:
                state = "unavailable" if m in s.get("unavailable", []) else "missing"
            elif f.get("size") not in (None, j.size):
                state = "size"
            elif digests and f.get("sha256") not in (None, sha256_of(j.path)):
                state = "sha256"
            else:
                state = "ok"
            out.append({"source": s["source"], "month": m, "state": state, "size": f.get("size"), "local_size": j and j.size, "url": s["url_template"].format(month=m) if s.get("url_template") else None})
    out += [{"source": k, "month": m, "state": "extra", "size": None, "local_size": j.size, "url": None} for (k, m), j in sorted(local.items())]
    return [r for r in out if not only_missing or r["state"] == "missing"]
