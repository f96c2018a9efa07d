"""Integrity of archive files: decompression of a first part or of all of it, on the executors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from talkmill.sources.listing import FileJob

MAX_REPORTED = 1024
QUICK_BYTES = 64 << 10


@dataclass
class Report:
    checked: int = 0
    failures: list[tuple[str, str]] = field(default_factory=list)
    dropped: int = 0

    @property
    def ok(self) -> bool:
        return not self.failures

    @property
    def exit_code(self) -> int:
        return 0 if self.ok else 2


def check_file(path: str, first: int | None) -> str | None:
    """What is wrong with a zstd file, or None; first: only so many decompressed bytes, None: all, with checksums."""
    import zstandard

    try:
        with open(path, "rb") as f:
            if f.read(4) != b"\x28\xb5\x2f\xfd":
                return "not a zstd file"
            f.seek(0)
            d = zstandard.ZstdDecompressor(max_window_size=1 << 31)
            if first is not None:
                with d.stream_reader(f, read_across_frames=True) as r:
                    left = first
                    while left > 0:
                        got = r.read(min(left, 1 << 20))
                        if not got:
                            # the stream ended early: the file must be whole
                            return check_file(path, None)
                        left -= len(got)
                return None
            # frame by frame, so that a frame cut short at the end is noticed
            o, data, open_frame = d.decompressobj(), b"", False
            while True:
                data = f.read(1 << 20)
                if not data:
                    return "truncated" if open_frame else None
                while data:
                    open_frame = True
                    o.decompress(data)
                    data = o.unused_data if o.eof else b""
                    if o.eof:
                        open_frame = False
                        o = d.decompressobj()
    except (OSError, zstandard.ZstdError) as e:
        return str(e)


def check_table(spark: SparkSession, jobs: list[FileJob], mode: str = "quick", first: int = QUICK_BYTES) -> DataFrame:
    """(path, kind, month, error) of all files; error is NULL for sound ones. A file is one task's work."""
    from talkmill.session import prepare

    if mode not in ("quick", "full") or first <= 0:
        raise ValueError("mode is quick or full, and quick checks read at least a byte")
    prepare(spark)
    n = first if mode == "quick" else None

    def run(frames):
        for pdf in frames:
            yield pdf.assign(error=[check_file(p, n) for p in pdf.path])

    rows = spark.createDataFrame([(j.path, j.kind, j.month) for j in jobs], "path string, kind string, month string")
    return rows.repartition(max(1, len(jobs)), "path").mapInPandas(run, "path string, kind string, month string, error string")


def check(spark: SparkSession, jobs: list[FileJob], mode: str = "quick", first: int = QUICK_BYTES, sink: Callable[[str, str], None] | None = None) -> Report:
    """The report names at most MAX_REPORTED failures; the sink gets them all."""
    out = Report(checked=len(jobs))
    for r in check_table(spark, jobs, mode, first).where("error is not null").orderBy("path").toLocalIterator():
        if sink:
            sink(r.path, r.error)
        if len(out.failures) < MAX_REPORTED:
            out.failures.append((r.path, r.error))
        else:
            out.dropped += 1
    return out


def sound(spark: SparkSession, jobs: list[FileJob]) -> tuple[list[FileJob], Report]:
    """The files that decompress to the end: exports that allow partial reads drop a damaged month whole."""
    report = Report(checked=len(jobs))
    bad = {r.path: r.error for r in check_table(spark, jobs, "full").where("error is not null").collect()}  # a row a damaged file
    report.failures = sorted(bad.items())[:MAX_REPORTED]
    report.dropped = max(0, len(bad) - MAX_REPORTED)
    return [j for j in jobs if j.path not in bad], report
