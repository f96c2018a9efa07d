"""Sinks. Executors write parts; the driver only joins the parts of single-file outputs, as streams, and publishes by rename."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.sources.listing import PREFIX

ORDER = ("kind", "file_month", "file_path", "ordinal")


@contextmanager
def atomic(path: str) -> Iterator[Path]:
    """A temporary file beside path that takes its place if nothing fails."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    tmp = at.with_name(f".{at.name}.{os.getpid()}.inprogress")
    try:
        yield tmp
        os.replace(tmp, at)
    finally:
        tmp.unlink(missing_ok=True)


def sweep(folder: str) -> list[str]:
    """Removes what runs left behind whose process has ended."""
    out = []
    for p in Path(folder).glob(".*.inprogress"):
        m = re.search(r"\.(\d+)\.inprogress$", p.name)
        if m and not Path(f"/proc/{m[1]}").exists():
            p.unlink()
            out.append(str(p))
    return out


def _parts(df: DataFrame, path: str, columns: list[str]) -> tuple[str, list[Path]]:
    """Text parts of column value in order; comments come before submissions, then by month and place in the file."""
    by = [c for c in columns if c in df.columns]
    staging = f"{path}.{uuid.uuid4().hex}.parts"
    rows = df.orderBy(*by) if by else df
    try:
        rows.select("value").write.text(staging)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return staging, sorted(p for p in Path(staging).glob("part-*") if p.stat().st_size)


def write_jsonl(df: DataFrame, path: str, order: tuple[str, ...] = ORDER) -> None:
    staging, parts = _parts(df, path, list(order))
    try:
        join_lines(parts, path)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def join_lines(parts: list[Path], path: str) -> None:
    with atomic(path) as tmp, tmp.open("wb") as f:
        for p in parts:
            with p.open("rb") as g:
                shutil.copyfileobj(g, f, 1 << 20)


def write_json(df: DataFrame, path: str, pretty: bool = False, order: tuple[str, ...] = ORDER) -> None:
    """One JSON array; compact keeps the records' own text."""
    staging, parts = _parts(df, path, list(order))
    try:
        join_array(parts, path, pretty)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def join_array(parts: list[Path], path: str, pretty: bool = False) -> None:
    """JSON lines as one array."""
    import json

    with atomic(path) as tmp, tmp.open("w", encoding="utf-8", newline="") as f:
        first = True
        f.write("[")
        for p in parts:
            with p.open(encoding="utf-8", newline="\n") as g:
                for line in g:
                    line = line.removesuffix("\n")
                    if pretty:
                        line = "\n  " + json.dumps(json.loads(line), indent=2, ensure_ascii=False).replace("\n", "\n  ")
                    f.write(("" if first else ",") + line)
                    first = False
        f.write("\n]\n" if pretty and not first else "]\n")


def csv_line(cells: list[Column]) -> Column:
    """RFC 4180: a cell is quoted only for a comma, a quote or a line break; the CR of the line's CRLF is part of the text."""
    one = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    return F.concat(F.concat_ws(",", *one), F.lit("\r"))


def tsv_line(cells: list[Column], names: list[str]) -> Column:
    """Tab-joined; a tab or line break in a cell is an error that names the field."""
    safe = [F.when(c.rlike("[\t\r\n]"), F.raise_error(F.lit(f"a tab or line break in field {n}")).cast("string")).otherwise(c) for c, n in zip(cells, names, strict=True)]
    return F.concat_ws("\t", *safe)


def write_table(df: DataFrame, path: str, selectors: list[str], tsv: bool = False, header: bool = True, order: tuple[str, ...] = ORDER) -> None:
    """CSV or TSV of records with j, a column a selector."""
    from talkmill.operators.project import cell

    if not selectors:
        raise ValueError("a table needs fields")
    cells = [cell(F.col("j"), s) for s in selectors]
    line = tsv_line(cells, selectors) if tsv else csv_line(cells)
    keep = [c for c in order if c in df.columns]
    rows = df.select(line.alias("value"), *keep)
    # the text sink writes LF after each row; a quoted cell may hold line breaks, which pass through
    staging, parts = _parts(rows, path, keep)
    try:
        with atomic(path) as tmp, tmp.open("wb") as f:
            if header:
                head = "\t".join(selectors) + "\n" if tsv else ",".join('"' + s.replace('"', '""') + '"' if re.search('[",\r\n]', s) else s for s in selectors) + "\r\n"
                f.write(head.encode())
            for p in parts:
                with p.open("rb") as g:
                    shutil.copyfileobj(g, f, 1 << 20)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def write_pairs_tsv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A small result (counts, first seen) as TSV in order."""
    line = tsv_line([F.col(c).cast("string") for c in columns], columns)
    write_jsonl(df.select(line.alias("value"), *order), path, tuple(order))


def write_key_value_parquet(df: DataFrame, path: str) -> None:
    df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_parquet(records: DataFrame, path: str, codec: str = "zstd", row_group_bytes: int | None = None, row_group_rows: int | None = None) -> None:
    """The typed fields and payload. codec: name or name:level."""
    from talkmill.operators.project import typed_rows

    name, _, level = codec.partition(":")
    if name not in ("zstd", "snappy", "gzip", "lz4", "uncompressed", "none") or level and (name != "zstd" or not level.isdigit() or not 1 <= int(level) <= 22):
        raise ValueError(f"unknown codec {codec!r}")
    w = typed_rows(records).write.mode("overwrite").option("compression", name)
    if level:
        w = w.option("parquet.compression.codec.zstd.level", level)
    if row_group_bytes:
        w = w.option("parquet.block.size", str(row_group_bytes))
    if row_group_rows:
        w = w.option("parquet.block.row.count.limit", str(row_group_rows))
    w.parquet(path)


def _zstd_writer(folder: str, level: int, suffix: str) -> Callable:
    def run(pdf_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (kind, file_month, ...): a file is written at a time, under a name of the attempt, then renamed."""
        import zstandard

        now, f, tmp, out, n = None, None, None, [], 0

        def close() -> None:
            nonlocal f, n
            if f is not None:
                f.close()
                os.replace(tmp, f"{folder}/{now}")
                out.append((now, n))
            f, n = None, 0

        for b in pdf_iter:
            for kind, month, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                name = f"{'comments/RC' if kind == 'comment' else 'submissions/RS'}_{month}{suffix}"
                if name != now:
                    close()
                    now = name
                    Path(folder, name).parent.mkdir(parents=True, exist_ok=True)
                    tmp = f"{folder}/{name}.{uuid.uuid4().hex}.inprogress"
                    raw = open(tmp, "wb")  # noqa: SIM115
                    f = zstandard.ZstdCompressor(level=level, write_checksum=True).stream_writer(raw, closefd=True) if suffix == ".zst" else raw
                f.write(value.encode() + b"\n")
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.int64())], names=["file", "n"])

    return run


def export_partitioned(records: DataFrame, folder: str, fmt: str = "zst", level: int = 7, owned: bool = True) -> dict[str, int]:
    """The archive's own layout, a file a kind and month: zst, jsonl or parquet. Months without records aren't published; earlier ones of the same layout go.

    folder is one that all executors share; a month is one task's work, as it is one file.
    """
    if fmt not in ("zst", "jsonl", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    if not 1 <= level <= 22:
        raise ValueError("a zstd level is 1 to 22")
    if fmt == "parquet":
        from talkmill.sources.records import FIELDS

        records.select("kind", "file_month", *FIELDS, F.col("value").alias("payload")).write.partitionBy("kind", "file_month").mode("overwrite").option("compression", "zstd").parquet(folder)
        return {f"{r.kind}/{r.file_month}": r["count"] for r in records.groupBy("kind", "file_month").count().collect()}
    suffix = ".zst" if fmt == "zst" else ".jsonl"
    by = [c for c in ORDER if c in records.columns]
    rows = records.select("kind", "file_month", "value", *[c for c in by if c not in ("kind", "file_month")]).repartition("kind", "file_month").sortWithinPartitions(*by)
    done = {r.file: r.n for r in rows.select("kind", "file_month", "value").mapInArrow(_zstd_writer(folder, level, suffix), "file string, n long").collect()}
    if owned:
        for sub, prefix in (("comments", "RC"), ("submissions", "RS")):
            for p in Path(folder, sub).glob(f"{prefix}_????-??{suffix}"):
                if f"{sub}/{p.name}" not in done:
                    p.unlink()
    return done


def export_spool(records: DataFrame, folder: str, months: list[tuple[str, str]] = ()) -> tuple[list[str], int]:
    """part_RC_YYYY-MM.jsonl and part_RS_...; each asked (kind, month) has a part, be it empty. Returns paths in order and the records."""
    done = export_partitioned(records, f"{folder}/_spool", "jsonl")
    names = []
    for kind, month in sorted({*months, *(("comment" if f.startswith("c") else "submission", f[-13:-6]) for f in done)}):
        src = Path(folder, "_spool", "comments" if kind == "comment" else "submissions", f"{PREFIX[kind]}_{month}.jsonl")
        at = Path(folder, f"part_{PREFIX[kind]}_{month}.jsonl")
        if src.exists():
            os.replace(src, at)
        else:
            at.write_bytes(b"")
        names.append(str(at))
    shutil.rmtree(f"{folder}/_spool", ignore_errors=True)
    return names, sum(done.values())


def spool_parts(folder: str) -> list[tuple[str, str, str]]:
    """(kind, month, path) of a spool, by month and name."""
    out = []
    for p in Path(folder).glob("part_*.jsonl"):
        m = re.fullmatch(r"part_(RC|RS)_(\d{4}-\d{2})\.jsonl", p.name)
        if m:
            out.append(("comment" if m[1] == "RC" else "submission", m[2], str(p)))
    return sorted(out, key=lambda x: (x[1], x[2]))


def load_table(df: DataFrame, name: str, as_view: bool = False, if_exists: str = "fail") -> None:
    """A catalog table (fail, replace, append) or a view."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", name):
        raise ValueError(f"not an identifier: {name!r}")
    if if_exists not in ("fail", "replace", "append"):
        raise ValueError(f"unknown mode {if_exists!r}")
    spark = df.sparkSession
    if as_view:
        if if_exists == "append":
            raise ValueError("a view can't be appended to")
        if if_exists == "fail" and spark.catalog.tableExists(name):
            raise ValueError(f"{name} exists")
        df.createOrReplaceTempView(name)
        return
    if if_exists == "fail" and spark.catalog.tableExists(name):
        raise ValueError(f"{name} exists")
    df.write.mode({"fail": "error", "replace": "overwrite", "append": "append"}[if_exists]).saveAsTable(name)
