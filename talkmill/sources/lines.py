"""Lines of archive files as a DataFrame (value, kind, file_month, file_path, ordinal), one task per file.

Frames with a window of up to 2^27 bytes are read by Spark's own text source; longer windows, which its decoder refuses, by a Python
data source that hands Arrow batches to the JVM. Lines end at LF; a CR before it is dropped.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from talkmill.sources.listing import FileJob

SCHEMA = "value string, kind string, file_month string, file_path string, ordinal long"
MAX_LINE, BATCH_BYTES = 16 << 20, 4 << 20
NATIVE_WINDOW = 27


def window_log(path: str) -> int:
    """Of the first frame's header; 0 if the file isn't zstd."""
    with open(path, "rb") as f:
        head = f.read(18)
    if head[:4] != b"\x28\xb5\x2f\xfd" or len(head) < 6:
        return 0
    if head[4] & 0x20:  # a single segment: the window is the content
        n = {0: 1, 1: 2, 2: 4, 3: 8}[head[4] >> 6]
        at = 5 + (0, 1, 2, 4)[head[4] & 3]
        size = int.from_bytes(head[at : at + n], "little") + (256 if n == 2 else 0)
        return max(10, (size - 1).bit_length() if size > 1 else 0)
    return 10 + (head[5] >> 3)


def zstd_lines(path: str, partial: bool = False, max_line: int = MAX_LINE) -> Iterator[bytes]:
    """Lines of a file of one or more frames. partial: end quietly at damage, after the lines before it."""
    import zstandard

    with open(path, "rb") as f:
        reader = io.BufferedReader(zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(f, read_across_frames=True), 1 << 20)
        seen = 0
        while True:
            try:
                line = reader.readline(max_line + 2)
            except zstandard.ZstdError as e:
                if partial:
                    return
                raise OSError(f"{path}: damaged after line {seen}: {e}") from e
            if not line:
                return
            seen += 1
            if len(line) > max_line + 1 and not line.endswith(b"\n"):
                raise OSError(f"{path}: line {seen} is longer than {max_line} bytes")
            yield line.removesuffix(b"\n").removesuffix(b"\r")


def plain_lines(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        for line in f:
            yield line.removesuffix(b"\n").removesuffix(b"\r")


def _source() -> type[DataSource]:
    """Made here so that its class travels by value: planning workers need no package."""
    read = zstd_lines
    size = BATCH_BYTES

    class File(InputPartition):
        def __init__(self, kind: str, month: str, path: str):
            self.kind, self.month, self.path = kind, month, path

    class Reader(DataSourceReader):
        def __init__(self, jobs: list[list[str]], partial: bool):
            self.jobs, self.partial = jobs, partial

        def partitions(self):
            return [File(*j) for j in self.jobs]

        def read(self, partition):
            def batch(lines: list[str], at: int) -> pa.RecordBatch:
                n = len(lines)
                cols = [pa.array(lines), *[pa.array([x] * n, pa.string()) for x in (partition.kind, partition.month, partition.path)], pa.array(range(at, at + n), pa.int64())]
                return pa.RecordBatch.from_arrays(cols, names=["value", "kind", "file_month", "file_path", "ordinal"])

            held, bytes_, at = [], 0, 0
            for line in read(partition.path, self.partial):
                held.append(line.decode())
                bytes_ += len(line)
                if bytes_ >= size:
                    yield batch(held, at)
                    at, held, bytes_ = at + len(held), [], 0
            if held:
                yield batch(held, at)

    class ZstdLines(DataSource):
        @classmethod
        def name(cls) -> str:
            return "zstd_lines"

        def schema(self) -> str:
            return "value string, kind string, file_month string, file_path string, ordinal long"

        def reader(self, schema):
            import json

            return Reader(json.loads(self.options["jobs"]), self.options.get("partial") == "true")

    return ZstdLines


def read_lines(spark: SparkSession, jobs: list[FileJob], partial: bool = False) -> DataFrame:
    """Lines of the files. partial: of a damaged file, the lines before the damage."""
    import json

    from talkmill.session import prepare

    prepare(spark)
    native = [j for j in jobs if window_log(j.path) <= NATIVE_WINDOW and not partial and Path(j.path).suffix == ".zst" and window_log(j.path)]
    other = [j for j in jobs if j not in native]
    out = None
    if native:
        lines = spark.read.option("lineSep", "\n").text([j.path for j in native]).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_name").alias("__name"), F.col("_metadata.file_path").alias("file_path"))
        kind = F.when(F.col("__name").startswith("RC_"), "comment").otherwise("submission")
        out = lines.select("value", kind.alias("kind"), F.substring("__name", 4, 7).alias("file_month"), F.regexp_replace("file_path", "^file:/+", "/").alias("file_path"), F.monotonically_increasing_id().alias("ordinal"))
    if other:
        spark.dataSource.register(_source())
        more = spark.read.format("zstd_lines").option("jobs", json.dumps([[j.kind, j.month, j.path] for j in other])).option("partial", str(partial).lower()).load()
        out = more if out is None else out.unionByName(more)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def read_jsonl(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines of plain JSONL files (value, file_path); a line over MAX_LINE bytes is an error."""
    raw = spark.read.option("lineSep", "\n").text(paths).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file_path"))
    return raw.withColumn("value", F.when(F.octet_length("value") > MAX_LINE, F.raise_error(F.concat(F.lit("a line is too long in "), F.col("file_path")))).otherwise(F.col("value")))
