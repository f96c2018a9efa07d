"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.session import ship

#: Rows of an Arrow batch for functions that see whole texts: a batch of long texts must fit a Python worker.
TEXT_BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or, for local masters only, a new temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="talkmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, executors may be lost."""
    return read_staged(df.sparkSession, write_staged(df, name))


def write_staged(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    # the schema is the footer's; an empty table has one file with the schema as well
    return spark.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets the cleaner drop the shuffle files of results that are staged by now; it goes by the driver's garbage."""
    gc.collect()
    spark._jvm.System.gc()


def text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for batches of very long texts, and the code at hand in the workers."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    had = {c.lower() for c in df.columns}
    while name.lower() in had:
        name += "_"
    return name


#: Regular expression class of the white space that separates words.
WS = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not ASCII white space, without building the words: each run with its spaces becomes one x."""
    marked = F.regexp_replace(text, f"[{WS}]*[^{WS}]+[{WS}]*", "x")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def rebatched(batches, rows: int = 100_000):
    """Record batches of about that many rows, for functions over narrow columns."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def trim() -> None:
    """Gives memory that a worker has freed back to the system: workers are reused, and others need it."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # not glibc


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for every node of edges (a long, b long), by alternating large and small stars.

    Each round is written to the shared folder and its predecessor deleted. Nodes with very many edges meet only joins (split by
    adaptive execution) and aggregates with map-side partial results.
    """
    spark = edges.sparkSession

    def write(e: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = write_staged(e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        got = read_staged(spark, path)
        return path, got, tuple(got.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    path, e, mark = write(edges)
    while mark[0]:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        mid_path, mid, _ = write(large)
        low = mid.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = mid.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("k", "m"))
        new_path_, new, new_mark = write(small)
        remove(spark, mid_path)
        remove(spark, path)
        path, e, old, mark = new_path_, new, mark, new_mark
        if mark == old:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
