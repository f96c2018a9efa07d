"""Incremental ingest: new monthly files become typed Parquet once, however often the job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkmill.plans.query import Query
from talkmill.sources.records import FIELDS, parse


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Lines of files as they arrive, with kind and month from their names."""
    raw = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "R[CS]_*.zst").option("recursiveFileLookup", "true").text(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return raw.select(F.regexp_replace("value", "\r$", "").alias("value"), F.when(name.startswith("RC_"), "comment").otherwise("submission").alias("kind"), F.substring(name, 4, 7).alias("file_month"), F.col("_metadata.file_path").alias("file_path"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, query: Query | None = None) -> StreamingQuery:
    """Appends the matching records of files not seen before to a table partitioned by kind and month, and ends when there are no more."""
    records = parse(stream_lines(spark, folder))
    if query is not None:
        records = query.build().apply(records)
    rows = records.select("kind", "file_month", *FIELDS, F.col("value").alias("payload"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).option("compression", "zstd").partitionBy("kind", "file_month").trigger(availableNow=True).start()


def monthly_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A running count by month over the stream."""
    from talkmill.functions import text

    return parse(stream_lines(spark, folder)).select(text.month(F.col("created_utc")).alias("month")).where("month is not null").groupBy("month").count()
