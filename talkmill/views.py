"""The driver's tables as records: JSON lines that go through the same parser as an archive's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.session import prepare
from talkmill.sources.records import once, parse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is spread over them, since making and parsing lines costs far more than an exchange of its rows."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def epoch(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def lines(df: DataFrame, kind: str, extra: Column | None = None, **fields: Column) -> DataFrame:
    """JSON lines with the fields; extra: more members as JSON text."""
    body = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    if extra is not None:
        body = F.concat(F.regexp_replace(body, r"\}$", ","), extra, F.lit("}"))
    return df.select(once(body).alias("value"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("file_month"))


def _text(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return lines(t, "comment", F.concat(F.lit('"props":'), F.col("props")), id=F.col("event_id").cast("string"), author=_text("user_", "user_id"), subreddit=F.col("event_type"), created_utc=epoch("ts"), score=F.floor("value").cast("long"), value=F.col("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(event_lines(spark, sf_dir))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return parse(lines(t, "submission", id=F.col("o_orderkey").cast("string"), author=_text("cust_", "o_custkey"), subreddit=F.col("o_orderstatus"), created_utc=epoch("o_orderdate"), score=F.floor("o_totalprice").cast("long"), title=F.col("o_orderpriority"), selftext=F.lit("")))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return parse(lines(t, "comment", author=_text("supp_", "l_suppkey"), subreddit=F.col("l_returnflag"), created_utc=epoch("l_shipdate"), score=F.col("l_quantity").cast("long"), parent_id=_text("t3_", "l_orderkey"), link_id=_text("t3_", "l_orderkey"), price=F.col("l_extendedprice"), line=F.col("l_linenumber")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    me = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    up = F.concat(F.lit("t1_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - 1).cast("string"))
    return parse(lines(t, "comment", id=me, author=F.col("role"), subreddit=F.lit("conversations"), created_utc=F.col("turn"), score=F.lit(0), body=F.col("text"), parent_id=up))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents")
    return parse(lines(t, "comment", id=F.col("doc_id").cast("string"), author=F.col("lang"), subreddit=F.col("source"), created_utc=F.lit(0), score=F.col("n_chars"), body=F.col("text")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages")
    domain = F.regexp_extract(F.col("url"), r"^[a-zA-Z]+://([^/:?#]+)", 1)
    return parse(lines(t, "submission", id=F.col("page_id").cast("string"), author=F.lit("web"), subreddit=F.lit("pages"), created_utc=F.lit(0), score=F.lit(0), url=F.col("url"), domain=domain))
