"""Records: lines with the typed fields that filters see. Columns that a query doesn't use are never extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions import pointer
from talkmill.plans.query import Query
from talkmill.sources.lines import read_lines
from talkmill.sources.listing import Archive

STRINGS = ("subreddit", "author", "id", "selftext", "body", "title", "url", "parent_id", "domain")
FIELDS = {"subreddit": "string", "author": "string", "created_utc": "long", "score": "long", "id": "string", "selftext": "string", "body": "string", "title": "string", "url": "string", "is_self": "boolean", "parent_id": "string", "domain": "string"}


def typed(j: Column, name: str) -> Column:
    x = pointer.field(j, name)
    kind = FIELDS[name]
    return pointer.text(x) if kind == "string" else pointer.long(x) if kind == "long" else pointer.boolean(x)


def once(c: Column) -> Column:
    """c, computed once a row: the optimizer doesn't move filters below, or copy, what isn't deterministic. It knows that rand() < 2."""
    return F.when(F.rand() + 1 > 0, c)


def parse(lines: DataFrame, blank: str = "skip", malformed: str = "fail", repeated: str = "skip") -> DataFrame:
    """Lines (value, ...) with j VARIANT and the typed fields of FIELDS.

    blank: skip (exports) or fail (counts and tables) for lines of white space; malformed: fail or skip for lines that aren't JSON.
    JSON that isn't an object is skipped, and so is (repeated="skip") an object that names a typed field twice.
    """
    value = F.col("value")
    empty = F.trim(value) == ""
    out = lines.where(~empty) if blank == "skip" else lines
    j = F.try_parse_json(once(value))
    if malformed == "fail":
        at = F.col("file_path") if "file_path" in lines.columns else F.lit("input")
        j = F.coalesce(j, F.try_parse_json(F.raise_error(F.concat(F.lit("malformed JSON in "), at)).cast("string")))
    out = out.withColumn("j", j).where(F.col("j").isNotNull() & F.ltrim(value).startswith("{"))
    if repeated == "skip":
        known = F.filter(F.json_object_keys(value), lambda k: k.isin(*FIELDS))
        out = out.where(F.exists(F.array(known), lambda ks: F.size(ks) == F.size(F.array_distinct(ks))))  # a lambda's argument is computed once
    return out.withColumns({f: typed(F.col("j"), f) for f in FIELDS})


def malformed_line(path: str) -> int | None:
    """The first line (from 1) of a file that isn't JSON, to name it after a run has failed on the file."""
    import json

    from talkmill.sources.lines import plain_lines, window_log, zstd_lines

    for n, line in enumerate(zstd_lines(path) if window_log(path) else plain_lines(path), 1):
        try:
            if line.strip():
                json.loads(line)
        except ValueError:
            return n
    return None


def scan(spark: SparkSession, archive: Archive, query: Query, kinds: tuple[str, ...] = ("comment", "submission"), partial: bool = False, blank: str = "skip") -> DataFrame:
    """The records of an archive that match: files are pruned by kind and month before Spark sees them."""
    q = query.build()
    jobs = archive.plan(tuple(k for k in kinds if k in q.kinds()), *q.month_range())
    return q.apply(parse(read_lines(spark, jobs, partial), blank=blank))
