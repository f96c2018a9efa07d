"""Counts, first seen, distinct names and keys, keep-first dedup, limits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions import pointer, text


def count_by_month(records: DataFrame) -> DataFrame:
    """month, n in order; records without a time are left out, times outside the calendar count as 1970-01."""
    m = text.month(F.col("created_utc"))
    return records.select(m.alias("month")).where("month is not null").groupBy("month").agg(F.count(F.lit(1)).alias("n")).orderBy("month")


def author_counts(records: DataFrame) -> DataFrame:
    """author (trimmed, case kept), n; empty names are left out."""
    return records.select(text.trim(F.col("author")).alias("author")).where("author <> ''").groupBy("author").agg(F.count(F.lit(1)).alias("n"))


def first_seen(records: DataFrame) -> DataFrame:
    """author, the least created_utc."""
    named = records.select(text.trim(F.col("author")).alias("author"), "created_utc").where("author <> '' and created_utc is not null")
    return named.groupBy("author").agg(F.min("created_utc").alias("first_seen"))


def usernames(records: DataFrame) -> DataFrame:
    return records.select(text.trim(F.col("author")).alias("author")).where("author <> ''").distinct()


def iter_usernames(records: DataFrame) -> Iterator[str]:
    """The names one by one, a partition at a time on the driver."""
    for row in usernames(records).toLocalIterator():
        yield row.author


def subreddit_usernames(records: DataFrame, subreddit: str) -> DataFrame:
    """Names of one community; pseudo-users are dropped after trimming."""
    from talkmill.plans.query import PSEUDO_USERS, clean_name

    here = records.where(pointer.yes(F.lower("subreddit") == clean_name(subreddit)))
    return usernames(here).where(~text.ascii_lower(F.col("author")).isin(*PSEUDO_USERS))


def key_column(key: str) -> Column:
    """author and subreddit in lower case, or the text of the value at a pointer (json:/p or /p)."""
    if key in ("author", "subreddit"):
        return F.lower(F.col(key))
    return pointer.key_text(pointer.resolve(F.col("j"), key.removeprefix("json:")))


@dataclass(frozen=True)
class KeyStats:
    matched: int
    unique: int
    missing: int

    @property
    def warns(self) -> bool:
        """More than one record in a hundred has no key."""
        return self.missing * 100 > self.matched


def distinct_keys(records: DataFrame, key: str | Column) -> DataFrame:
    """Distinct keys in byte order."""
    k = key_column(key) if isinstance(key, str) else key
    return records.select(k.alias("key")).where("key is not null").distinct().orderBy("key")


def key_stats(records: DataFrame, key: str | Column, strict: bool = False) -> KeyStats:
    k = key_column(key) if isinstance(key, str) else key
    # distinct keys are counted by a distributed aggregate over (key), missing ones in the same pass
    by = records.groupBy(k.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    r = by.agg(F.sum("n").alias("m"), F.count("key").alias("u"), F.sum(F.when(F.col("key").isNull(), F.col("n"))).alias("x")).first()
    out = KeyStats(r.m or 0, r.u or 0, r.x or 0)
    if strict and out.missing:
        raise ValueError(f"{out.missing} records have no key")
    return out


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """One row a key: the first in the order. An aggregate with map-side partial results, so a hot key isn't gathered in one task."""
    ks = [F.col(k) if isinstance(k, str) else k for k in keys]
    os = [F.col(o) if isinstance(o, str) else o for o in order]
    row = F.struct(*df.columns)
    best = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(ks)]).agg(F.min_by(row, F.struct(*os)).alias("__row"))
    return best.select("__row.*")


def grouped(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    """Every group whole to a function of (key, pandas frame). For keys of bounded groups."""
    return df.groupBy(key).applyInPandas(fn, schema)


def reduce_kv(df: DataFrame, how: str = "sum") -> DataFrame:
    """(key, value): sum or min by key. A key with a tab or line break is an error, as the result is meant for TSV."""
    bad = F.col("key").rlike("[\t\r\n]")
    safe = df.select(F.when(bad, F.raise_error(F.concat(F.lit("tab or line break in key "), F.col("key"))).cast("string")).otherwise(F.col("key")).alias("key"), "value")
    return safe.groupBy("key").agg((F.sum if how == "sum" else F.min)("value").alias("value"))


def limit(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """At most n rows; with an order, the same ones each time."""
    if n < 0:
        raise ValueError("a limit is not negative")
    return (df.orderBy(*order) if order else df).limit(n)


def sample(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """The first n rows: a look at the data, not a random sample."""
    return limit(df, n, order)


def top(df: DataFrame, metric: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(metric), F.asc(key)).limit(n)


def schema_profile(lines: DataFrame, first: int = 100) -> DataFrame:
    """field, type, presence_pct, present_records, sampled_records over the first records of each file (kind, file_month; by ordinal).

    The type of a field is its commonest one, of equally common ones the first by name.
    """
    w = Window.partitionBy("kind", "file_month").orderBy("ordinal")
    some = lines.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= first).select("value", F.try_parse_json("value").alias("j"))
    some = some.where(F.schema_of_variant("j").startswith("OBJECT"))
    total = some.count()  # at most the asked number of records a file
    fields = some.select(F.explode(F.array_distinct(F.json_object_keys("value"))).alias("field"), "value")
    m = F.from_json("value", "map<string,variant>")
    typed = fields.select("field", pointer.kind(F.try_element_at(m, F.col("field"))).alias("type"))
    by = typed.groupBy("field", "type").agg(F.count(F.lit(1)).alias("n"))
    best = by.groupBy("field").agg(F.sum("n").alias("present_records"), F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"))
    out = best.withColumn("sampled_records", F.lit(total).cast("long"))
    return out.select("field", "type", (F.col("present_records") * 100.0 / F.col("sampled_records")).cast("double").alias("presence_pct"), "present_records", "sampled_records").orderBy("field")
