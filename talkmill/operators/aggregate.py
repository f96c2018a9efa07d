"""Group-by aggregates: the one-metric rollup, the expression language, and user-defined aggregators.

Numbers are exact while they are integers: integers are summed as DECIMAL(38, 0), floats as doubles, and a metric is a double only
where a float took part or the exact sum doesn't fit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal, localcontext
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import pointer, text

_TIME_KEYS = {"year": text.year, "month": text.month_part, "day": text.day, "date": text.day, "hour": text.hour}


class AggregateError(ValueError):
    """A key or metric that can't be read."""


def ref(field: str) -> Column:
    """The variant of a top-level name or a /pointer."""
    return pointer.resolve(F.col("j"), field) if field.startswith("/") or field == "" else pointer.field(F.col("j"), field)


def label(field: str) -> str:
    return (field[1:].replace("/", "_") if field.startswith("/") else field) or "root"


@dataclass(frozen=True)
class Key:
    name: str
    column: Column


def parse_group_keys(raw: str) -> list[Key]:
    """Comma-separated subreddit, author, year, month, day, date, hour and json:/p."""
    out = []
    for k in [x.strip() for x in raw.split(",")] if raw.strip() else []:
        if k in ("subreddit", "author"):
            out.append(Key(k, pointer.key_text(pointer.field(F.col("j"), k))))
        elif k in _TIME_KEYS:
            epoch = pointer.number(pointer.field(F.col("j"), "created_utc"))
            out.append(Key("date" if k == "day" else k, _TIME_KEYS[k](F.when(F.abs(epoch) < 9e18, epoch.cast("bigint")))))
        elif k.startswith("json:"):
            pointer.paths(k[5:])
            out.append(Key(label(k[5:]), pointer.key_text(ref(k[5:]))))
        else:
            raise AggregateError(f"unknown group key {k!r}")
    if len({k.name for k in out}) < len(out):
        raise AggregateError(f"two keys of one name in {raw!r}")
    return out


@dataclass(frozen=True)
class Op:
    op: str
    field: str = ""

    @property
    def name(self) -> str:
        return "count" if self.op == "count" else f"{self.op}_{label(self.field)}"


def parse_agg_ops(raw: str) -> list[Op]:
    """Comma-separated count(*), distinct(f), count_distinct(f), sum(f), avg(f), min(f), max(f), first(f), last(f)."""
    out = []
    for part in re.split(r",(?![^(]*\))", raw):
        m = re.fullmatch(r"\s*([a-z_]+)\s*\(\s*(.*?)\s*\)\s*", part)
        if part.strip() == "count" or m and m[1] == "count" and m[2] in ("*", ""):
            out.append(Op("count"))
        elif m and m[1] in ("distinct", "count_distinct", "sum", "avg", "min", "max", "first", "last") and m[2]:
            if m[2].startswith("/"):
                pointer.paths(m[2])
            out.append(Op("distinct" if m[1] == "count_distinct" else m[1], m[2]))
        else:
            raise AggregateError(f"unknown aggregate {part.strip()!r}")
    if len({o.name for o in out}) < len(out):
        raise AggregateError(f"an aggregate is given twice in {raw!r}")
    return out


def whole(x: Column) -> Column:
    """Integer numbers and integer strings as DECIMAL(38, 0)."""
    t, s = F.schema_of_variant(x), F.trim(F.try_variant_get(x, "$", "string"))
    dec = F.try_variant_get(x, "$", "decimal(38,0)")
    integral = (t == "BIGINT") | t.rlike(r"^DECIMAL\(\d+,\s*0\)$")
    return F.when(integral, dec).when((t == "STRING") & s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("decimal(38,0)"))


def exact_sum(x: Column) -> tuple[Column, Column]:
    """(sum as DECIMAL(38, 0) or NULL if a float took part or it doesn't fit, sum as double or NULL without numbers)."""
    i, d = whole(x), pointer.number(x)
    floats = F.count_if(d.isNotNull() & i.isNull())
    total = F.sum(d)
    return F.when(floats == 0, F.try_sum(i)), total


def op_columns(o: Op) -> list[Column]:
    if o.op == "count":
        return [F.count(F.lit(1)).alias("count")]
    x = ref(o.field)
    n = o.name
    if o.op == "distinct":
        return [F.count_distinct(pointer.tagged(x)).alias(n)]
    if o.op == "sum":
        exact, double = exact_sum(x)
        return [F.coalesce(exact.cast("double"), double).alias(n), exact.alias(f"{n}__exact")]
    if o.op == "avg":
        exact, double = exact_sum(x)
        return [(F.coalesce(exact.cast("double"), double) / F.count(pointer.number(x))).alias(n)]
    if o.op in ("min", "max"):
        return [(F.min if o.op == "min" else F.max)(pointer.number(x)).alias(n)]
    # the value at the least or greatest time; of values of one time the lesser JSON text, for both
    at = pointer.long(pointer.field(F.col("j"), "created_utc"))
    v = F.when(x.isNotNull() & at.isNotNull(), F.to_json(x))
    by = F.when(v.isNotNull(), F.struct((at if o.op == "first" else -at).alias("t"), v.alias("v")))
    return [F.min_by(v, by).alias(n)]


def aggregate(records: DataFrame, group_by: str = "", agg: str = "count(*)", approximate: bool = False) -> DataFrame:
    """The expression language over records with j. A record that lacks any key is skipped; without keys there is one row, none for no records.

    sum_f is a double, sum_f__exact the exact integer where there is one. approximate: distinct counts by HyperLogLog of about 1.6 %.
    """
    keys, ops = parse_group_keys(group_by), parse_agg_ops(agg)
    cols: list[Column] = []
    for o in ops:
        if approximate and o.op == "distinct":
            cols.append(F.approx_count_distinct(pointer.tagged(ref(o.field)), 0.016).alias(o.name))
        else:
            cols += op_columns(o)
    keyed = records.withColumns({f"__{k.name}": k.column for k in keys}) if keys else records
    for k in keys:
        keyed = keyed.where(F.col(f"__{k.name}").isNotNull())
    names = [F.col(f"__{k.name}").alias(k.name) for k in keys]
    if names:
        return keyed.groupBy(*names).agg(*cols).orderBy(*[k.name for k in keys])
    return keyed.agg(*cols, F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n")


def rollup_key(by: str) -> Column:
    """Key of --by: exact text of subreddit or author, month of an ISO text or an integer epoch, or json:/p."""
    if by in ("subreddit", "author"):
        return pointer.key_text(pointer.field(F.col("j"), by))
    if by == "month":
        x = pointer.field(F.col("j"), "created_utc")
        s = pointer.text(x)
        iso = F.when(s.rlike(r"^\d{4}-(0[1-9]|1[0-2])(-|$)"), F.substring(s, 1, 7))
        t = F.schema_of_variant(x)
        epoch = F.when(t == "BIGINT", F.try_variant_get(x, "$", "bigint")).when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))
        return F.coalesce(text.month_part(epoch), iso)
    if by.startswith("json:"):
        return pointer.key_text(ref(by[5:]))
    raise AggregateError(f"unknown key {by!r}")


def rollup(records: DataFrame, by: str | None = None, metric: str = "count", top: int | None = None) -> DataFrame:
    """key, value (double), exact (DECIMAL or NULL), n; by the key, or with top by the metric, greatest first. Without by: one count.

    A group appears for count if it has a record, for the other metrics (sum, avg, min, max of :/p) if it has a number.
    """
    if by is None:
        return records.agg(F.count(F.lit(1)).alias("count"))
    keyed = records.withColumn("__key", rollup_key(by)).where("__key is not null")
    if metric == "count":
        n = F.count(F.lit(1))
        out = keyed.groupBy(F.col("__key").alias("key")).agg(n.cast("double").alias("value"), n.cast("decimal(38,0)").alias("exact"), n.alias("n"))
    else:
        m = re.fullmatch(r"(sum|avg|min|max):(.*)", metric)
        if not m:
            raise AggregateError(f"unknown metric {metric!r}")
        x = ref(m[2])
        d, i = pointer.number(x), whole(x)
        exact, double = exact_sum(x)
        n = F.count(d)
        if m[1] in ("sum", "avg"):
            value = F.coalesce(exact.cast("double"), double)
            value = value / n if m[1] == "avg" else value
        else:
            f = F.min if m[1] == "min" else F.max
            value = f(d)
            # the exact integer, unless a float is beyond it
            exact = F.when(f(i).cast("double") == f(d), f(i))
        out = keyed.groupBy(F.col("__key").alias("key")).agg(value.alias("value"), exact.alias("exact"), n.alias("n")).where("n > 0")
    if top is None:
        return out.orderBy("key")
    return out.orderBy(F.desc("value"), F.desc("exact"), F.asc("key")).limit(top)


def skipped(records: DataFrame, by: str) -> int:
    return records.select(F.count_if(rollup_key(by).isNull()).alias("n")).first().n


def average_text(total: int, n: int) -> str:
    """total / n to 18 places, half up, without trailing zeros."""
    with localcontext() as c:
        c.prec = 80
        q = (Decimal(total) / Decimal(n)).quantize(Decimal(1).scaleb(-18), ROUND_HALF_UP)
    s = f"{q:f}".rstrip("0").rstrip(".")
    return "0" if s in ("-0", "") else s


def number_text(x: float, scientific: bool = False) -> str:
    """Shortest text that reads back as x; exponents are written out unless asked for."""
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e16 and not scientific:
        return str(int(x))
    return repr(x) if scientific else f"{Decimal(repr(x)):f}"


def shown(df: DataFrame, metric: str, scientific: bool = False) -> DataFrame:
    """A rollup's rows (key, value as text): exact whole numbers and averages as such, doubles in their shortest form."""
    average = metric.startswith("avg")

    @F.pandas_udf("string")
    def of(value: pd.Series, exact: pd.Series, n: pd.Series) -> pd.Series:
        def one(v, x, k):
            if x is not None:
                return average_text(int(x), k) if average else str(int(x))
            return None if pd.isna(v) else number_text(v, scientific)

        return pd.Series([one(*r) for r in zip(value, exact, n, strict=True)], dtype=object)

    return df.select("key", of("value", F.col("exact").cast("decimal(38,0)"), "n").alias("value"))


class Aggregator(Protocol):
    """A mergeable state over records (dicts): ingest, merge, and text to and from for the exchange."""

    def ingest(self, record: dict[str, Any]) -> None: ...
    def merge(self, other: Aggregator) -> None: ...
    def to_json(self) -> str: ...


def run_aggregator(lines: DataFrame, make: Callable[[], Any], read: Callable[[str], Any], fan_in: int = 16) -> Any:
    """Partial states by partition, merged in rounds of fan_in on the executors; only the last few states come to the driver."""
    import json

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, n = make(), 0
        for b in batches:
            for v in b.column(0).to_pylist():
                if v and v.strip():
                    r = json.loads(v)
                    if isinstance(r, dict):
                        a.ingest(r)
                        n += 1
        yield pa.RecordBatch.from_arrays([pa.array([a.to_json()]), pa.array([n], pa.int64())], names=["state", "n"])

    return _merged(lines.select("value").mapInArrow(partial, "state string, n long"), make, read, fan_in)


def _merged(states: DataFrame, make: Callable[[], Any], read: Callable[[str], Any], fan_in: int) -> Any:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, n = None, 0
        for b in batches:
            for s, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = read(s)
                n += m
                if a is None:
                    a = x
                else:
                    a.merge(x)
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array([a.to_json()]), pa.array([n], pa.int64())], names=["state", "n"])

    schema = "state string, n long"
    parts = states.rdd.getNumPartitions()
    while parts > fan_in:
        parts = -(-parts // fan_in)
        states = states.coalesce(parts).mapInArrow(merge, schema) if parts > fan_in else states.repartition(parts).mapInArrow(merge, schema)
    out = make()
    for r in states.collect():
        out.merge(read(r.state))
    return out


@dataclass
class BuildReport:
    """What became of the inputs: whole ones, those read up to a fault, those that gave nothing; shards merged and records taken in."""

    ok: list[str]
    partial: list[tuple[str, str]]
    fatal: list[tuple[str, str]]
    merged: int = 0
    records: int = 0

    @property
    def warnings(self) -> list[str]:
        return [] if self.records else ["no input has a record"]


def build_aggregate(spark, paths: list[str], make: Callable[[], Any], read: Callable[[str], Any], strict: bool = False, merge_partial: bool = False, fan_in: int = 16) -> tuple[Any, BuildReport]:
    """(the aggregator over all inputs, the report). An input is a shard, built by one task; the shards that count are merged in rounds.

    An input that can't be opened is fatal, one with a malformed line is partial: its state up to there counts only with merge_partial. strict
    raises if any input isn't whole. Blank lines and JSON that isn't an object are left out.
    """
    import json

    from talkmill.session import prepare
    from talkmill.sources.lines import plain_lines, window_log, zstd_lines

    prepare(spark)
    schema = "path string, status string, error string, state string, n long"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                a, n, status, error = make(), 0, "ok", None
                try:
                    for k, line in enumerate(zstd_lines(p) if window_log(p) else plain_lines(p), 1):
                        try:
                            r = json.loads(line) if line.strip() else None
                        except ValueError as e:
                            raise OSError(f"line {k}: {e}") from e
                        if isinstance(r, dict):
                            a.ingest(r)
                            n += 1
                except OSError as e:
                    status, error = ("partial" if n else "fatal"), str(e)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((p, pa.string()), (status, pa.string()), (error, pa.string()), (a.to_json(), pa.string()), (n, pa.int64()))], names=["path", "status", "error", "state", "n"])

    # the shards are needed twice: for the report and for the merge
    shards = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path").mapInArrow(build, schema).persist(StorageLevel.DISK_ONLY)
    rows = shards.select("path", "status", "error", "n").collect()
    report = BuildReport(sorted(r.path for r in rows if r.status == "ok"), sorted((r.path, r.error) for r in rows if r.status == "partial"), sorted((r.path, r.error) for r in rows if r.status == "fatal"))
    if strict and (report.partial or report.fatal):
        raise AggregateError("; ".join(f"{p}: {e}" for p, e in report.partial + report.fatal))
    counted = {"ok", "partial"} if merge_partial else {"ok"}
    report.merged = sum(r.status in counted for r in rows)
    report.records = sum(r.n for r in rows if r.status in counted)
    return _merged(shards.where(F.col("status").isin(*counted)).select("state", "n"), make, read, fan_in), report


def merge_all(states: Iterable[Any]) -> Any:
    it = iter(states)
    out = next(it)
    for s in it:
        out.merge(s)
    return out
