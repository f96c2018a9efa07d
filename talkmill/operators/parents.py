"""Replies and their parents: collect ids, resolve the parents' payloads (semi join), attach them (left join)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import pointer, text

#: Share of unresolved or malformed parents above which a run should warn.
WARN_UNRESOLVED, WARN_MALFORMED = 0.05, 0.005


def _prefix_kind(c: Column) -> Column:
    return F.when(c.startswith("t1_"), "comment").when(c.startswith("t3_"), "submission")


def collect_parent_ids(children: DataFrame) -> DataFrame:
    """Distinct (kind, id) that parent_id (either kind) and link_id (submissions) name; ids keep their case."""
    link = pointer.text(pointer.field(F.col("j"), "link_id")) if "link_id" not in children.columns else F.col("link_id")
    named = children.select(F.explode(F.array(F.col("parent_id"), F.when(link.startswith("t3_"), link))).alias("p"))
    return named.select(_prefix_kind(F.col("p")).alias("kind"), F.substring("p", 4, 1 << 30).alias("id")).where("kind is not null and id <> ''").distinct()


def parent_ids(spark, ids: list[str]) -> DataFrame:
    """(kind, id) of prefixed ids."""
    rows = []
    for x in dict.fromkeys(ids):
        if x[:3] not in ("t1_", "t3_") or len(x) < 4:
            raise ValueError(f"an id has the prefix t1_ or t3_: {x!r}")
        rows.append(("comment" if x[:2] == "t1" else "submission", x[3:]))
    return spark.createDataFrame(rows, "kind string, id string")


def payload_column(fields: list[str] | None = None, full: bool = False) -> Column:
    """JSON of a parent's payload: by default a comment's body or a submission's title and selftext; NULL if a comment has no body text."""
    if full:
        return F.to_json(F.col("j"))
    if fields is not None:
        pairs = [x for f in fields for x in (F.lit(f), pointer.field(F.col("j"), f))]
        return F.to_json(F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))
    comment = F.when(F.col("body").isNotNull(), F.to_json(F.struct("body")))
    submission = F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("selftext", F.lit("")).alias("selftext")))
    return F.when(F.col("kind") == "comment", comment).otherwise(submission)


def payloads(corpus: DataFrame, fields: list[str] | None = None, full: bool = False) -> DataFrame:
    """(kind, id, file_month, payload) of all records with an id. Attached to children it gives what resolve with their ids gives, without
    reading the children twice: for a corpus of which most records are parents."""
    return corpus.where("id <> ''").select("kind", "id", "file_month", payload_column(fields, full).alias("payload")).where("payload is not null")


def resolve(corpus: DataFrame, ids: DataFrame, fields: list[str] | None = None, full: bool = False) -> DataFrame:
    """(kind, id, file_month, payload) of the wanted records. corpus: records of the months to look in, without query filters."""
    wanted = ids.select(F.col("kind").alias("__kind"), F.col("id").alias("__id"))
    return payloads(corpus.join(wanted, (F.col("kind") == F.col("__kind")) & (F.col("id") == F.col("__id")), "left_semi"), fields, full)


def attach(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children with parent_kind, parent_key, parent_payload (NULL: unresolved).

    An id found in several months is taken from the child's own month, else from the latest one.
    """
    p = parents.select(F.col("kind").alias("__kind"), F.col("id").alias("__id"), F.coalesce("file_month", F.lit("")).alias("__month"), F.col("payload").alias("__payload"))
    # one row an id before the join: months of an id are few, so a map by month keeps own-month preference without a second join;
    # one exchange by id serves both steps and the join; ids come first, as sorts compare the start of the first key only where they can
    once = p.repartition("__id", "__kind").groupBy("__id", "__kind", "__month").agg(F.min("__payload").alias("__payload"))
    once = once.groupBy("__id", "__kind").agg(F.map_from_entries(F.collect_list(F.struct("__month", "__payload"))).alias("__by"), F.max_by("__payload", "__month").alias("__last"))
    c = children.withColumns({"parent_kind": _prefix_kind(F.col("parent_id")), "parent_key": F.substring("parent_id", 4, 1 << 30)})
    joined = c.join(once, (F.col("parent_key") == F.col("__id")) & (F.col("parent_kind") == F.col("__kind")), "left")
    own = F.when(F.size("__by") > 1, F.try_element_at(F.col("__by"), F.coalesce(text.month_part(F.col("created_utc")), F.lit(""))))
    return joined.withColumn("parent_payload", F.coalesce(own, F.col("__last"))).drop("__kind", "__id", "__by", "__last")


def _splice(v: str | None, kind: str | None, key: str | None, payload: str | None) -> str | None:
    """A record's JSON with the member parent; the rest of its text stays as it is."""
    if payload is None or v is None:
        return v
    body = v.rstrip()[:-1].rstrip()
    member = json.dumps({"kind": kind, "id": key} | json.loads(payload), ensure_ascii=False, separators=(",", ":"))
    return body + ("" if body.endswith("{") else ",") + '"parent":' + member + "}"


def attached_json(attached: DataFrame) -> DataFrame:
    """attached with value: the record's JSON and, if resolved, its parent."""

    @F.pandas_udf("string")
    def spliced(value: pd.Series, kind: pd.Series, key: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([_splice(*r) for r in zip(value, kind, key, payload, strict=True)], dtype=object)

    return attached.withColumn("value", spliced("value", "parent_kind", "parent_key", "parent_payload"))


def attach_stats(attached: DataFrame) -> dict[str, int]:
    """Children with a parent_id: resolved and unresolved, those without a prefix included."""
    r = attached.where("parent_id is not null").agg(F.count_if(F.col("parent_payload").isNotNull()).alias("resolved"), F.count_if(F.col("parent_payload").isNull()).alias("unresolved")).first()
    return {"resolved": r.resolved, "unresolved": r.unresolved}


def direct(corpus: DataFrame, ids: list[str], fields: list[str] | None = None, full: bool = False) -> DataFrame:
    """(nth, id, payload) of given prefixed ids in their order; ids not found are left out."""
    spark = corpus.sparkSession
    once = list(dict.fromkeys(ids))
    wanted = parent_ids(spark, once)
    found = resolve(corpus, wanted, fields, full).groupBy("kind", "id").agg(F.max_by("payload", F.coalesce("file_month", F.lit(""))).alias("payload"))
    order = spark.createDataFrame([(k, "comment" if x[:2] == "t1" else "submission", x[3:], x) for k, x in enumerate(once)], "nth int, __kind string, __id string, given string")
    return order.join(found, (F.col("__kind") == F.col("kind")) & (F.col("__id") == F.col("id"))).select("nth", F.col("given").alias("id"), "payload").orderBy("nth")


def diagnostics(children: DataFrame) -> DataFrame:
    """One row of counts: records, with body, parent_id of each shape, link_id."""
    p = F.col("parent_id")
    link = pointer.text(pointer.field(F.col("j"), "link_id"))
    return children.agg(
        F.count(F.lit(1)).alias("records"), F.count("body").alias("with_body"), F.count(p).alias("with_parent_id"), F.count_if(p.startswith("t1_")).alias("parent_t1"),
        F.count_if(p.startswith("t3_")).alias("parent_t3"), F.count_if(p.isNotNull() & ~p.rlike("^t[13]_.")).alias("parent_malformed"), F.count(link).alias("with_link_id"),
    )


def warnings(stats: dict[str, int]) -> list[str]:
    n = stats["resolved"] + stats["unresolved"]
    return [f"{stats['unresolved']} of {n} parents are unresolved"] if n and stats["unresolved"] > WARN_UNRESOLVED * n else []
