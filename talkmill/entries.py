"""The queries of the record operators over the driver's tables, each with its DuckDB oracle where SQL can tell it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill import views as V
from talkmill.functions import text
from talkmill.operators import aggregate as G
from talkmill.operators import analytics as A
from talkmill.operators import parents as P
from talkmill.operators import project as J
from talkmill.plans.query import Predicate, Query, parse_predicate

Fn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Fn] = {}
_SQL: dict[str, str] = {}

#: Records of the tables in DuckDB's SQL.
_EVENTS = "(SELECT event_id::VARCHAR AS id, 'user_' || user_id AS author, event_type AS subreddit, floor(epoch(ts))::BIGINT AS created_utc, floor(value)::BIGINT AS score, value, props, (props->>'$.k')::DOUBLE AS k FROM events)"
_ORDERS = "(SELECT o_orderkey::VARCHAR AS id, 'cust_' || o_custkey AS author, o_orderstatus AS subreddit, floor(epoch(o_orderdate))::BIGINT AS created_utc, floor(o_totalprice)::BIGINT AS score, o_orderpriority AS title FROM orders)"
_MONTH = "strftime(make_timestamp(created_utc * 1000000), '%Y-%m')"
JAN, MAR = 1704067200, 1709251200


def query(sql: str | None = None) -> Callable[[Fn], Fn]:
    def add(f: Fn) -> Fn:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _filtered(view: Callable, columns: list[str], sql_from: str, select: str, where: str, name: str, q: Query) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return q.build().apply(view(spark, d)).select(*columns)

    f.__name__ = name
    query(f"SELECT {select} FROM {sql_from} WHERE {where}")(f)


@query(f"SELECT {_MONTH} AS month, count(*) AS n FROM {_EVENTS} GROUP BY 1")
def events_count_by_month(spark: SparkSession, d: str) -> DataFrame:
    return A.count_by_month(Query().build().apply(V.events(spark, d)))


def _event_filter(name: str, where: str, **q) -> None:
    _filtered(V.events, ["id", "author", "subreddit", "created_utc", "score"], _EVENTS, "id, author, subreddit, created_utc, score", where, name, Query(**q))


_event_filter("events_filter_score_window", f"score BETWEEN 10 AND 60 AND created_utc >= {JAN + 86400} AND created_utc < {MAR}", min_score=10, max_score=60, after=JAN + 86400, before=MAR)
_event_filter("events_filter_month_range", f"created_utc >= {JAN} AND created_utc < {MAR}", start_month="2024-01", end_month="2024-02")
_event_filter("events_subreddits", "subreddit IN ('click', 'view')", subreddits=("Click", "r/VIEW"))
_event_filter("events_author_allow_deny", "author IN ('user_1', 'user_2', 'user_3', 'user_40') AND subreddit <> 'error'", authors=("USER_1", "user_2", "user_3", "user_40"), exclude_authors=("user_99",), json=(parse_predicate("/subreddit != error"),))
_event_filter("events_exclude_authors", "author NOT IN ('user_5', 'user_6')", exclude_authors=("user_5", "user_6"), exclude_common_bots=True)
_event_filter("events_author_regex", "regexp_matches(author, '^user_[12].?$')", author_regex="^user_[12].?$")
_event_filter("events_json_exists", "(props->'$.k') IS NOT NULL", json=(Predicate("/props/k", "exists"),))
_event_filter("events_json_number_gte", "k >= 50", json=(parse_predicate("/props/k >= 50"),))
_event_filter("events_json_eq", "k = 7", json=(parse_predicate("/props/k=7"),))
_event_filter("events_json_ne", "k <> 7", json=(parse_predicate("/props/k!=7"),))
_event_filter("events_json_lt", "k < 3.5", json=(parse_predicate("/props/k < 3.5"),))
_event_filter("events_json_regex", "regexp_matches(subreddit, '^(view|sign)')", json=(parse_predicate("/subreddit ~= ^(view|sign)"),))
_event_filter("events_ids", "id IN ('1', '20', '300', '4000')", ids=("t1_1", "20", "T1_300", "4000"))
_filtered(V.documents, ["id", "score"], "documents", "doc_id::VARCHAR AS id, n_chars AS score", "contains(lower(text), 'license') OR contains(lower(text), 'idiot')", "documents_keywords_any", Query(keywords_any=("License", "idiot")))
_filtered(V.documents, ["id", "score"], "documents", "doc_id::VARCHAR AS id, n_chars AS score", "contains(lower(text), 'the') AND contains(lower(text), 'and')", "documents_keywords_all", Query(keywords_all=("the", "AND")))
_filtered(V.documents, ["id", "score"], "documents", "doc_id::VARCHAR AS id, n_chars AS score", "NOT contains(lower(text), 'the')", "documents_keywords_exclude", Query(exclude_keywords=("the",)))
_filtered(V.documents, ["id", "score"], "documents", "doc_id::VARCHAR AS id, n_chars AS score", "regexp_matches(text, '[A-Z]{5,}!!')", "documents_text_regex", Query(text_regex="[A-Z]{5,}!!"))
_filtered(V.pages, ["id", "url"], "pages", "page_id::VARCHAR AS id, url", "starts_with(lower(url), 'http')", "pages_contains_url", Query(contains_url=True))
_filtered(V.pages, ["id", "url"], "pages", "page_id::VARCHAR AS id, url", "NOT starts_with(lower(url), 'http')", "pages_no_url", Query(no_url=True))


@query(f"SELECT id, title FROM {_ORDERS} WHERE id IN (SELECT p_partkey::VARCHAR FROM part)")
def orders_ids_semi_join(spark: SparkSession, d: str) -> DataFrame:
    ids = V.table(spark, d, "part").select(F.lit("submission").alias("kind"), F.col("p_partkey").cast("string").alias("id"))
    return Query().build().apply(V.orders(spark, d), ids).select("id", "title")


@query("SELECT regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) AS domain, count(*) AS n FROM pages WHERE lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) IN (SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) FROM pages WHERE page_id = 1) GROUP BY 1")
def pages_domain_in(spark: SparkSession, d: str) -> DataFrame:
    pages = V.pages(spark, d)
    wanted = tuple(r.domain for r in pages.where(F.col("id") == "1").select("domain").collect())
    return Query(domains=wanted).build().apply(pages).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT author, count(*) AS n FROM {_EVENTS} GROUP BY 1")
def events_author_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.author_counts(V.events(spark, d))


@query(f"SELECT author, min(created_utc) AS first_seen FROM {_EVENTS} GROUP BY 1")
def events_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return A.first_seen(V.events(spark, d))


@query(f"SELECT DISTINCT author FROM {_EVENTS}")
def events_usernames(spark: SparkSession, d: str) -> DataFrame:
    return A.usernames(V.events(spark, d))


@query(f"SELECT DISTINCT author FROM {_EVENTS} WHERE subreddit = 'purchase'")
def events_subreddit_usernames(spark: SparkSession, d: str) -> DataFrame:
    return A.subreddit_usernames(V.events(spark, d), "Purchase")


@query(f"SELECT DISTINCT k::BIGINT::VARCHAR AS key FROM {_EVENTS} WHERE k IS NOT NULL")
def events_distinct_json_key(spark: SparkSession, d: str) -> DataFrame:
    return A.distinct_keys(V.events(spark, d), "json:/props/k")


@query("SELECT DISTINCT lower(source) AS key FROM documents")
def documents_distinct_subreddit_key(spark: SparkSession, d: str) -> DataFrame:
    return A.distinct_keys(V.documents(spark, d), "subreddit")


@query("SELECT arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY md5(text), length(text)")
def documents_dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    return A.keep_first(docs.select("doc_id", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("h"), F.length("text").alias("l")), ["h", "l"], ["doc_id"]).select("doc_id", "source", "n_chars")


@query(f"SELECT subreddit AS key, sum(score)::DOUBLE AS value FROM {_EVENTS} GROUP BY 1")
def events_reduce_sum(spark: SparkSession, d: str) -> DataFrame:
    return A.reduce_kv(V.events(spark, d).select(F.col("subreddit").alias("key"), F.col("score").alias("value"))).withColumn("value", F.col("value").cast("double"))


@query("SELECT count(*) AS count FROM orders")
def orders_rollup_count(spark: SparkSession, d: str) -> DataFrame:
    return G.rollup(V.orders(spark, d))


@query(f"SELECT {_MONTH} AS key, count(*)::DOUBLE AS value FROM {_ORDERS} GROUP BY 1")
def orders_rollup_month(spark: SparkSession, d: str) -> DataFrame:
    return G.rollup(V.orders(spark, d), "month").select("key", "value")


@query("SELECT 'supp_' || l_suppkey AS key, sum(l_quantity::BIGINT)::DOUBLE AS value FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def lineitem_top_suppliers_by_quantity(spark: SparkSession, d: str) -> DataFrame:
    return G.rollup(V.lineitem(spark, d), "author", "sum:/score", top=10).select("key", "value")


@query("SELECT l_returnflag AS key, sum(l_quantity::BIGINT)::DOUBLE / count(*) AS value FROM lineitem GROUP BY 1")
def lineitem_avg_metric(spark: SparkSession, d: str) -> DataFrame:
    return G.rollup(V.lineitem(spark, d), "subreddit", "avg:/score").select("key", "value")


@query("SELECT l_returnflag AS key, max(l_extendedprice) AS value FROM lineitem GROUP BY 1")
def lineitem_max_metric(spark: SparkSession, d: str) -> DataFrame:
    return G.rollup(V.lineitem(spark, d), "subreddit", "max:/price").select("key", "value")


@query("SELECT l_returnflag AS key, min(l_extendedprice) AS value FROM lineitem GROUP BY 1")
def lineitem_min_metric(spark: SparkSession, d: str) -> DataFrame:
    return G.rollup(V.lineitem(spark, d), "subreddit", "min:/price").select("key", "value")


@query(f"SELECT {_MONTH} AS month, subreddit, count(*) AS count, sum(score)::DOUBLE AS sum_score, min(score)::DOUBLE AS min_score, max(score)::DOUBLE AS max_score, sum(score)::DOUBLE / count(score) AS avg_score FROM {_ORDERS} GROUP BY 1, 2")
def orders_group_by_month_status(spark: SparkSession, d: str) -> DataFrame:
    return G.aggregate(V.orders(spark, d), "month,subreddit", "count(*),sum(score),min(score),max(score),avg(score)").drop("sum_score__exact")


@query(f"SELECT strftime(make_timestamp(created_utc * 1000000), '%Y') AS year, strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%d') AS date, strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%dT%H') AS hour, count(*) AS count FROM {_EVENTS} GROUP BY 1, 2, 3")
def events_group_hour_day_year(spark: SparkSession, d: str) -> DataFrame:
    return G.aggregate(V.events(spark, d), "year,day,hour", "count(*)")


@query("SELECT k::BIGINT::VARCHAR AS props_k, count(*) AS count, count(DISTINCT user_id) AS distinct_author FROM (SELECT *, (props->>'$.k')::DOUBLE AS k FROM events) WHERE k IS NOT NULL GROUP BY 1")
def events_group_by_pointer(spark: SparkSession, d: str) -> DataFrame:
    return G.aggregate(V.events(spark, d), "json:/props/k", "count(*),count_distinct(author)")


@query(f"SELECT author, '\"' || arg_min(id, (created_utc, '\"' || id || '\"')) || '\"' AS first_id, '\"' || arg_min(id, (-created_utc, '\"' || id || '\"')) || '\"' AS last_id FROM {_ORDERS} GROUP BY 1")
def orders_first_last_by_customer(spark: SparkSession, d: str) -> DataFrame:
    return G.aggregate(V.orders(spark, d), "author", "first(id),last(id)")


@query("SELECT l_returnflag AS subreddit, count(DISTINCT l_suppkey) AS distinct_author FROM lineitem GROUP BY 1")
def lineitem_distinct_suppliers_by_flag(spark: SparkSession, d: str) -> DataFrame:
    return G.aggregate(V.lineitem(spark, d), "subreddit", "distinct(author)")


@query()
def lineitem_approximate_distinct(spark: SparkSession, d: str) -> DataFrame:
    return G.aggregate(V.lineitem(spark, d), "subreddit", "distinct(author),count(*)", approximate=True)


@query(f"SELECT sum(score)::DOUBLE AS sum_score, count(*) AS count FROM {_EVENTS}")
def events_global_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return G.aggregate(V.events(spark, d), "", "sum(score),count(*)").drop("sum_score__exact")


@query("SELECT l_orderkey::VARCHAR AS parent_key, l_linenumber::VARCHAR AS line, l_quantity::BIGINT AS score, o_orderpriority AS parent_title FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def lineitem_attach_order_parent(spark: SparkSession, d: str) -> DataFrame:
    children = V.lineitem(spark, d).select("parent_id", "created_utc", "score", F.try_variant_get("j", "$.line", "string").alias("line"))
    titles = P.payloads(V.orders(spark, d)).withColumn("payload", F.get_json_object("payload", "$.title"))
    return P.attach(children, titles).select("parent_key", "line", "score", F.col("parent_payload").alias("parent_title"))


@query("SELECT c.conv_id || '_' || c.turn AS id, p.text AS parent_body FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def conversations_attach_previous_turn(spark: SparkSession, d: str) -> DataFrame:
    records = V.conversations(spark, d)
    got = P.attach(records, P.payloads(records))
    return got.select("id", F.get_json_object("parent_payload", "$.body").alias("parent_body"))


@query("SELECT count(*) FILTER (p.conv_id IS NOT NULL) AS resolved, count(*) FILTER (p.conv_id IS NULL) AS unresolved FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def conversations_unresolved_parents(spark: SparkSession, d: str) -> DataFrame:
    records = V.conversations(spark, d)
    got = P.attach(records, P.payloads(records))
    return got.agg(F.count("parent_payload").alias("resolved"), F.count_if(F.col("parent_payload").isNull()).alias("unresolved"))


@query("SELECT DISTINCT 'submission' AS kind, l_orderkey::VARCHAR AS id FROM lineitem")
def lineitem_collect_parent_ids(spark: SparkSession, d: str) -> DataFrame:
    return P.collect_parent_ids(V.lineitem(spark, d))


@query("SELECT nth::INTEGER AS nth, 't3_' || o_orderkey AS id, o_orderpriority AS title FROM (VALUES (0, 5), (1, 3), (2, 77)) v(nth, k) JOIN orders ON o_orderkey = k")
def orders_direct_ids(spark: SparkSession, d: str) -> DataFrame:
    got = P.direct(V.orders(spark, d), ["t3_5", "t3_3", "t3_77", "t3_999999999"])
    return got.select("nth", "id", F.get_json_object("payload", "$.title").alias("title"))


@query("SELECT count(*) AS records, 0::BIGINT AS with_body, count(*) AS with_parent_id, 0::BIGINT AS parent_t1, count(*) AS parent_t3, 0::BIGINT AS parent_malformed, count(*) AS with_link_id FROM lineitem")
def lineitem_parent_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return P.diagnostics(V.lineitem(spark, d))


@query(f"SELECT 'comment' AS kind, id, score FROM {_EVENTS} UNION ALL SELECT 'submission', id, score FROM {_ORDERS}")
def events_union_orders_sources(spark: SparkSession, d: str) -> DataFrame:
    return V.events(spark, d).select("kind", "id", "score").unionByName(V.orders(spark, d).select("kind", "id", "score"))


@query("SELECT event_id::VARCHAR AS id, event_type AS subreddit FROM events ORDER BY floor(epoch(ts)), event_id::VARCHAR LIMIT 10")
def events_sample_limit(spark: SparkSession, d: str) -> DataFrame:
    return A.sample(V.events(spark, d).select("id", "subreddit", "created_utc"), 10, ["created_utc", "id"]).select("id", "subreddit")


@query(f"SELECT id, strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created FROM {_EVENTS}")
def events_human_timestamps(spark: SparkSession, d: str) -> DataFrame:
    out = V.events(spark, d).select("id", J.rewritten(F.col("value"), ["id", "created_utc"], human_timestamps=True).alias("v"))
    return out.select("id", F.get_json_object("v", "$.created_utc").alias("created"))


@query(f"SELECT id, subreddit, k::BIGINT::VARCHAR AS \"props.k\", '' AS nothing FROM {_EVENTS}")
def events_tabular_projection(spark: SparkSession, d: str) -> DataFrame:
    return J.tabular(V.events(spark, d), ["id", "subreddit", "props.k", "nothing"])


@query(f"SELECT id || ',' || subreddit || ',' || k::BIGINT || chr(13) AS line FROM {_EVENTS}")
def events_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    from talkmill.sinks.files import csv_line

    return V.events(spark, d).select(csv_line([J.cell(F.col("j"), s) for s in ("id", "subreddit", "/props/k")]).alias("line"))


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN regexp_matches(text, '[,\"\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END || chr(13) AS line FROM documents")
def documents_csv_quoting(spark: SparkSession, d: str) -> DataFrame:
    from talkmill.sinks.files import csv_line

    return V.documents(spark, d).select("id", csv_line([J.cell(F.col("j"), "body")]).alias("line"))


@query("SELECT id, author, subreddit, created_utc, score FROM " + _EVENTS)
def events_typed_rows(spark: SparkSession, d: str) -> DataFrame:
    return J.typed_rows(V.events(spark, d)).select("id", "author", "subreddit", "created_utc", "score")


@query(
    "SELECT field, type, 100.0::DOUBLE AS presence_pct, least(100, (SELECT count(*) FROM events)) AS present_records, least(100, (SELECT count(*) FROM events)) AS sampled_records FROM (VALUES ('author', 'string'), ('created_utc', 'number'), ('id', 'string'), ('props', 'object'), ('score', 'number'), ('subreddit', 'string'), ('value', 'number')) v(field, type)"
)
def events_schema_profile(spark: SparkSession, d: str) -> DataFrame:
    lines = V.event_lines(spark, d).withColumn("ordinal", F.get_json_object("value", "$.id").cast("long"))
    return A.schema_profile(lines, 100)


@query()
def events_shards(spark: SparkSession, d: str) -> DataFrame:
    from talkmill.operators.bucketing import shard

    return V.events(spark, d).groupBy(shard(F.lower("author"), 16).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author").alias("authors"))


@query("SELECT 'user_' || user_id AS author, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def events_grouped_callback(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    from talkmill.operators.bucketing import for_each_group

    def one(key: str, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"author": [key], "n": [len(pdf)], "spread": [round(float(pdf.x.max() - pdf.x.min()), 6)]})

    rows = V.events(spark, d).select("author", F.get_json_object("value", "$.value").cast("double").alias("x"))
    return for_each_group(rows, F.col("author"), one, "author string, n long, spread double")


@query("SELECT sum(floor(value))::BIGINT AS total, count(*) AS records FROM events")
def events_user_aggregator(spark: SparkSession, d: str) -> DataFrame:
    from talkmill.operators.samples import SumOfScores

    got = G.run_aggregator(V.event_lines(spark, d), SumOfScores, SumOfScores.from_json)
    return spark.createDataFrame([(got.total, got.records)], "total long, records long")


@query(f"SELECT count(*) AS matched, count(DISTINCT k) AS \"unique\", count(*) FILTER (k IS NULL) AS missing FROM {_EVENTS}")
def events_key_stats(spark: SparkSession, d: str) -> DataFrame:
    s = A.key_stats(V.events(spark, d), "json:/props/k")
    return spark.createDataFrame([(s.matched, s.unique, s.missing)], "matched long, unique long, missing long")


@query("SELECT lower(source) AS author_or_source, count(*) AS n FROM documents GROUP BY 1")
def documents_count_by_source(spark: SparkSession, d: str) -> DataFrame:
    return V.documents(spark, d).groupBy(F.lower(text.trim(F.col("subreddit"))).alias("author_or_source")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Fn]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
