"""Plans of registered queries: lines are written and parsed once a row, tables read once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from talkmill import entries
from talkmill.functions import pointer
from talkmill.operators import parents
from talkmill.sources.records import parse

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_attach_writes_and_parses_each_table_once(spark):
    plan = optimized(entries.queries()["lineitem_attach_order_parent"](spark, SF))
    assert plan.count("l_orderkey#") and plan.count("Relation") == 2
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and not any(made in line for line in filters for made in ("parseJson", "l_orderkey", "o_orderkey"))

def test_payloads_attach_as_resolve_does(spark):
    def lines(rows, kind, month):
        return parse(spark.createDataFrame([(json.dumps(r), kind, month) for r in rows], "value string, kind string, file_month string"))

    corpus = lines([{"id": "p", "title": "jan"}, {"id": "q", "title": "b"}, {"id": "q", "title": "a"}, {"id": "", "title": "x"}, {"title": "y"}], "submission", "2006-01")
    corpus = corpus.unionByName(lines([{"id": "p", "title": "mar"}, {"id": "unwanted", "title": "z"}], "submission", "2006-03"))
    corpus = corpus.unionByName(lines([{"id": "p", "body": "a comment"}, {"id": "r"}], "comment", "2006-01"))
    kids = lines([{"id": str(k), "parent_id": p, "created_utc": t} for k, (p, t) in enumerate([("t3_p", 1136073600), ("t3_p", "1141171200"), ("t3_p", None), ("t3_q", 1136073600), ("t3_", 0), ("t1_p", 0), ("t1_r", 0), ("nonsense", 0), (None, 0)])], "comment", None)
    got, want = ({r.id: r.parent_payload for r in parents.attach(kids, found).collect()} for found in (parents.payloads(corpus), parents.resolve(corpus, parents.collect_parent_ids(kids))))
    assert got == want
    assert [json.loads(got[str(k)]).get("title", "-") if got[str(k)] else None for k in range(9)] == ["jan", "mar", "mar", "a", None, "-", None, None, None]


def test_integers_of_every_form(spark):
    given = ["7", "-7", "9223372036854775807", "9223372036854775808", "7.0", "7.5", "1e3", "1e30", '"7"', '"+7"', '"7.0"', '"7.5"', '"1e3"', '" 7"', '"x"', "null", "true", "[7]"]
    df = spark.createDataFrame([(k, f'{{"a":{v}}}') for k, v in enumerate(given)] + [(99, "{}")], "k int, v string")
    got = {r.k: r.x for r in df.select("k", pointer.long(pointer.field(F.parse_json("v"), "a")).alias("x")).collect()}
    assert [got[k] for k in range(len(given))] == [7, -7, 2**63 - 1, None, 7, None, 1000, None, 7, 7, 7, None, 1000, None, None, None, None, None] and got[99] is None
