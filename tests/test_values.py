"""Typing, pointers, months, times and the predicate grammar."""

import pytest
from pyspark.sql import functions as F

from talkmill.functions import months, pointer, text
from talkmill.operators.project import members, readable_times, selector, whitelisted
from talkmill.plans.query import Predicate, Query, QueryError, parse_predicate


def variants(spark, values):
    return spark.createDataFrame([(k, f'{{"v":{v}}}' if v is not None else "{}") for k, v in enumerate(values)], "k int, s string").withColumn("j", F.try_parse_json("s"))


LONGS = {"100": 100, "100.0": 100, '"100"': 100, '"100.0"': 100, "1e3": 1000, '"1e3"': 1000, '"+5"': 5, "-0.0": 0, "9223372036854775807": 2**63 - 1, "9223372036854775808": None, "1.5": None, '"x"': None, '" 7 "': None, '"7d"': None, "true": None, "null": None, "[1]": None, None: None}


def test_long(spark):
    got = variants(spark, list(LONGS)).select("k", pointer.long(pointer.field(F.col("j"), "v")).alias("v")).orderBy("k").collect()
    assert [r.v for r in got] == list(LONGS.values())


def test_kind_text_key(spark):
    rows = variants(spark, ['"a"', "1", "1.5", "true", "null", "[1,2]", '{"b":1}', None])
    x = pointer.field(F.col("j"), "v")
    got = rows.select("k", pointer.kind(x), pointer.text(x), pointer.key_text(x), pointer.number(x)).orderBy("k").collect()
    assert [r[1] for r in got] == ["string", "number", "number", "bool", "null", "array", "object", None]
    assert [r[2] for r in got] == ["a"] + [None] * 7
    assert [r[3] for r in got] == ["a", "1", "1.5", "true", None, "[1,2]", '{"b":1}', None]
    assert [r[4] for r in got] == [None, 1.0, 1.5] + [None] * 5


PREDICATES = {
    "exists:/a": [1, 1, 1, 0, 1], "/a = 5": [1, 0, 1, 0, 0], "/a != 5": [0, 1, 0, 0, 1], "/a > 4": [1, 1, 1, 0, 0], "/a<=5": [1, 0, 1, 0, 0], "/a=null": [0, 0, 0, 0, 1],
    "/b/0 = x": [1, 0, 0, 0, 0], "/b/1/c ~= ^y": [1, 0, 0, 0, 0], "/a~1b = 3": [0, 0, 0, 1, 0], "/a = \"5\"": [1, 0, 1, 0, 0], "/b/0=z": [0, 0, 0, 1, 0],
}


@pytest.mark.parametrize("raw", PREDICATES)
def test_predicates(spark, raw):
    rows = ['{"a":5,"b":["x",{"c":"yes"}]}', '{"a":6}', '{"a":"5"}', '{"a/b":3,"b":{"0":"z"}}', '{"a":null}']
    df = spark.createDataFrame(list(enumerate(rows)), "k int, s string").withColumn("j", F.try_parse_json("s"))
    assert [int(r.x) for r in df.select("k", parse_predicate(raw).column(F.col("j")).alias("x")).orderBy("k").collect()] == PREDICATES[raw]


def test_predicate_grammar():
    assert parse_predicate("/a>=2") == Predicate("/a", ">=", 2) and parse_predicate("/a = true") == Predicate("/a", "=", True)
    assert parse_predicate("/a=b=c") == Predicate("/a", "=", "b=c") and parse_predicate("exists:/x") == Predicate("/x", "exists")
    for bad in ("/a", "a=1", "/a > x", "/a ~= (", "/~2 = 1", "/a ~= (?=x)"):
        with pytest.raises(QueryError):
            parse_predicate(bad)


def test_months_and_times():
    assert months.shift("2019-11", 3) == "2020-02" and list(months.months("2019-12", "2020-02")) == ["2019-12", "2020-01", "2020-02"]
    assert months.holes(["2006-01", "2006-04"]) == ["2006-02", "2006-03"] and months.holes(["2006-01", "2006-04"], "2006-03") == ["2006-03"]
    assert months.as_ranges(["2006-01", "2006-02", "2006-05"]) == "2006-01..2006-02, 2006-05"
    assert months.window(["2019-01", "2019-03"], 3) == ("2018-10", "2019-06")
    assert months.parse_time("2006-01-01") == months.parse_time("1136073600") == months.parse_time("2006-01-01T00:00Z") == months.parse_time("2006-01-01T01:00:00+01:00") == 1136073600
    for bad in ("2006-13", "2006-1", "06-01", "2006-01-01"):
        with pytest.raises(ValueError):
            months.parse_month(bad)
    for bad in ("x", "2006-02-30", "2006-01-01T00:00"):
        with pytest.raises(ValueError):
            months.parse_time(bad)


def test_month_of_absurd_times(spark):
    df = spark.createDataFrame([(0, 1136073600), (1, 9 * 10**18), (2, None), (3, -1)], "k int, t long")
    assert [r.m for r in df.select("k", text.month(F.col("t")).alias("m")).orderBy("k").collect()] == ["2006-01", "1970-01", None, "1969-12"]


def test_raw_members_keep_their_text():
    v = '{ "b" : 1.50, "a":"\\u00e9", "c": {"x":[1, 2e3]} ,"created_utc":1136073600, "edited": false}'
    assert members(v)[:3] == [("b", "1.50"), ("a", '"\\u00e9"'), ("c", '{"x":[1, 2e3]}')]
    assert whitelisted(v, frozenset({"c", "b", "zz"})) == '{"b":1.50,"c":{"x":[1, 2e3]}}'
    assert whitelisted('{"a":1,"a":2,"b":3}', frozenset({"a"})) == '{"a":2}'
    assert '"created_utc":"2006-01-01T00:00:00Z"' in readable_times(v) and '"edited":false' in readable_times(v)
    same = '{"x":{"created_utc":5}, "created_utc":"7", "edited":1.5}'
    assert readable_times(same) == same and readable_times('{"created_utc":99999999999999}') == '{"created_utc":99999999999999}'


def test_selectors():
    assert selector("a.b") == "/a/b" and selector("json:/x/0") == "/x/0" and selector("a/b") == "/a~1b"
    for bad in ("", "a..b"):
        with pytest.raises(ValueError):
            selector(bad)


BAD = [
    {"subreddits": ()}, {"subreddits": (" ",)}, {"ids": ("c1", "C1")}, {"min_score": 3, "max_score": 2}, {"after": 5, "before": 5}, {"authors": ("a",), "exclude_authors": ("A",)},
    {"authors": ("AutoModerator",), "exclude_common_bots": True}, {"author_regex": "("}, {"text_regex": r"(a)\1"}, {"contains_url": True, "no_url": True}, {"start_month": "2006-13"},
    {"start_month": "2006-02", "end_month": "2006-01"}, {"keywords_any": ("",)}, {"json": (Predicate("a", "exists"),)}, {"json": (Predicate("/a", ">", float("nan")),)},
]


@pytest.mark.parametrize("bad", BAD, ids=str)
def test_bad_queries(bad):
    with pytest.raises((QueryError, ValueError)):
        Query(**bad).build()


def test_normalised_queries(monkeypatch, tmp_path):
    q = Query(subreddits=("r/Rust", "rust", " Go "), ids=("T1_A", "b"), keywords_any=(" Foo",)).build()
    assert (q.subreddits, q.ids, q.keywords_any) == (("go", "rust"), ("b", "t1_a"), ("foo",))
    assert Query(ids=("t3_a", "t3_b")).kinds() == ("submission",) and Query(ids=("t3_a", "b")).kinds() == ("comment", "submission")
    assert Query(start_month="2006-01", before=1138752000).month_range() == ("2006-01", "2006-01")
    monkeypatch.setenv("ETL_EXCLUDE_AUTHORS", "one; Two")
    assert {"one", "two", "automoderator"} <= set(Query(exclude_common_bots=True).build().exclude_authors)
    monkeypatch.setenv("ETL_EXCLUDE_AUTHORS_FILE", str(tmp_path / "none"))
    with pytest.raises(QueryError):
        Query(exclude_common_bots=True).build()
