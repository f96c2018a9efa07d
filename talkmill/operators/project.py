"""Projections: raw records, kept fields, readable times, tabular cells, typed rows."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import pointer

TIME_FIELDS = ("created_utc", "retrieved_on", "edited")
_JSON = json.JSONDecoder(parse_float=str, parse_int=str)


def members(value: str) -> list[tuple[str, str]]:
    """(key, raw text of the value) of a JSON object, in order and byte for byte."""
    out, i, n = [], value.index("{") + 1, len(value)

    def skip(k: int) -> int:
        while k < n and value[k] in " \t\r\n":
            k += 1
        return k

    i = skip(i)
    while value[i] != "}":
        key, i = json.decoder.scanstring(value, i + 1, True)
        i = skip(skip(i) + 1)
        _, end = _JSON.raw_decode(value, i)
        out.append((key, value[i:end]))
        i = skip(end)
        if value[i] == ",":
            i = skip(i + 1)
    return out


def whitelisted(value: str, fields: frozenset[str]) -> str:
    """The object with the kept fields only; values keep their text; of a field given twice the last counts."""
    got = [(k, v) for k, v in members(value) if k in fields]
    if len({k for k, _ in got}) < len(got):
        got = list(dict(got).items())
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in got) + "}"


def readable_times(value: str) -> str:
    """Top-level integer times as RFC 3339; everything else keeps its text."""
    out, changed = [], False
    for k, v in members(value):
        if k in TIME_FIELDS and v.lstrip("-").isdigit():
            try:
                v = datetime.fromtimestamp(int(v), UTC).strftime('"%Y-%m-%dT%H:%M:%SZ"')
                changed = True
            except (ValueError, OverflowError, OSError):
                pass
        out.append(f"{json.dumps(k, ensure_ascii=False)}:{v}")
    return "{" + ",".join(out) + "}" if changed else value


def rewritten(value: Column, fields: list[str] | None = None, human_timestamps: bool = False) -> Column:
    """The records' JSON with kept fields and readable times."""
    kept = None if fields is None else frozenset(fields)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(v: str) -> str:
            v = v if kept is None else whitelisted(v, kept)
            return readable_times(v) if human_timestamps else v

        return values.map(one, na_action="ignore")

    return run(value) if fields is not None or human_timestamps else value


def unmatched_fields(records: DataFrame, fields: list[str]) -> list[str]:
    """Fields that no record has: likely misspelt."""
    seen = records.agg(*[F.max(F.array_contains(F.json_object_keys("value"), f).cast("int")).alias(f"f{k}") for k, f in enumerate(fields)]).first()
    return [f for f, s in zip(fields, seen, strict=True) if not s]


def selector(s: str) -> str:
    """JSON pointer of a column selector: a top-level name, a dotted path, or a pointer (/p or json:/p)."""
    s = s.strip()
    if not s:
        raise ValueError("a selector is empty")
    if s.startswith("json:"):
        s = s[5:]
    if s.startswith("/") or s == "":
        pointer.paths(s)
        return s
    parts = s.split(".")
    if any(not p for p in parts):
        raise ValueError(f"an empty part in {s!r}")
    return "/" + "/".join(p.replace("~", "~0").replace("/", "~1") for p in parts)


def cell(j: Column, s: str) -> Column:
    """Text of a cell: null and missing are empty, containers are compact JSON."""
    p = selector(s)
    x = pointer.resolve(j, p)
    if not s.startswith(("/", "json:")) and "." in s:  # dotted paths go through objects only
        x = F.coalesce(*[F.try_variant_get(j, "$" + "".join(f'["{t}"]' for t in pointer.tokens(p)), "variant")])
    return F.coalesce(pointer.key_text(x), F.lit(""))


def tabular(records: DataFrame, selectors: list[str]) -> DataFrame:
    """One text column a selector."""
    return records.select(*[cell(F.col("j"), s).alias(s) for s in selectors])


def typed_rows(records: DataFrame) -> DataFrame:
    """The typed fields and payload, the raw line."""
    from talkmill.sources.records import FIELDS

    return records.select(*FIELDS, F.col("value").alias("payload"))


def is_comment(j: Column) -> Column:
    return pointer.exists(j, "/body") & pointer.exists(j, "/parent_id")
