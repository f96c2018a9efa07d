"""JSON Pointers (RFC 6901) as expressions over a VARIANT column, with two-valued predicates: a path that is missing is false."""

from __future__ import annotations

import itertools
import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as Rust and JSON spell it; Spark's casts would take more.
NUMERIC = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
MAX_FORMS = 4


def tokens(pointer: str) -> list[str]:
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise ValueError(f"a JSON pointer is empty or starts with /: {pointer!r}")
    if re.search(r"~(?![01])", pointer):
        raise ValueError(f"~ is followed by 0 or 1 in a JSON pointer: {pointer!r}")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/")]


def _key(token: str) -> str:
    if '"' in token and "'" in token:
        raise ValueError(f"a key with both kinds of quotes can't be addressed: {token!r}")
    return f"['{token}']" if '"' in token else f'["{token}"]'


def paths(pointer: str) -> list[str]:
    """Variant paths of a pointer: an index token is an array index or an object key."""
    forms = [[f"[{t}]", _key(t)] if re.fullmatch(r"0|[1-9]\d{0,8}", t) else [_key(t)] for t in tokens(pointer)]
    out = ["$" + "".join(p) for p in itertools.product(*forms)]
    if len(out) > MAX_FORMS:
        raise ValueError(f"too many index tokens in {pointer!r}")
    return out


def resolve(j: Column, pointer: str) -> Column:
    """The variant at the pointer; NULL only if it is missing (a JSON null is a variant)."""
    found = [F.try_variant_get(j, p, "variant") for p in paths(pointer)]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def field(j: Column, name: str) -> Column:
    return F.try_variant_get(j, "$" + _key(name), "variant")


def kind(x: Column) -> Column:
    """null, bool, number, string, array or object; NULL if missing."""
    t = F.schema_of_variant(x)
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(t == "VOID", "null")
        .when(t == "BOOLEAN", "bool")
        .when(t == "STRING", "string")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def text(x: Column) -> Column:
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def number(x: Column) -> Column:
    """A finite number or numeric string as a double."""
    t = F.schema_of_variant(x)
    s = F.trim(F.try_variant_get(x, "$", "string"))
    v = F.when(t.isin("BIGINT", "DOUBLE") | t.startswith("DECIMAL"), F.try_variant_get(x, "$", "double")).when((t == "STRING") & s.rlike(NUMERIC), s.try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def long(x: Column) -> Column:
    """An integer, an integral float, or a string of either, if it fits 64 bits."""
    # a lambda keeps the rare forms out of the generated code: the JVM doesn't compile methods above 8,000 bytes, which two of them exceed
    rare = F.get(F.transform(F.array(x), _long_of_other), 0)
    return F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint")).when(x.isNotNull(), rare)


def _long_of_other(x: Column) -> Column:
    t = F.schema_of_variant(x)
    s = F.try_variant_get(x, "$", "string")
    d, dec, f = F.try_variant_get(x, "$", "double"), F.try_variant_get(x, "$", "decimal(38,18)"), s.try_cast("double")
    whole = F.when(F.abs(f) < 9.223372036854775e18, F.when(f == F.floor(f), f.try_cast("bigint")))
    of_text = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("decimal(38,0)").try_cast("bigint")).when(s.rlike(NUMERIC), whole)
    return (
        F.when(t == "STRING", of_text)
        .when(t.startswith("DECIMAL"), F.when(dec == F.floor(dec), dec.try_cast("bigint")))
        .when(t == "DOUBLE", F.when((d == F.floor(d)) & (F.abs(d) < 9.223372036854775e18), d.try_cast("bigint")))
    )


def boolean(x: Column) -> Column:
    return F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))


def key_text(x: Column) -> Column:
    """Text of a group key: a string itself, else its compact JSON; NULL for null and missing."""
    t = F.schema_of_variant(x)
    return F.when(t == "STRING", F.try_variant_get(x, "$", "string")).when(t != "VOID", F.to_json(x))


def tagged(x: Column) -> Column:
    """Text that tells "1" from 1; NULL for null and missing."""
    return F.concat(F.substring(kind(x), 1, 1), F.lit(":"), key_text(x))


def yes(c: Column) -> Column:
    """NULL is false, so that NOT keeps what a predicate can't decide."""
    return F.coalesce(c, F.lit(False))


def exists(j: Column, pointer: str) -> Column:
    return resolve(j, pointer).isNotNull()


def equals(j: Column, pointer: str, value: object) -> Column:
    """Scalars: numbers compare as doubles, a number and a numeric string too; strings exactly; null and booleans by kind."""
    x = resolve(j, pointer)
    if value is None:
        return yes(kind(x) == "null")
    if isinstance(value, bool):
        return yes(boolean(x) == value)
    if isinstance(value, (int, float)):
        return yes(number(x) == F.lit(float(value)))
    if not isinstance(value, str):
        raise ValueError(f"only scalars can be compared: {value!r}")
    same = text(x) == value
    if re.fullmatch(NUMERIC.replace("$", ""), value.strip()):
        same = yes(same) | yes((kind(x) == "number") & (number(x) == float(value)))
    return yes(same)


def compare(j: Column, pointer: str, op: str, value: float) -> Column:
    x, v = number(resolve(j, pointer)), F.lit(float(value))
    return yes({">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[op])


def matches(j: Column, pointer: str, pattern: str) -> Column:
    return yes(text(resolve(j, pointer)).rlike(pattern))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def parse_value(raw: str) -> object:
    """A JSON scalar, else the text itself."""
    try:
        v = json.loads(raw)
    except ValueError:
        return raw
    return raw if isinstance(v, (list, dict)) else v
