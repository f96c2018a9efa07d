"""Queries: a flat conjunction of filters, validated before anything is read and compiled to one boolean column.

Every atom is two-valued (what is missing is false), cheap typed tests come before JSON paths, and long id lists become semi joins.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import months, pointer, text

PSEUDO_USERS = ("", "[deleted]", "[removed]")
COMMON_BOTS = tuple("automoderator autowikibot discordbot gifvbot github-actions[bot] helper-bot imguralbumbot remindmebot slackbot totesmessenger tweet_poster video_link_bot".split())
#: Ids and names above this are joined instead of listed in the expression.
LIST_LIMIT = 500
TEXTS = ("body", "selftext", "title")


class QueryError(ValueError):
    """A query that can't be built."""


def clean_name(name: str) -> str:
    n = name.strip().lower()
    return n[2:] if n.startswith("r/") else n


def clean_id(x: str) -> tuple[str | None, str]:
    """(t1, t3 or None for any kind; bare id in lower case)."""
    x = x.strip().lower()
    return (x[:2], x[3:]) if x[:3] in ("t1_", "t3_") else (None, x)


def read_ids(path: str) -> list[str]:
    """One id a line; blank lines and comments after # are left out."""
    return [x for line in Path(path).read_text().splitlines() if (x := line.split("#")[0].strip())]


def check_regex(pattern: str) -> str:
    if not pattern.strip():
        raise QueryError("a regular expression is blank")
    if re.search(r"\(\?(=|!|<=|<!)|(?<!\\)(\\\\)*\\([1-9]|k<)", pattern):
        raise QueryError(f"look-around and back references aren't supported: {pattern!r}")
    try:
        re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
    except re.error as e:
        raise QueryError(f"bad regular expression {pattern!r}: {e}") from e
    return pattern


def environment_exclusions() -> list[str]:
    """Names in ETL_EXCLUDE_AUTHORS and in the file of ETL_EXCLUDE_AUTHORS_FILE."""
    out = re.split(r"[,;\s]+", os.environ.get("ETL_EXCLUDE_AUTHORS", ""))
    if at := os.environ.get("ETL_EXCLUDE_AUTHORS_FILE"):
        try:
            out += read_ids(at)
        except OSError as e:
            raise QueryError(f"can't read {at}: {e}") from e
    return [clean_name(x) for x in out if x.strip()]


@dataclass(frozen=True)
class Predicate:
    """op: exists, =, !=, >, >=, <, <= or ~= at a JSON pointer."""

    pointer: str
    op: str
    value: object = None

    def column(self, j: Column) -> Column:
        p = self.pointer
        if self.op == "exists":
            return pointer.exists(j, p)
        if self.op == "=":
            return pointer.equals(j, p, self.value)
        if self.op == "!=":
            return pointer.exists(j, p) & ~pointer.equals(j, p, self.value)
        if self.op == "~=":
            return pointer.matches(j, p, str(self.value))
        return pointer.compare(j, p, self.op, float(self.value))

    def checked(self) -> Predicate:
        try:
            pointer.paths(self.pointer)
        except ValueError as e:
            raise QueryError(str(e)) from e
        if self.op == "~=":
            check_regex(str(self.value))
        elif self.op in (">", ">=", "<", "<="):
            try:
                ok = abs(float(self.value)) != float("inf") and float(self.value) == float(self.value)
            except (TypeError, ValueError):
                ok = False
            if not ok:
                raise QueryError(f"{self.op} needs a finite number, not {self.value!r}")
        elif self.op not in ("exists", "=", "!="):
            raise QueryError(f"unknown operator {self.op!r}")
        return self


def parse_predicate(raw: str) -> Predicate:
    """exists:/p or /p OP value: the earliest operator counts, at one place the longest; the value is a JSON scalar, else text."""
    s = raw.strip()
    if s.startswith("exists:"):
        return Predicate(s[7:].strip(), "exists").checked()
    m = re.search(r"!=|>=|<=|~=|=|>|<", s)
    if not m or not s.startswith("/") and m.start():
        raise QueryError(f"not a JSON predicate: {raw!r}")
    p, v = s[: m.start()].strip(), s[m.end() :].strip()
    return Predicate(p, m[0], v if m[0] == "~=" else pointer.parse_value(v)).checked()


@dataclass(frozen=True)
class Query:
    """All filters hold; within a list one suffices unless said otherwise."""

    subreddits: tuple[str, ...] | None = None
    ids: tuple[str, ...] | None = None
    authors: tuple[str, ...] | None = None
    exclude_authors: tuple[str, ...] | None = None
    exclude_common_bots: bool = False
    include_pseudo_users: bool = False
    author_regex: str | None = None
    min_score: int | None = None
    max_score: int | None = None
    after: int | None = None
    before: int | None = None
    start_month: str | None = None
    end_month: str | None = None
    keywords_any: tuple[str, ...] | None = None
    keywords_all: tuple[str, ...] | None = None
    exclude_keywords: tuple[str, ...] | None = None
    text_regex: str | None = None
    contains_url: bool = False
    no_url: bool = False
    domains: tuple[str, ...] | None = None
    json: tuple[Predicate, ...] = ()
    where: Column | None = field(default=None, compare=False)

    def build(self) -> Query:
        """Normalised and validated; the bots' names are merged into exclude_authors."""

        def names(what: str, clean=clean_name) -> tuple[str, ...] | None:
            given = getattr(self, what)
            if given is None:
                return None
            if isinstance(given, str):
                given = (given,)
            if not given:
                raise QueryError(f"{what} is empty")
            out = [clean(x) for x in given]
            if any(not x for x in out):
                raise QueryError(f"{what} has a blank entry")
            return tuple(sorted(set(out)))

        low = lambda x: x.strip().lower()
        out_names = names("exclude_authors")
        if self.exclude_common_bots:
            out_names = tuple(sorted({*(out_names or ()), *COMMON_BOTS, *environment_exclusions()}))
        ids = None
        if self.ids is not None:
            got = [clean_id(x) for x in self.ids]
            if not got or any(not x for _, x in got):
                raise QueryError("ids is empty or has a blank entry")
            if len(set(got)) < len(got):
                raise QueryError("ids has an entry twice")
            ids = tuple(sorted(f"{k}_{x}" if k else x for k, x in got))
        q = replace(
            self, subreddits=names("subreddits"), ids=ids, authors=names("authors"), exclude_authors=out_names, keywords_any=names("keywords_any", low),
            keywords_all=names("keywords_all", low), exclude_keywords=names("exclude_keywords", low), domains=names("domains", low), json=tuple(p.checked() for p in self.json),
        )
        for r in (q.author_regex, q.text_regex):
            if r is not None:
                check_regex(r)
        if q.min_score is not None and q.max_score is not None and q.min_score > q.max_score:
            raise QueryError("min_score is above max_score")
        if q.after is not None and q.before is not None and q.after >= q.before:
            raise QueryError("after isn't before before")
        for m in (q.start_month, q.end_month):
            if m is not None:
                months.parse_month(m)
        if q.start_month and q.end_month and q.start_month > q.end_month:
            raise QueryError("the month range is empty")
        if both := set(q.authors or ()) & set(q.exclude_authors or ()):
            raise QueryError(f"authors both asked for and excluded: {', '.join(sorted(both))}")
        if q.contains_url and q.no_url:
            raise QueryError("contains_url and no_url exclude each other")
        return q

    def kinds(self) -> tuple[str, ...]:
        """Sources that can match: ids that all name one kind narrow them."""
        seen = {clean_id(x)[0] for x in self.ids or ()}
        return ("comment",) if seen == {"t1"} else ("submission",) if seen == {"t3"} else ("comment", "submission")

    def month_range(self) -> tuple[str | None, str | None]:
        """Months of files that can hold a match, from the month range and the time bounds."""
        starts = [m for m in (self.start_month, None if self.after is None else months.month_of(max(self.after, 0))) if m]
        ends = [m for m in (self.end_month, None if self.before is None else months.month_of(max(self.before - 1, 0))) if m]
        return max(starts, default=None), min(ends, default=None)

    def unfiltered(self) -> bool:
        return self == Query(include_pseudo_users=self.include_pseudo_users, exclude_common_bots=self.exclude_common_bots)

    def needs_json(self) -> bool:
        return bool(self.json)

    def column(self) -> Column:
        """The condition over the columns of records, ids excepted if there are too many for a list."""
        c, yes, lit = F.col, pointer.yes, F.lit
        name = F.lower(c("author"))
        parts = [c("subreddit").isNotNull() & c("author").isNotNull()]
        if self.ids and len(self.ids) <= LIST_LIMIT:
            got = [clean_id(x) for x in self.ids]
            rid, of = text.bare_id(c("id")), lambda k: [x for kind, x in got if kind == k]
            parts.append(yes(rid.isin(of(None)) | (c("kind") == "comment") & rid.isin(of("t1")) | (c("kind") == "submission") & rid.isin(of("t3"))))
        if self.subreddits:
            parts.append(yes(F.lower(c("subreddit")).isin(*self.subreddits)))
        if not self.include_pseudo_users:
            parts.append(~yes(text.ascii_lower(c("author")).isin(*PSEUDO_USERS)))
        if self.exclude_authors and len(self.exclude_authors) <= LIST_LIMIT:
            parts.append(~yes(name.isin(*self.exclude_authors)))
        if self.authors and len(self.authors) <= LIST_LIMIT:
            parts.append(yes(name.isin(*self.authors)))
        if self.author_regex:
            parts.append(yes(c("author").rlike(self.author_regex)))
        bounds = [("score", ">=", self.min_score), ("score", "<=", self.max_score), ("created_utc", ">=", self.after), ("created_utc", "<", self.before)]
        bounds += [("created_utc", ">=", self.start_month and months.first_second(self.start_month)), ("created_utc", "<", self.end_month and months.first_second(months.shift(self.end_month, 1)))]
        for f, op, v in bounds:
            if v is not None:
                parts.append(yes({">=": c(f) >= lit(v), "<=": c(f) <= lit(v), "<": c(f) < lit(v)}[op]))
        if self.domains:
            parts.append(yes(F.lower(c("domain")).isin(*self.domains)))
        hit = lambda k: pointer.any_of([yes(text.has(c(f), k)) for f in TEXTS])
        if self.keywords_any:
            parts.append(pointer.any_of([hit(k) for k in self.keywords_any]))
        parts += [hit(k) for k in self.keywords_all or ()]
        if self.exclude_keywords:
            parts.append(~pointer.any_of([hit(k) for k in self.exclude_keywords]))
        if self.text_regex:
            parts.append(pointer.any_of([yes(c(f).rlike(self.text_regex)) for f in TEXTS]))
        if self.contains_url or self.no_url:
            parts.append(has_url() if self.contains_url else ~has_url())
        parts += [p.column(c("j")) for p in self.json]
        if self.where is not None:
            parts.append(yes(self.where))
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def apply(self, records: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """The matching records, with the same columns. ids: more ids to ask for, (kind or null for any, bare id) of any number."""
        spark, out = records.sparkSession, records.where(self.column())
        for given, how in ((self.authors, "left_semi"), (self.exclude_authors, "left_anti")):
            if given and len(given) > LIST_LIMIT:
                names = spark.createDataFrame([(x,) for x in given], "__name string")
                out = out.join(names, F.lower(F.col("author")) == F.col("__name"), how)
        if self.ids and len(self.ids) > LIST_LIMIT:
            kind = {"t1": "comment", "t3": "submission"}
            rows = [(k, x) for t, x in map(clean_id, self.ids) for k in ([kind[t]] if t else kind.values())]
            listed = spark.createDataFrame(rows, "__kind string, __id string").distinct()
            out = out.join(listed, (F.col("kind") == F.col("__kind")) & (text.bare_id(F.col("id")) == F.col("__id")), "left_semi")
        if ids is not None:
            wanted = ids.select(F.explode(F.when(F.col("kind").isNull(), F.array(F.lit("comment"), F.lit("submission"))).otherwise(F.array("kind"))).alias("__kind"), text.bare_id(F.col("id")).alias("__id"))
            out = out.join(wanted, (F.col("kind") == F.col("__kind")) & (text.bare_id(F.col("id")) == F.col("__id")), "left_semi")
        return out


def has_url() -> Column:
    """A text with http in it, or a link of its own: url starts with http and the record isn't a self-post."""
    yes, c = pointer.yes, F.col
    own = yes(text.ascii_lower(c("url")).startswith("http")) & ~yes(c("is_self")) & ~yes((F.lower(c("domain")) == "self") | F.lower(c("domain")).startswith("self."))
    return pointer.any_of([yes(F.contains(text.ascii_lower(c(f)), F.lit("http"))) for f in TEXTS]) | own
