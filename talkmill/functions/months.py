"""Months as YYYY-MM strings (their order is chronological), ranges of them, and the command line's time grammar."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime

_MONTH = re.compile(r"(\d{4})-(\d{2})", re.ASCII)


def parse_month(text: str) -> str:
    m = _MONTH.fullmatch(text)
    if not m or not 1 <= int(m[2]) <= 12:
        raise ValueError(f"not a month of the form YYYY-MM: {text!r}")
    return text


def shift(month: str, by: int) -> str:
    y, m = map(int, month.split("-"))
    n = y * 12 + m - 1 + by
    if not 0 <= n < 12 * 10_000:
        raise ValueError(f"no month {by} from {month}")
    return f"{n // 12:04d}-{n % 12 + 1:02d}"


def months(start: str, end: str) -> Iterator[str]:
    """Start to end, both included; none if start is later."""
    while start <= end:
        yield start
        if start == "9999-12":
            return
        start = shift(start, 1)


def first_second(month: str) -> int:
    y, m = map(int, month.split("-"))
    return int(datetime(max(y, 1), m, 1, tzinfo=UTC).timestamp())


def month_of(epoch: int) -> str:
    return datetime.fromtimestamp(epoch, UTC).strftime("%Y-%m")


def window(month_list: list[str], by: int) -> tuple[str, str]:
    """The range from by months before the first to by after the last."""
    if not month_list:
        raise ValueError("no months")
    return shift(min(month_list), -by), shift(max(month_list), by)


def holes(present: list[str], start: str | None = None, end: str | None = None) -> list[str]:
    """Months that lack between the first and the last present one, within the asked range."""
    if not present:
        return []
    a, z = max(min(present), start or ""), min(max(present), end or "9999-12")
    had = set(present)
    return [m for m in months(a, z) if m not in had]


def as_ranges(month_list: list[str]) -> str:
    """2006-01..2006-03, 2006-07"""
    out: list[list[str]] = []
    for m in sorted(set(month_list)):
        if out and shift(out[-1][1], 1) == m:
            out[-1][1] = m
        else:
            out.append([m, m])
    return ", ".join(a if a == z else f"{a}..{z}" for a, z in out)


def parse_time(text: str) -> int:
    """Epoch seconds of an epoch, an RFC 3339 time (seconds may be left out) or a UTC date."""
    t = text.strip()
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", t):
            return int(datetime.fromisoformat(t).replace(tzinfo=UTC).timestamp())
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:\d{2})", t):
            return int(datetime.fromisoformat(t.replace("z", "Z").replace("t", "T")).timestamp() // 1)
    except ValueError as e:
        raise ValueError(f"not a time: {text!r}") from e
    raise ValueError(f"not a time: {text!r} (epoch seconds, RFC 3339 or YYYY-MM-DD)")
