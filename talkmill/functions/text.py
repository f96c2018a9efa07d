"""Text helpers: Unicode trimming, ASCII case folding, ids, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Seconds that date functions accept.
FIRST, LAST = -62_135_596_800, 253_402_300_799


def trim(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def has(c: Column, keyword: str) -> Column:
    """Whether a lower-case keyword occurs, in any case."""
    return F.contains(F.lower(c), F.lit(keyword)) | F.contains(ascii_lower(c), F.lit(keyword))


def bare_id(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim(c)), "^t[13]_", "")


def _when(epoch: Column, pattern: str) -> Column:
    return F.when(epoch.between(FIRST, LAST), F.date_format(F.timestamp_seconds(epoch), pattern))


def month(epoch: Column) -> Column:
    """YYYY-MM in UTC; a time outside the calendar is in 1970-01."""
    return F.when(epoch.isNotNull(), F.coalesce(_when(epoch, "yyyy-MM"), F.lit("1970-01")))


def year(epoch: Column) -> Column:
    return _when(epoch, "yyyy")


def day(epoch: Column) -> Column:
    return _when(epoch, "yyyy-MM-dd")


def hour(epoch: Column) -> Column:
    return _when(epoch, "yyyy-MM-dd'T'HH")


def month_part(epoch: Column) -> Column:
    return _when(epoch, "yyyy-MM")


def rfc3339(epoch: Column) -> Column:
    return _when(epoch, "yyyy-MM-dd'T'HH:mm:ss'Z'")
