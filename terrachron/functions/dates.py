"""Dates: packed and lenient decoding, and the order of nearest dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: packed dates up to this one mark old imagery that is not dated.
MIN_JPEG_DATE = 545
MATCHES = ("closest", "before", "after", "exact")


def packed_date(packed: Column) -> Column:
    """``year << 9 | month << 5 | day`` as a date; null where there is no such date."""
    year = F.shiftright(packed.cast("int"), 9)
    month = F.shiftright(packed.cast("int"), 5).bitwiseAND(F.lit(15))
    day = packed.cast("int").bitwiseAND(F.lit(31))
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.between(1, 9999), text.try_cast("date"))


def pack_date(day: Column) -> Column:
    return F.shiftleft(F.year(day), 9) + F.shiftleft(F.month(day), 5) + F.dayofmonth(day)


def lenient_date(value: Column) -> Column:
    """A date from ISO text (its first ten characters) or from epoch milliseconds as text; else null."""
    millis = value.try_cast("long")
    return F.coalesce(F.left(F.trim(value), F.lit(10)).try_cast("date"), F.timestamp_millis(millis).cast("date"))


def as_date(value: str | dt.date | None) -> dt.date | None:
    """A caller's date: ISO text, a date, or a datetime cut to its day."""
    if value is None or (isinstance(value, dt.date) and not isinstance(value, dt.datetime)):
        return value
    return value.date() if isinstance(value, dt.datetime) else dt.date.fromisoformat(value)


def check_match(match: str) -> str:
    if match not in MATCHES:
        raise ValueError(f"unknown date match {match!r}; one of {', '.join(MATCHES)}")
    return match


def matches(day: Column, target: Column, match: str) -> Column:
    """Which rows a match rule leaves: undated ones too, unless it is ``exact``."""
    rule = {"closest": F.lit(True), "before": day <= target, "after": day >= target, "exact": day == target}[check_match(match)]
    return F.coalesce(rule, F.lit(False)) & day.isNotNull() if match == "exact" else day.isNull() | rule


def nearest_first(day: Column, target: Column) -> list[Column]:
    """Order by distance, the older of two equally near first, undated last."""
    return [day.isNull().asc(), F.abs(F.datediff(day, target)).asc_nulls_last(), day.asc_nulls_last()]
