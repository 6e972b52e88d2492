"""Dates, vague dates and durations. Jobs take ``as_of`` instead of reading the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def as_date(value: dt.date | str | Column) -> Column:
    if isinstance(value, Column):
        return value.cast("date")
    if not isinstance(value, (dt.date, str)):
        raise TypeError(f"not a date: {value!r}")
    return F.lit(value).cast("date")


def overlaps(start: Column | str, end: Column | str, date_from=None, date_to=None) -> Column:
    """A (start, end) date meets the closed range; an open bound is not tested."""
    cond = F.lit(True)
    if date_from is not None:
        cond = cond & (col(end) >= as_date(date_from))
    if date_to is not None:
        cond = cond & (col(start) <= as_date(date_to))
    return cond


def vague_text(start: Column | str, end: Column | str, kind: Column | str) -> Column:
    """Text of a vague date.

    Day (``D``) and day range (``DD``) are evidenced by the source data. Assumed, by the usual
    convention: ``O``/``OO`` month(s), ``Y``/``YY`` year(s), ``Y-`` from, ``-Y`` until, ``U`` unknown.
    """
    start, end, kind = col(start), col(end), col(kind)

    def day(c):
        return F.date_format(c, "dd/MM/yyyy")

    def month(c):
        return F.date_format(c, "MM/yyyy")

    def year(c):
        return F.date_format(c, "yyyy")

    def span(f):
        return F.concat(f(start), F.lit(" to "), f(end))

    return (
        F.when(kind == "D", day(start))
        .when(kind == "DD", span(day))
        .when(kind == "O", month(start))
        .when(kind == "OO", span(month))
        .when(kind == "Y", year(start))
        .when(kind == "YY", span(year))
        .when(kind == "Y-", F.concat(F.lit("From "), year(start)))
        .when(kind == "-Y", F.concat(F.lit("To "), year(end)))
        .otherwise(F.lit("Unknown"))
    )


def duration_seconds(c: Column | str) -> Column:
    """Seconds of an ``HH:MM`` or ``HH:MM:SS`` text; null when it is not such a text."""
    parts = F.split(col(c), ":")
    last = F.when(F.size(parts) == 2, 0.0).otherwise(F.get(parts, F.lit(2)).try_cast("double"))

    def piece(i):
        return F.get(parts, F.lit(i)).try_cast("double")

    return piece(0) * 3600 + piece(1) * 60 + last


def month_day(c: Column | str) -> Column:
    """Calendar day as ``month * 100 + day``."""
    return F.month(col(c)) * 100 + F.dayofmonth(col(c))


def week_start(c: Column | str) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", col(c)).cast("date")


def month_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def day_index(c: Column | str) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(col(c).cast("date"))


def old_quarter(c: Column | str) -> Column:
    """Quarter by ``floor(month / 3)``: five uneven buckets, kept only for comparing with old results."""
    return F.floor(F.month(col(c)) / 3)
