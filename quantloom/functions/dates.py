"""Dates and times from the shapes that vendors send."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column) -> Column:
    """The first ten characters as y-m-d, m/d/y or d/m/y, in this order; null where none fits."""
    text = F.substring(F.trim(c.cast("string")), 1, 10)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)).cast("date") for p in ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy")))


def days_between(a: Column, b: Column) -> Column:
    """Calendar days from a to b; -1 where either is no date."""
    return F.coalesce(F.datediff(parse_date(b), parse_date(a)), F.lit(-1))


def from_nanos(c: Column) -> Column:
    """UTC date of a time in nanoseconds."""
    return F.to_date(F.timestamp_micros(F.call_function("div", c, F.lit(1000))))


def in_news_window(ts: Column, start: Column, end: Column, now: Column) -> Column:
    """Half open in UTC: start of the first day up to the end of the last; undated items only when the window is live."""
    dated = (ts >= start) & (ts < F.date_add(end.cast("date"), 1))
    return F.when(ts.isNotNull(), dated).otherwise(end >= F.date_sub(now.cast("date"), 1))


def period_year(label: Column) -> Column:
    """The year that a period label names, or -1."""
    return F.coalesce(F.nullif(F.regexp_extract(label, r"(20[0-9]{2})", 1), F.lit("")).try_cast("int"), F.lit(-1))


def compact_time(c: Column) -> Column:
    """Times as yyyyMMdd'T'HHmm[ss], ISO 8601 or epoch seconds."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmm")), F.try_to_timestamp(c), F.timestamp_seconds(c.try_cast("double")))
