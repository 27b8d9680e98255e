"""Date columns. Sessions run in UTC; `as_of` makes every run repeatable."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# No age reaches back before year 1, so larger counts cannot be dates.
_MAX_DAYS = 3_660_000


def as_timestamp(as_of) -> Column:
    """Accept a datetime, a text or a column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.to_timestamp(F.lit(as_of))


def relative_age(text: Column, as_of) -> Column:
    """Posting time from an age text, counted back from `as_of`.

    Only hours and days move the time; other units mean `as_of` itself. An hour or day
    text without a usable number gives null, which callers route to quarantine.
    """
    now = as_timestamp(as_of)
    number = F.regexp_replace(text, "[^0-9]", "").try_cast("int")
    earliest = F.to_timestamp(F.lit("0001-01-01 00:00:00"))

    def back(limit: int, **unit) -> Column:
        moved = F.when(number <= limit, now - F.make_interval(**unit))
        return F.when(moved >= earliest, moved)

    return (
        F.when(F.contains(text, F.lit("hour")), back(_MAX_DAYS * 24, hours=number))
        .when(F.contains(text, F.lit("day")), back(_MAX_DAYS, days=number))
        .otherwise(now)
    )


def epoch_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def date_display(ts: Column) -> Column:
    """05 of March 2024"""
    return F.date_format(ts, "dd 'of' MMMM yyyy")
