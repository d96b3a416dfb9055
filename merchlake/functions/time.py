"""Time buckets, trailing periods and labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def today(as_of: dt.date | dt.datetime | None) -> Column:
    """The reporting day; reports take it as a parameter so that they can be repeated."""
    return F.lit(as_of).cast("date") if as_of is not None else F.current_date()


def bucket(unit: str, ts: Column) -> Column:
    """First day of the week (Monday), month or year of a timestamp."""
    return F.trunc(ts.cast("date"), unit)


def since(ts: Column, as_of: dt.date | dt.datetime | None, *, weeks: int = 0, months: int = 0) -> Column:
    """Condition: not older than the given period before the reporting day."""
    start = F.date_sub(F.add_months(today(as_of), -months), 7 * weeks)
    return ts >= start.cast("timestamp")


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM")


def week_label(day: Column) -> Column:
    """Week of the year counted from 1 January: days 1-7 are week 01."""
    number = F.floor((F.dayofyear(day) - 1) / 7) + 1
    return F.lpad(number.cast("string"), 2, "0")
