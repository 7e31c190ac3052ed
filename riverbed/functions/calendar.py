"""Calendar of the business day: UTC+8 all year, no daylight saving."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours that the business day is ahead of UTC (a fixed value).
OFFSET_HOURS = 8


def shift(ts: Column, hours: int) -> Column:
    return ts + F.expr(f"interval {hours} hours")


def local_time(ts: Column) -> Column:
    """The wall clock of the business day at an instant given without zone (UTC)."""
    return shift(ts, OFFSET_HOURS)


def local_day(ts: Column) -> Column:
    return local_time(ts).cast("date")


def local_midnight(day: Column) -> Column:
    """The instant (UTC) at which a business day begins."""
    return day.cast("timestamp_ntz") - F.expr(f"interval {OFFSET_HOURS} hours")


def add_months(day: Column, months: int) -> Column:
    """The same day of another month, or its last day."""
    return F.add_months(day, months)


def week_label(day: Column) -> Column:
    """ISO week as ``2024-W05``."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6
