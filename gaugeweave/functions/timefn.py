"""Time floors, elapsed time and the date texts of chart titles and ticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def elapsed(unit: str, start: Column, end: Column) -> Column:
    """Whole ``unit`` steps from start to end, truncating."""
    return F.timestamp_diff(unit, start, end).cast("long")


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts).cast(NTZ)


def floor_day(ts: Column) -> Column:
    return F.to_date(ts).cast(NTZ)


def floor_minutes(ts: Column, minutes: int) -> Column:
    """Floor to a divisor of the hour."""
    into = F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts) % F.lit(minutes))
    return (F.date_trunc("MINUTE", ts).cast(NTZ) - into).cast(NTZ)


def floor_monday(ts: Column) -> Column:
    return F.date_sub(F.to_date(ts), F.weekday(ts)).cast(NTZ)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return (ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast(NTZ)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def ordinal_day(ts: Column) -> Column:
    """Day of the month as 1st, 2nd, 3rd, 4th, 11th."""
    d = F.day(ts)
    teen = d.between(11, 13)
    suffix = (
        F.when(teen, "th")
        .when(d % 10 == 1, "st")
        .when(d % 10 == 2, "nd")
        .when(d % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(d.cast("string"), suffix)


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("long"), (s / 60).cast("long") % 60, s % 60)
