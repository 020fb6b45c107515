"""Date and time functions; the clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_date(c: Column) -> Column:
    """Dates written as yyyy年M月d日 or yyyy/MM/dd."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy年M月d日")), F.try_to_timestamp(c, F.lit("yyyy/MM/dd"))).cast("date")


def reset_time(text: Column, now: Column) -> Column:
    """'resets 10pm': the next time five minutes past that hour, strictly after now; null without a match."""
    found = lambda k: F.regexp_extract(text, r"(?i)resets\s+(\d{1,2})(am|pm)", k)
    hour = F.pmod(found(1).try_cast("int"), F.lit(12)) + F.when(F.lower(found(2)) == "pm", 12).otherwise(0)
    at = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), hour, F.lit(5), F.lit(0))
    return F.when(found(1) != "", F.when(at > now, at).otherwise(at + F.expr("INTERVAL 1 DAY")))


def seconds(ms: Column) -> Column:
    """Milliseconds as whole seconds, halves to the even one."""
    return F.bround(ms / 1000, 0).cast("long")


def most_items(n: Column) -> Column:
    return F.ceil(n * 1.5)


def minutes_left(now: Column, until: Column) -> Column:
    return F.ceil((F.unix_timestamp(until) - F.unix_timestamp(now)) / 60)


def minutes_since(start: Column, now: Column) -> Column:
    return F.bround((F.unix_timestamp(now) - F.unix_timestamp(start)) / 60, 1)


def stamp(ts: Column, kind: str = "log") -> Column:
    return F.date_format(ts, {"log": "yyyy-MM-dd HH:mm:ss", "line": "HH:mm:ss", "file": "yyyyMMdd-HHmmss", "day": "yyyy-MM-dd"}[kind])


def utc_day(ts: Column, zone: str) -> Column:
    """The UTC date of a local wall clock time."""
    return F.to_date(F.to_utc_timestamp(ts, zone))


def missed_run(last: Column, today: Column) -> Column:
    """Days without a run between the last one and today; null if none was missed."""
    days = F.datediff(today, last)
    return F.when(days > 1, days - 1)
