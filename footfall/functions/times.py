"""Times, dates and periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours may come without a leading zero ("9:05:07"), which the pattern letter "H" accepts.
TIME_FORMAT = "yyyy-MM-dd H:mm:ss"
CYCLES = ("year", "month", "week", "day")


def parse_time(text: Column) -> Column:
    """Text to time; NULL where the text is no time."""
    return F.try_to_timestamp(text, F.lit(TIME_FORMAT))


def parse_time_ntz(text: Column) -> Column:
    return parse_time(text).cast("timestamp_ntz")


def parse_date_key(text: Column) -> Column:
    """``yyyyMMdd`` to date; NULL where the text is no date."""
    return F.try_to_date(text, "yyyyMMdd")


def format_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def format_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def date_hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH")


def is_before(a: Column, b: Column) -> Column:
    """False, not NULL, where either side is missing."""
    return F.coalesce(a < b, F.lit(False))


def is_after(a: Column, b: Column) -> Column:
    return F.coalesce(a > b, F.lit(False))


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)


def yesterday(as_of: Column) -> Column:
    return F.date_sub(F.to_date(as_of), 1)


def cycle_start(as_of: Column, cycle: str, steps: int) -> Column:
    """Start of the year, month, ISO week or day that lies ``steps`` cycles away from ``as_of``."""
    if cycle not in CYCLES:
        raise ValueError(f"no such cycle: {cycle!r}; use one of {CYCLES}")
    start = F.date_trunc(cycle, as_of)
    if cycle == "year":
        return F.date_trunc("year", F.add_months(start, 12 * steps))
    if cycle == "month":
        return F.date_trunc("month", F.add_months(start, steps))
    days = steps * (7 if cycle == "week" else 1)
    return F.date_trunc("day", F.date_add(start, days))


def _parse_bound(text: str) -> tuple[dt.datetime, bool]:
    """A bound as a time, and whether it names a whole day."""
    text = text.strip()
    if ":" not in text:
        return dt.datetime.strptime(text, "%Y-%m-%d"), True
    return dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S"), False


def within(df: DataFrame, column: str, start: str | None, end: str | None) -> Column:
    """``start <= column <= end``; an end that is a bare date takes in the whole day.

    The bounds become literals of the column's own type, so the scan can push them down.
    """
    kind = df.schema[column].dataType
    value = F.col(column)
    condition = F.lit(True)
    if start is not None:
        low, _ = _parse_bound(start)
        condition = condition & (value >= F.lit(str(low)).cast(kind))
    if end is not None:
        high, whole_day = _parse_bound(end)
        if whole_day:
            condition = condition & (value < F.lit(str(high + dt.timedelta(days=1))).cast(kind))
        else:
            condition = condition & (value <= F.lit(str(high)).cast(kind))
    return condition


def within_days(column: str, start: str | None, end: str | None) -> Column:
    """Day-level version of :func:`within` for a date (partition) column."""
    value = F.col(column)
    condition = F.lit(True)
    if start is not None:
        condition = condition & (value >= F.lit(str(_parse_bound(start)[0].date())).cast("date"))
    if end is not None:
        condition = condition & (value <= F.lit(str(_parse_bound(end)[0].date())).cast("date"))
    return condition


def shift_days(text: str, days: int) -> str:
    """The day of a bound moved by ``days``, as a bare date."""
    return str(_parse_bound(text)[0].date() + dt.timedelta(days=days))


def cycle_periods(as_of: dt.datetime, cycle: str) -> tuple[tuple[str, str], tuple[str, str]]:
    """The running cycle up to ``as_of``, and the whole cycle before it, as inclusive periods."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if cycle == "year":
        start = midnight.replace(month=1, day=1)
        before = start.replace(year=start.year - 1)
    elif cycle == "month":
        start = midnight.replace(day=1)
        before = (start - dt.timedelta(days=1)).replace(day=1)
    elif cycle == "week":
        start = midnight - dt.timedelta(days=midnight.weekday())
        before = start - dt.timedelta(days=7)
    elif cycle == "day":
        start = midnight
        before = start - dt.timedelta(days=1)
    else:
        raise ValueError(f"no such cycle: {cycle!r}; use one of {CYCLES}")
    last_day_before = (start - dt.timedelta(days=1)).date()
    return (str(start), str(as_of.replace(microsecond=0))), (str(before.date()), str(last_day_before))
