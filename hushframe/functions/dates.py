"""Window names, window bounds and log dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe import rules

_DAY = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"


def log_day(value: Column) -> Column:
    """Day text of an ISO time; other text is cut before its ``T``."""
    parsed = F.date_format(
        F.try_to_timestamp(F.substring(value, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")), "yyyy-MM-dd"
    )
    fallback = F.substring(F.substring_index(value, "T", 1), 1, 10)
    return F.coalesce(parsed, fallback, F.lit(""))


def window_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """Half-open bounds of whole days: [start 00:00, end + 1 day 00:00)."""
    return (
        start.cast("date").cast("timestamp_ntz"),
        F.date_add(end.cast("date"), 1).cast("timestamp_ntz"),
    )


def in_window(ts: Column, start: dt.date, end: dt.date) -> Column:
    """The window as a range on the time column itself, so it is pushed down."""
    low, high = window_bounds(F.lit(start), F.lit(end))
    return (ts >= low) & (ts < high)


def window_name(start: Column, end: Column) -> Column:
    return F.concat_ws("_to_", F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd"))


def window_end(name: Column) -> Column:
    """End date of a window name, NULL when the name is something else."""
    end = F.get(F.split(name, "_to_", 2), F.lit(1))
    return F.when(end.rlike(_DAY), F.try_to_date(end, "yyyy-M-d"))


def last_complete_day(run_day: dt.date) -> dt.date:
    """Yesterday: the run day itself is never complete."""
    return run_day - dt.timedelta(days=1)


def first_open_day(run_day: dt.date, last_done: dt.date | None, lookback: int = rules.EVENT_LOOKBACK_DAYS) -> dt.date:
    """Day after the last finished window, or the cold start."""
    if last_done is None:
        return run_day - dt.timedelta(days=lookback)
    return last_done + dt.timedelta(days=1)
