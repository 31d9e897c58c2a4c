"""Dated windows: what is finished, what is open, what comes too late."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.functions.dates import first_open_day, in_window, last_complete_day, window_end

#: Runs of finished days that go into a scan's filter; the anti join removes all others.
PUSHED_RANGES = 8


def completed(ledger: DataFrame) -> DataFrame:
    """Finished windows of a ledger (name, sentinel) with their end date.

    A window without its sentinel, or with another kind of name, is not done.
    """
    return ledger.where(F.col("sentinel")).withColumn("end", window_end(F.col("name"))).where(F.col("end").isNotNull())


def latest_end(ledger: DataFrame) -> DataFrame:
    return completed(ledger).agg(F.max("end").alias("end"))


def open_window(ledger: DataFrame, run_day: dt.date, lookback: int = rules.EVENT_LOOKBACK_DAYS) -> tuple[dt.date, dt.date] | None:
    """(start, end) to read in this run, None when nothing is open.

    Reads one aggregated row of the ledger, so the dates can be literals in the
    scan's filter.
    """
    end = last_complete_day(run_day)
    last = latest_end(ledger).first()["end"]
    if last is not None and last >= end:
        return None
    return first_open_day(run_day, last, lookback), end


def window_plan(ledger: DataFrame, run_day: dt.date, lookback: int = rules.EVENT_LOOKBACK_DAYS) -> DataFrame:
    """:func:`open_window` as one row, without leaving Spark."""
    last = latest_end(ledger)
    end = F.lit(last_complete_day(run_day))
    start = F.coalesce(F.date_add("end", 1), F.date_sub(F.lit(run_day), lookback))
    return last.select(
        F.col("end").alias("last_end"),
        start.alias("start"),
        end.alias("stop"),
        F.coalesce(F.col("end") >= end, F.lit(False)).alias("up_to_date"),
    )


def header_scan(
    headers: DataFrame,
    start: dt.date,
    end: dt.date,
    only: list[str] | None = None,
    time: str = "LogDate",
    event_type: str = "EventType",
) -> DataFrame:
    """Header rows of a window; the daily roll-up only, where it is marked."""
    found = headers.where(in_window(F.col(time), start, end))
    if "Interval" in headers.columns:
        found = found.where(F.col("Interval") == "Daily")
    return found.where(F.col(event_type).isin(*only)) if only else found


def finished_days(ledger: DataFrame, day: str = "day") -> DataFrame:
    """Distinct days of the completed windows; the calendar bounds them."""
    start = F.try_to_date(F.split("name", "_to_")[0], "yyyy-MM-dd")
    windows = completed(ledger).where(start <= F.col("end"))
    return windows.select(F.explode(F.sequence(start, F.col("end"))).alias(day)).distinct()


def finished_ranges(days: DataFrame, day: str = "day", most: int = PUSHED_RANGES) -> list[tuple[dt.date, dt.date]]:
    """The longest runs of successive days, at most ``most``, in order."""
    place = F.row_number().over(Window.orderBy(day))  # one row per day of the calendar
    runs = days.withColumn("run", F.date_sub(F.col(day), place)).groupBy("run").agg(F.min(day).alias("first"), F.max(day).alias("last"))
    longest = runs.orderBy(F.datediff("last", "first").desc(), "first").limit(most)
    return sorted((r["first"], r["last"]) for r in longest.collect())


def unfinished(files: DataFrame, ledger: DataFrame, day: str = "log_date", time: str | None = None) -> DataFrame:
    """Files outside every completed window: repeats of a run do nothing.

    Runs of finished days are literals in the filter, so the scan leaves them out;
    ``time`` names the timestamp that ``day`` was made from, if the scan does not hold
    the day itself.  The anti join removes what these ranges leave.  Files without a
    day belong to no window and stay.
    """
    done = finished_days(ledger, day)
    scanned = files
    column = F.col(time or day)
    for first, last in finished_ranges(done, day):
        kind = files.schema[time or day].dataType
        begin, after = (F.lit(f"{d:%Y-%m-%d}").cast(kind) for d in (first, last + dt.timedelta(days=1)))
        scanned = scanned.where(column.isNull() | (column < begin) | (column >= after))
    return scanned.join(F.broadcast(done), day, "left_anti")  # bounded: one row per day of the calendar


def late_rows(rows: DataFrame, closed_through: dt.date, ts: str = "ts") -> DataFrame:
    """Rows of closed windows; they are reported, never added."""
    return rows.where(F.col(ts) < F.date_add(F.lit(closed_through), 1).cast("timestamp_ntz"))


def daily(rows: DataFrame, ts: str, *keys: str) -> DataFrame:
    """One row per day and key: files, rows and their value."""
    day = F.window(F.col(ts).cast("timestamp"), "1 day")
    return rows.groupBy(day.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.to_date("w.start").alias("day"), *keys, "n"
    )


def split_bad(landed: DataFrame, body: str = "body", names: str = "names") -> tuple[DataFrame, DataFrame]:
    """(usable, skipped) landed files; one bad file never stops a run.

    A file is bad when it was not fetched, or when its first line is not the
    header it was announced with.
    """
    header = F.substring_index(F.col(body), "\n", 1)
    reason = F.when(F.col(body).isNull(), "fetch failed").when(
        F.regexp_replace(header, r'["\r ]', "") != F.regexp_replace(F.col(names), " ", ""), "parse failed"
    )
    marked = landed.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull()).drop(body)
