"""Time expressions on TIMESTAMP_NTZ columns; none depends on the session zone."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Units whose start is found by taking parts of the clock off.
_CLOCK = ("second", "minute", "hour")


def trunc_ntz(unit: str, ts: Column | str) -> Column:
    """The start of the unit that a TIMESTAMP_NTZ falls in, in any session zone.

    date_trunc would pass through the session zone, and move times that its summer time
    skips; parts of the clock are taken off instead.
    """
    c = _col(ts)
    if unit not in _CLOCK:
        day = c.cast("date")
        return (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")
    fraction = F.extract(F.lit("SECOND"), c)
    off = {"hours": F.lit(0), "mins": F.lit(0), "secs": fraction}
    if unit == "second":
        off["secs"] = fraction - F.second(c)
    if unit == "hour":
        off["mins"] = F.minute(c)
    return c - F.make_dt_interval(**off)


def hour_bucket(ts: Column | str) -> Column:
    """The hour a moment falls in; a segment belongs to the hour of its start."""
    return trunc_ntz("hour", ts)


def micros(ts: Column | str) -> Column:
    """Microseconds of a TIMESTAMP_NTZ since 1970, in any session zone."""
    c = _col(ts)
    clock = (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000
    seconds = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + clock + seconds


def text_ntz(ts: Column | str) -> Column:
    """2024-01-10 09:30:00, with a fraction where there is one, in any session zone."""
    return _col(ts).cast("string")


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(60_000_000)


def time_chunk(ts: Column | str, seconds: float) -> Column:
    """Number of the fixed-width time slice that holds ts."""
    return F.call_function("div", micros(ts), F.lit(int(seconds * 1_000_000)))


def month_index(period: Column | str) -> Column:
    """'YYYY-MM' as a count of months, so that RANGE frames see calendar gaps."""
    p = _col(period)
    return F.substring(p, 1, 4).cast("int") * 12 + F.substring(p, 6, 2).cast("int")


def day_window(
    df: DataFrame, col: str, day: date, before: int = 0, after: int | None = 0
) -> DataFrame:
    """Rows whose day lies in day-before .. day+after; after=None leaves the end open.

    A half-open range on the raw column, so it reaches the scan.
    """
    low = F.lit(day - timedelta(days=before)).cast("timestamp_ntz")
    kept = df.where(F.col(col) >= low)
    if after is not None:
        kept = kept.where(F.col(col) < F.lit(day + timedelta(days=after + 1)).cast("timestamp_ntz"))
    return kept


def quarter_label(ts: Column | str) -> Column:
    """2024q1"""
    c = _col(ts)
    return F.concat(F.year(c).cast("string"), F.lit("q"), F.quarter(c).cast("string"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
