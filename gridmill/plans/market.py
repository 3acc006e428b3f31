"""Acceptances to minute grid to hourly output to averages to daily figures."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions.ratios import banded_ratio, minute_energy, segment_energy, share_ratio
from gridmill.functions.times import day_window, hour_bucket
from gridmill.operators.aggregates import group_avg
from gridmill.operators.intervals import (
    hourly_sum,
    lead_segments,
    minute_grid,
    moment_slices,
    nonneg_levels,
    override_energy,
    point_slices,
)
from gridmill.operators.joins import densify, eligible_output, not_yet_loaded, selected_units, within
from gridmill.operators.latest import dedup, last_by
from gridmill.operators.slices import Slices
from gridmill.operators.tablesync import append_if_newer, reload_day, zero_fill
from gridmill.operators.trailing import HOURS, trailing_hours_avg, trailing_months_avg
from gridmill.session import cut_lineage
from gridmill.sources.messages import parse_acceptance_messages

# Fixed value: days of hourly output that a run of the averages looks back over.
AVERAGE_DAYS = 5
ACCEPTANCE = ("acceptance_id", "acceptance_time", "ad", "np")


def minute_output(
    points: DataFrame,
    unit: str = "bm_unit_id",
    keys: Sequence[str] = ("bm_unit_id", *ACCEPTANCE),
    carry: Sequence[str] = (),
    start: datetime | None = None,
    end: datetime | None = None,
    slices: Slices | None = None,
) -> DataFrame:
    """Per unit and minute, the latest acceptance in force and the energy of the minute.

    points: keys, carry, time_gmt, va_level; unit and the acceptance columns are among
    keys and carry. The slices are cut on the points, unless they are given.
    """
    if start is not None:
        points = points.where(F.col("time_gmt") >= F.lit(start - timedelta(days=1)).cast("timestamp_ntz"))
    if end is not None:
        points = points.where(F.col("time_gmt") < F.lit(end + timedelta(days=1)).cast("timestamp_ntz"))
    if slices is None:
        slices = point_slices(points, "time_gmt", "va_level", carry)
    unique = dedup(points, [*keys, "time_gmt"], "va_level", carry)
    segments = lead_segments(unique, keys, "time_gmt", "va_level", carry, slices)
    grid = minute_grid(nonneg_levels(segments), start=start, end=end)
    cols = [
        "acceptance_id", "ad", "np", "from_time", "from_level", "to_time", "to_level",
    ]
    latest = last_by(grid, [unit, "avg_time"], "acceptance_time", cols)
    return latest.withColumn("avg_level", minute_energy("from_level", "to_level"))


def hourly_output(
    schedule: DataFrame,
    minutes: DataFrame,
    loaded: DataFrame | None = None,
    unit: str = "bm_unit_id",
    group: Sequence[str] = ("sett_period", "fpn_date"),
    slices: Slices | None = None,
) -> DataFrame:
    """Scheduled energy, overridden by accepted minutes, per unit and hour of its start.

    schedule: unit, from_time, from_level, to_time, to_level and the group columns;
    minutes: unit, avg_time, avg_level, one row a minute at most. Hours already in
    `loaded` are left out. The slices are cut on the schedule, unless they are given.
    """
    if slices is None:
        slices = moment_slices(schedule, "from_time")
    energy = segment_energy("from_level", "to_level", "from_time", "to_time")
    planned = nonneg_levels(schedule).withColumn("energy", energy)
    done = override_energy(
        planned, minutes, unit, "from_time", "to_time", "energy", "avg_time", "avg_level",
        group, slices,
    )
    hourly = hourly_sum(done, hour_bucket("from_time"), unit, "output")
    if loaded is not None:
        hours = within(schedule, hour_bucket("from_time"), "avg_datehour")
        hourly = not_yet_loaded(hourly, loaded, ["avg_datehour", unit], hours)
    return hourly


def hourly_from_messages(
    lines: DataFrame,
    schedule: DataFrame,
    loaded: DataFrame,
    day: datetime,
    group: Sequence[str] = ("sett_period", "fpn_date"),
) -> DataFrame:
    """The day's new hourly output straight from market messages and the schedule."""
    end = day + timedelta(days=1)
    minutes = minute_output(
        parse_acceptance_messages(lines), start=day, end=end - timedelta(minutes=1)
    )
    today = day_window(schedule, "from_time", day.date())
    return hourly_output(today, minutes, loaded, group=group)


def unit_averages(
    hourly: DataFrame,
    units: DataFrame,
    loaded: DataFrame | None,
    unit: str,
    unit_cols: Sequence[str],
    factors: Sequence[str],
    as_of: datetime | None = None,
    hours: Sequence[int] = HOURS,
) -> DataFrame:
    """Output and trailing averages of eligible unit hours that are not yet loaded.

    as_of limits the result to the last days; the frames still reach back behind it. Of
    what is loaded only the hours in question are read.
    """
    known = within(hourly, "avg_datehour", "avg_datehour") if loaded is not None else None
    if as_of is not None:
        since = as_of - timedelta(days=AVERAGE_DAYS)
        oldest = since - timedelta(hours=max(hours))
        hourly = hourly.where(F.col("avg_datehour") > F.lit(oldest).cast("timestamp_ntz"))
    # All hours of the unit count, also those before it came online, so the frames come
    # first. Repeated rows of an hour average to one output.
    rows = trailing_hours_avg(hourly, unit, "avg_datehour", "output", hours, row_mean="_mean")
    rows = rows.withColumn("output", F.col("_mean")).drop("_mean")
    if as_of is not None:
        rows = rows.where(F.col("avg_datehour") > F.lit(since).cast("timestamp_ntz"))
    rows = eligible_output(rows, units, unit, "avg_datehour", "online_date")
    if loaded is not None:
        rows = not_yet_loaded(rows, loaded, [unit, "avg_datehour"], known)
    values = ["output", *[f"avg{n}hour" for n in hours], *factors]
    return group_avg(rows, [unit, "avg_datehour", *unit_cols], values)


@dataclass(frozen=True)
class DailyRun:
    """The tables as a run leaves them."""

    hourly: DataFrame
    averages: DataFrame
    figures: DataFrame
    daily: DataFrame


def daily_run(
    hourly: DataFrame,
    units: DataFrame,
    averages: DataFrame,
    figures: DataFrame,
    daily: DataFrame,
    as_of: datetime,
    to_figures: Callable[[DataFrame], DataFrame],
    to_daily: Callable[[DataFrame], DataFrame],
    unit: str,
    unit_cols: Sequence[str],
    factors: Sequence[str],
    period_cols: Sequence[str],
    value: str,
    fill_cols: Sequence[str] = (),
    skip: Sequence[str] = (),
) -> DailyRun:
    """From hourly output to daily figures, the run of one day.

    Included units get zero output for the last hours that they lack. Averages of hours
    that `averages` lacks are added to it. Of the hourly figures, those later than the
    newest are added. Yesterday's daily figures are taken out and all later than what is
    left put in, and included units without a figure on the newest day get zero.

    to_figures makes hourly figures of averages and to_daily daily ones of those (views of
    the database: their columns are those of figures and daily). Averages, figures and what
    comes of them are written once each to the shared folder, as later steps read them more
    than once; nothing else is kept, and the caller publishes the tables.
    """
    chosen = selected_units(units, unit, skip)
    zeros = densify(hourly, chosen, unit, "avg_datehour", "output", as_of)
    hours = cut_lineage(hourly.unionByName(zeros.select(*hourly.columns)))
    fresh = unit_averages(hours, units, averages, unit, unit_cols, factors, as_of)
    known = cut_lineage(averages.unionByName(fresh.select(*averages.columns)))
    figured = cut_lineage(append_if_newer(to_figures(known), figures, "avg_datehour"))
    days = cut_lineage(reload_day(to_daily(figured), daily, "avg_date", (as_of - timedelta(days=1)).date()))
    filled = zero_fill(days, units, unit, "avg_date", value, period_cols, fill_cols, skip)
    return DailyRun(hours, known, figured, days.unionByName(filled.select(*days.columns)))


def fuel_ratios(df: DataFrame, entity: str = "entity_id", period: str = "period") -> DataFrame:
    """Burn ratio, coal share and their averages over six calendar months."""
    rated = df.withColumn("coal_ratio", banded_ratio("coal_burns", "mwh_coal")).withColumn(
        "coal_factor", share_ratio("mwh_coal", "mwh_other")
    )
    averaged = trailing_months_avg(rated, entity, period, ["coal_ratio", "coal_factor"])
    return averaged.withColumnsRenamed(
        {"coal_ratio_avg": "coal_ratio_6mth_avg", "coal_factor_avg": "coal_factor_6mth_avg"}
    )
