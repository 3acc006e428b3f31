from __future__ import annotations

from datetime import timedelta

from conftest import at, rows
from gridmill.plans.market import (
    fuel_ratios,
    hourly_from_messages,
    hourly_output,
    minute_output,
    unit_averages,
)

KEYS = ["bm_unit_id", "acceptance_id", "acceptance_time", "ad", "np"]


def test_later_acceptance_wins_each_minute(spark):
    schema = "bm_unit_id string, acceptance_id string, acceptance_time timestamp_ntz, ad string, np int, time_gmt timestamp_ntz, va_level double"
    early, late = ("U", "1", at("09:00"), "F", 2), ("U", "2", at("09:30"), "F", 2)
    points = spark.createDataFrame(
        [(*early, at("10:00"), 120.0), (*early, at("10:10"), 120.0), (*early, at("10:10"), 60.0),
         (*late, at("10:05"), 240.0), (*late, at("10:07"), 240.0)],
        schema,
    )
    got = minute_output(points, keys=KEYS, start=at("10:00"), end=at("10:59"))
    levels = {r.avg_time: (r.acceptance_id, r.avg_level) for r in got.collect()}
    assert len(levels) == 11
    assert levels[at("10:04")] == ("1", 2.0)
    assert levels[at("10:05")] == ("2", 4.0) and levels[at("10:07")] == ("2", 4.0)
    assert levels[at("10:08")] == ("1", 2.0)


def test_hourly_output_overrides_and_skips_loaded(spark):
    schedule = spark.createDataFrame(
        [("U", at("10:00"), 60.0, at("10:30"), 60.0, 21, "d"), ("U", at("10:30"), 60.0, at("11:00"), 60.0, 22, "d"),
         ("V", at("10:00"), 0.0, at("10:30"), 0.0, 21, "d"), ("W", at("10:00"), 60.0, at("10:30"), 60.0, 21, "d")],
        "bm_unit_id string, from_time timestamp_ntz, from_level double, to_time timestamp_ntz, to_level double, sett_period int, fpn_date string",
    )
    minutes = spark.createDataFrame([("U", at("10:10"), 3.0), ("U", at("10:11"), 4.0)], "bm_unit_id string, avg_time timestamp_ntz, avg_level double")
    loaded = spark.createDataFrame([("W", at("10:00"))], "bm_unit_id string, avg_datehour timestamp_ntz")
    got = rows(hourly_output(schedule, minutes, loaded).select("avg_datehour", "bm_unit_id", "output"))
    # Half an hour is replaced by 7, the other keeps 1 * 30.
    assert got == [(at("10:00"), "U", 37.0)]


def test_unit_averages_look_back_past_the_cut(spark):
    as_of = at("2024-01-31 00:00")
    first = as_of - timedelta(days=5)
    hourly = spark.createDataFrame(
        [("U", first + timedelta(hours=h), float(v)) for h, v in ((-1, 3), (1, 6), (1, 0), (2, 9))],
        "u string, avg_datehour timestamp_ntz, output double",
    )
    units = spark.createDataFrame(
        [("U", "S", 1.0, first + timedelta(hours=1))] * 2, "u string, station string, ef double, online_date timestamp_ntz"
    )
    loaded = spark.createDataFrame([("U", first + timedelta(hours=2))], "u string, avg_datehour timestamp_ntz")
    got = unit_averages(hourly, units, loaded, "u", ["station"], ["ef"], as_of).collect()
    assert len(got) == 1
    r = got[0]
    # Repeated rows of the hour average to 3; the frame sums them and the hour before.
    assert (r.output, r.avg3hour, r.ef) == (3.0, 3.0, 1.0)


def test_fuel_ratios(spark):
    df = spark.createDataFrame(
        [(1, "2024-01", 10.0, None, 5.0), (1, "2024-02", 10.0, 30.0, 50.0), (1, "2024-03", 0.0, 0.0, 1.0)],
        "entity_id int, period string, mwh_coal double, mwh_other double, coal_burns double",
    )
    got = fuel_ratios(df).orderBy("period").select(
        "coal_ratio", "coal_ratio_6mth_avg", "coal_factor", "coal_factor_6mth_avg"
    )
    assert [tuple(r) for r in got.collect()] == [
        (0.5, 0.5, 1.0, 1.0), (None, 0.5, 0.25, 0.625), (None, 0.5, None, 0.625),
    ]


def test_hourly_from_messages(spark):
    line = (
        "2024:01:10:09:30:05:GMT: subject=X.BM.U.BOALF, message={NK=7,SO=F,TA=2024:01:10:09:29:00:GMT,"
        "AD=F,NP=2,TS=2024:01:10:10:00:00:GMT,VA=120.0,TS=2024:01:10:10:09:00:GMT,VA=120.0}"
    )
    lines = spark.createDataFrame([(line,), ("other",)], "value string")
    schedule = spark.createDataFrame(
        [("U", at("10:00"), 60.0, at("10:30"), 60.0, 21, "d"), ("U", at("2024-01-11 10:00"), 60.0, at("2024-01-11 10:30"), 60.0, 21, "e")],
        "bm_unit_id string, from_time timestamp_ntz, from_level double, to_time timestamp_ntz, to_level double, sett_period int, fpn_date string",
    )
    loaded = spark.createDataFrame([], "bm_unit_id string, avg_datehour timestamp_ntz")
    got = hourly_from_messages(lines, schedule, loaded, at("2024-01-10"))
    # Ten minutes at 2 each replace the planned 30.
    assert rows(got.select("avg_datehour", "bm_unit_id", "output")) == [(at("10:00"), "U", 20.0)]
