from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridmill.functions.times import hour_bucket, micros, text_ntz, trunc_ntz

MOMENTS = [datetime(2024, 3, 10, 2, 30, 15, 250_001), datetime(1969, 12, 31, 23, 59, 59, 999_999), datetime(2024, 11, 3, 1, 30), None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in MOMENTS], "t timestamp_ntz")
        units = ["second", "minute", "hour", "day", "month", "year"]
        got = df.select("t", hour_bucket("t").alias("h"), micros("t").alias("m"), text_ntz("t").alias("x"), *[trunc_ntz(u, F.col("t")).alias(u) for u in units]).collect()
        for r in got:
            if r.t is None:
                assert set(r) == {None}
                continue
            assert r.h == r.hour == r.t.replace(minute=0, second=0, microsecond=0)
            assert r.m == (r.t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            assert r.second == r.t.replace(microsecond=0) and r.minute == r.t.replace(second=0, microsecond=0)
            assert r.day == datetime(r.t.year, r.t.month, r.t.day) and r.year == datetime(r.t.year, 1, 1)
            assert r.month == datetime(r.t.year, r.t.month, 1)
            assert r.x.startswith(r.t.isoformat(" ", "seconds"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
