from __future__ import annotations

import random
import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from gridmill.operators.intervals import (
    hourly_sum,
    lead_segments,
    minute_grid,
    moment_slices,
    nonneg_levels,
    override_energy,
    point_slices,
)
from gridmill.operators.slices import cut_slices, sums_before

POINT = "u string, t timestamp_ntz, v double"


def test_single_point_makes_no_segment(spark):
    df = spark.createDataFrame([("a", at("10:00"), 1.0)], POINT)
    assert lead_segments(df, ["u"], "t", "v").count() == 0


def test_segments_cross_slices(spark):
    df = spark.createDataFrame(
        [("a", at("10:00"), 1.0), ("a", at("10:30"), 2.0), ("a", at("15:10"), 3.0), ("b", at("10:10"), 9.0)],
        POINT,
    )
    got = rows(lead_segments(df, ["u"], "t", "v", slices=point_slices(df, "t", "v", per_slice=1)))
    assert got == [
        ("a", at("10:00"), 1.0, at("10:30"), 2.0),
        ("a", at("10:30"), 2.0, at("15:10"), 3.0),
    ]


def test_point_without_time_is_no_end(spark):
    df = spark.createDataFrame([("a", at("10:00"), 1.0), ("a", None, 2.0)], POINT)
    assert lead_segments(df, ["u"], "t", "v").count() == 0


@pytest.mark.parametrize("per_slice", [1, 10, 100, 1000])
def test_segments_match_plain_order_with_hot_key_and_ties(spark, per_slice):
    rnd = random.Random(7)
    base = datetime(2024, 1, 10)
    data = [
        ("hot" if rnd.random() < 0.7 else f"u{rnd.randrange(5)}",
         base + timedelta(seconds=rnd.randrange(4000)), float(rnd.randrange(3)), i)
        for i in range(600)
    ]
    want = []
    for key in {d[0] for d in data}:
        own = sorted((t, v, i) for k, t, v, i in data if k == key)
        want += [(key, a[0], a[1], a[2], b[0], b[1]) for a, b in zip(own, own[1:])]
    df = spark.createDataFrame(data, "u string, t timestamp_ntz, v double, i int")
    got = lead_segments(df, ["u"], "t", "v", ["i"], point_slices(df, "t", "v", ["i"], per_slice))
    assert rows(got) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_sums_before_in_levels(spark, levels):
    rnd = random.Random(5)
    slices = sorted({rnd.randrange(1 << 45) for _ in range(30)} | set(range(20)))
    data = [(k, s, rnd.randrange(9)) for k in "ab" for s in slices]
    want = [
        (k, s, sum(n for j, t, n in data if j == k and t < s) if s != slices[0] else None)
        for k, s, _ in data
    ]
    df = spark.createDataFrame(data, "k string, s long, n int")
    got = sums_before(df, ["k"], "s", ["n"], levels)
    assert rows(got) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_slices_hold_about_the_same_and_cut_a_burst(spark):
    base = F.lit(datetime(2024, 1, 10)).cast("timestamp_ntz")
    calm = spark.range(2000).select((base + F.make_dt_interval(secs=F.col("id"))).alias("t"), F.col("id").alias("v"))
    # As many rows again in one and the same moment.
    burst = calm.unionByName(spark.range(2000).select((base + F.expr("INTERVAL 5 MINUTES")).alias("t"), F.col("id").alias("v")))
    order = F.struct("t", "v")
    assert cut_slices(burst, order).count == 1 and cut_slices(burst.limit(0), order).count == 1
    slices = cut_slices(burst, order, per_slice=200)
    held = slices.numbered(burst, order, "s")
    sizes = [r["count"] for r in held.groupBy("s").count().collect()]
    assert slices.count == 20 and len(sizes) == 20 and max(sizes) < 400
    # Slices follow the order.
    found = [r.s for r in held.orderBy("t", "v").collect()]
    assert found == sorted(found) and found[0] == 0 and found[-1] == 19
    assert held.where("t = TIMESTAMP_NTZ '2024-01-10 00:05:00'").select("s").distinct().count() > 8


def test_rows_that_cannot_be_cut_share_a_slice(spark):
    same = spark.range(500).select(F.lit(1).alias("t"), F.lit(None).cast("string").alias("v"))
    order = F.struct("t", "v")
    slices = cut_slices(same, order, per_slice=10)
    assert slices.numbered(same, order, "s").select("s").distinct().count() == 1


def test_no_shuffle_grows_with_different_times(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("u"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"), F.lit(1.0).alias("v"))
    slices = point_slices(df, "t", "v", per_slice=100)
    assert slices.cuts.count() == 1
    plan = lead_segments(df, ["u"], "t", "v", slices=slices)._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", plan)))
    assert dealt == {"u, _slice", "u"}


SEGMENT = "u string, from_time timestamp_ntz, from_level double, to_time timestamp_ntz, to_level double"


def test_boundary_minute_sees_both_segments(spark):
    df = spark.createDataFrame(
        [("a", at("10:00"), 1.0, at("10:05"), 1.0), ("a", at("10:05"), 1.0, at("10:10"), 1.0)], SEGMENT
    )
    grid = minute_grid(df)
    assert grid.where(F.col("avg_time") == F.lit(at("10:05")).cast("timestamp_ntz")).count() == 2
    assert grid.count() == 12


def test_grid_skips_part_minutes_and_respects_reach(spark):
    df = spark.createDataFrame(
        [
            ("a", at("10:00:30"), 1.0, at("10:02:30"), 1.0),
            ("b", at("01:00"), 1.0, at("05:00"), 1.0),
            ("c", at("01:00"), 1.0, at("06:00"), 1.0),
        ],
        SEGMENT,
    )
    got = {r[0]: (r[1], r[2], r[3]) for r in minute_grid(df).groupBy("u").agg(
        F.count(F.lit(1)), F.min("avg_time"), F.max("avg_time")).collect()}
    assert got == {
        "a": (2, at("10:01"), at("10:02")),
        "b": (1, at("03:00"), at("03:00")),
    }


def test_grid_clips_to_range(spark):
    df = spark.createDataFrame([("a", at("2024-01-09 23:58"), 1.0, at("00:03"), 1.0)], SEGMENT)
    got = minute_grid(df, start=at("00:00"), end=at("00:02"))
    assert [r[0] for r in got.orderBy("avg_time").select("avg_time").collect()] == [
        at("00:00"), at("00:01"), at("00:02"),
    ]


def test_nonneg_levels_drops_null_and_negative(spark):
    df = spark.createDataFrame(
        [("a", at("10:00"), -1.0, at("10:05"), 1.0), ("b", at("10:00"), -2.0, at("10:05"), 1.0),
         ("c", at("10:00"), None, at("10:05"), 1.0)],
        SEGMENT,
    )
    assert [r.u for r in nonneg_levels(df).collect()] == ["a"]


PLAN = "u string, f timestamp_ntz, t timestamp_ntz, e double"
READ = "u string, at timestamp_ntz, lv double"


def override(plan, reads, **kw):
    return override_energy(plan, reads, "u", "f", "t", "e", "at", "lv", **kw)


def test_equal_schedule_rows_multiply_the_sum(spark):
    plan = spark.createDataFrame([("a", at("10:00"), at("10:30"), 5.0)] * 2, PLAN)
    reads = spark.createDataFrame([("a", at("10:10"), 4.0)], READ)
    assert rows(override(plan, reads)) == [("a", at("10:00"), at("10:30"), 5.0, 8.0, 8.0)]


def test_no_reading_falls_back(spark):
    plan = spark.createDataFrame([("a", at("10:00"), at("10:30"), 5.0)], PLAN)
    reads = spark.createDataFrame([("a", at("10:31"), 4.0), ("b", at("10:10"), 1.0)], READ)
    assert rows(override(plan, reads)) == [("a", at("10:00"), at("10:30"), 5.0, None, 5.0)]


@pytest.mark.parametrize("per_slice", [3, 50, 10_000])
def test_override_matches_pairwise_join(spark, per_slice):
    rnd = random.Random(3)
    base = datetime(2024, 1, 10)

    def moment():
        return None if rnd.random() < 0.03 else base + timedelta(minutes=rnd.randrange(300))

    plan, reads = [], []
    for _ in range(200):
        u = rnd.choice(["hot", "hot", "b", None])
        plan.append((u, moment(), moment(), float(rnd.randrange(5)), rnd.randrange(2)))
        reads.append((rnd.choice(["hot", "hot", "b", None]), moment(),
                      None if rnd.random() < 0.1 else float(rnd.randrange(-3, 9))))
    p = spark.createDataFrame(plan, PLAN + ", g int")
    r = spark.createDataFrame(reads, READ)
    p.createOrReplaceTempView("p_")
    r.createOrReplaceTempView("r_")
    want = spark.sql(
        """SELECT p_.u, f, t, e, g, sum(CASE WHEN at BETWEEN f AND t THEN lv END) AS matched,
                  coalesce(sum(CASE WHEN at BETWEEN f AND t THEN lv END), e) AS output
           FROM p_ LEFT JOIN r_ ON p_.u = r_.u GROUP BY p_.u, f, t, e, g"""
    )
    slices = moment_slices(p.select(F.explode(F.array("f", "t")).alias("t")), "t", per_slice)
    got = override(p, r, group=["g"], slices=slices)
    assert rows(got) == rows(want)


def test_hourly_sum_leaves_out_zero(spark):
    df = spark.createDataFrame(
        [("a", at("10:10"), 1.5), ("a", at("10:50"), 2.5), ("b", at("10:10"), 1.0), ("b", at("10:20"), -1.0)],
        "u string, t timestamp_ntz, v double",
    )
    hour = F.date_trunc("hour", "t").cast("timestamp_ntz")
    assert rows(hourly_sum(df, hour, "u", "v")) == [(at("10:00"), "a", 4.0)]


def test_decimal_levels(spark):
    plan = spark.createDataFrame([("a", at("10:00"), at("10:30"), 5.0)], PLAN)
    reads = spark.createDataFrame(
        [("a", at("10:10"), Decimal("0.1")), ("a", at("10:20"), Decimal("0.2"))],
        "u string, at timestamp_ntz, lv decimal(18,4)",
    )
    assert override(plan, reads).first().matched == 0.3
