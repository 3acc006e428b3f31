from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from gridmill.functions.ratios import banded_ratio, segment_energy, share_ratio
from gridmill.operators.latest import (
    dedup,
    last_by,
    latest_changes,
    latest_group_values,
    latest_rank_rows,
)
from gridmill.operators.trailing import (
    row_slices,
    trailing_hours_avg,
    trailing_months_avg,
    trailing_rows_avg,
)


def test_last_by_takes_column_wise_max_over_ties(spark):
    df = spark.createDataFrame([("u", 7, 1, 9), ("u", 7, 5, 2), ("u", 6, 99, 99)], "k string, o int, a int, b int")
    assert rows(last_by(df, ["k"], "o", ["a", "b"])) == [("u", 7, 5, 9)]


def test_last_by_all_null_order_gives_nulls(spark):
    df = spark.createDataFrame([("u", None, 1), ("v", None, 2), ("v", 1, None)], "k string, o int, a int")
    assert rows(last_by(df, ["k"], "o", ["a"])) == [("u", None, None), ("v", 1, None)]


def test_dedup_prefers_null(spark):
    df = spark.createDataFrame([("u", None, 1), ("u", 7, 2), ("v", 3, 1), ("v", 4, 0)], "k string, lv int, x int")
    assert rows(dedup(df, ["k"], "lv", ["x"])) == [("u", None, 1), ("v", 4, 0)]


def test_latest_changes_in_range(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 12, "b"), (1, 15, "c"), (2, 9, "d")], "k int, s int, v string")
    assert rows(latest_changes(df, ["k"], "s", 9, 12)) == [(1, 12, "b")]
    assert rows(latest_changes(df, ["k"], "s")) == [(1, 15, "c"), (2, 9, "d")]


def test_latest_rank_rows_keeps_ties_and_separates_schemas(spark):
    df = spark.createDataFrame(
        [("s1", "t", 1), ("s1", "t", 2), ("s1", "t", 2), ("s2", "t", 1)], "s string, t string, r int"
    )
    assert rows(latest_rank_rows(df, ["s", "t"], "r")) == [("s1", "t", 2), ("s1", "t", 2), ("s2", "t", 1)]


def test_latest_group_values(spark):
    df = spark.createDataFrame([(at("01:00"), 1), (at("02:00"), 2), (at("02:00"), 2)], "d timestamp_ntz, w int")
    assert rows(latest_group_values(df, "d", ["w"])) == [(at("02:00"), 2)]


def test_trailing_hours_has_open_old_end_and_fixed_divisor(spark):
    t = at("12:00")
    df = spark.createDataFrame([("u", t - timedelta(hours=3), 9.0), ("u", t, 6.0)], "u string, t timestamp_ntz, v double")
    got = {r.t: r.avg3hour for r in trailing_hours_avg(df, "u", "t", "v", [3]).collect()}
    assert got[t] == 2.0


def test_trailing_hours_sums_repeated_hours(spark):
    df = spark.createDataFrame([("u", at("12:00"), 6.0), ("u", at("12:00"), 0.0)], "u string, t timestamp_ntz, v double")
    got = rows(trailing_hours_avg(df, "u", "t", "v", [3], row_mean="m"))
    assert got == [("u", at("12:00"), 6.0, 3.0, 2.0)]


def test_trailing_rows(spark):
    df = spark.createDataFrame([("u", i, float(i)) for i in range(1, 5)], "u string, o int, v double")
    got = [r.avg3rows for r in trailing_rows_avg(df, ["u"], "o", "v", [3]).orderBy("o").collect()]
    assert got == [1.0, 1.5, 2.0, 3.0]


@pytest.mark.parametrize("per_slice", [1, 7, 40, 1000])
def test_trailing_rows_of_a_hot_key_are_spread_and_exact(spark, per_slice):
    from decimal import Decimal

    data = [("hot", i, Decimal(i * i % 97) / 10 if i % 11 else None) for i in range(300)]
    data += [(k, i, Decimal(i)) for k in ("b", None) for i in (5, 90, 250)] + [("b", None, Decimal(7)), (None, None, Decimal(1))]
    df = spark.createDataFrame(data, "k string, t int, v decimal(18,4)").repartition(3)
    slices = row_slices(df, "t", per_slice)
    assert slices.count == -(-len(data) // per_slice)
    got = trailing_rows_avg(df, ["k"], "t", "v", [1, 3, 12], slices)
    assert got.columns == ["k", "t", "v", "avg1rows", "avg3rows", "avg12rows"]
    df.createOrReplaceTempView("trailing_")
    frame = "OVER (PARTITION BY k ORDER BY t NULLS LAST ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
    mean = f"CAST(sum(v) {frame} AS DOUBLE) / nullif(count(v) {frame}, 0)"
    want = spark.sql(f"SELECT k, t, v, {', '.join(mean.format(n=n - 1) for n in (1, 3, 12))} FROM trailing_")
    assert rows(got) == rows(want)
    if per_slice == 7:
        spread = slices.numbered(df, F.struct(F.col("t").isNull(), F.col("t")), "s").where("k = 'hot'").groupBy("s").count()
        assert spread.count() > 30 and spread.agg(F.max("count")).first()[0] < 20


def test_trailing_months_follow_the_calendar(spark):
    df = spark.createDataFrame(
        [(1, "2024-01", 1.0), (1, "2024-08", 5.0), (1, "2024-06", 3.0), (1, "2024-06", 5.0),
         (2, "2023-11", 2.0), (2, "2024-04", 4.0), (2, "2024-05", None)],
        "e int, p string, v double",
    )
    got = rows(trailing_months_avg(df, "e", "p", ["v"]).select("e", "p", "v", "v_avg"))
    assert got == [
        (1, "2024-01", 1.0, 1.0),
        (1, "2024-06", 3.0, 3.0),
        (1, "2024-06", 5.0, 3.0),
        (1, "2024-08", 5.0, (3.0 + 5.0 + 5.0) / 3),
        (2, "2023-11", 2.0, 2.0),
        (2, "2024-04", 4.0, 3.0),
        (2, "2024-05", None, 4.0),
    ]


def test_trailing_months_null_entity(spark):
    df = spark.createDataFrame([(None, "2024-01", 1.0), (1, None, 1.0)], "e int, p string, v double")
    assert [r.v_avg for r in trailing_months_avg(df, "e", "p", ["v"]).collect()] == [None, None]


def test_banded_ratio(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 10.0), (9.0, 10.0), (91.0, 100.0), (None, 1.0)], "n double, d double")
    got = [r[0] for r in df.select(banded_ratio("n", "d")).collect()]
    assert got == [None, 0.3, 0.9, None, None]


def test_share_ratio(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, None), (0.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(share_ratio("a", "b")).collect()] == [0.25, 1.0, None, None]


def test_segment_energy(spark):
    df = spark.createDataFrame([(60.0, 180.0, at("10:00"), at("10:30"))], "a double, b double, f timestamp_ntz, t timestamp_ntz")
    assert df.select(F.round(segment_energy("a", "b", "f", "t"), 9)).first()[0] == 60.0
