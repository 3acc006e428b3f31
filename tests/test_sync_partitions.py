from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from gridmill.operators.checks import (
    CheckFailed,
    duplicate_keys,
    null_count,
    orphans,
    require_not_null,
    require_parents,
    require_unique,
)
from gridmill.operators.joins import densify
from gridmill.operators.partitions import (
    expired,
    expired_pairs,
    extend_partitions,
    partition_bounds,
    route,
    route_quarter,
    write_routed,
)
from gridmill.operators.tablesync import (
    expire,
    logged_versions,
    append_if_newer,
    append_newer,
    append_to_table,
    current_version,
    full_refresh,
    new_since,
    overwrite_partitions,
    read_current,
    reload_day,
    zero_fill,
)
from gridmill.functions.times import quarter_label
from gridmill.plans.prune import droppable, expired_rows, prune_run
from gridmill.session import create_empty, path_exists, remove_path, work_path
from gridmill.sources.archive import archive_partitions, audit_partitions

ROW = "t timestamp_ntz, v int"


def table(spark, *data):
    return spark.createDataFrame([(at(t) if t else None, v) for t, v in data], ROW)


def test_empty_target_loads_nothing_unless_bootstrapped(spark):
    src, empty = table(spark, ("10:00", 1)), table(spark)
    assert append_newer(src, empty, "t").count() == 0
    assert append_newer(src, empty, "t", bootstrap=True).count() == 1
    assert append_if_newer(src, empty, "t").count() == 0


def test_ties_at_the_watermark_are_not_loaded(spark):
    src = table(spark, ("10:00", 1), ("10:00", 2), ("11:00", 3))
    assert [r.v for r in append_newer(src, table(spark, ("10:00", 1)), "t").collect()] == [3]


def test_watermark_reaches_the_scan(spark):
    path = work_path(spark, "w")
    table(spark, ("10:00", 1), ("11:00", 2)).write.parquet(path)
    df = append_newer(spark.read.parquet(path), table(spark, ("10:30", 0)), "t")
    assert df.count() == 1
    assert "subquery" in df._jdf.queryExecution().executedPlan().toString().lower()


def test_append_to_table_twice(spark):
    path = work_path(spark, "a")
    table(spark, ("10:00", 1)).write.parquet(path)
    src = table(spark, ("10:00", 1), ("11:00", 2), ("12:00", 3))
    first, second = append_to_table(src, path, "t"), append_to_table(src, path, "t")
    assert (first.before, first.after, first.rows) == (at("10:00"), at("12:00"), 2)
    assert second.rows == 0


def test_new_since(spark):
    s = "t timestamp_ntz, l timestamp_ntz"
    src = spark.createDataFrame([(at("10:00"), at("11:00")), (at("10:00"), at("13:00")), (at("2024-01-11 10:00"), at("14:00"))], s)
    dst = spark.createDataFrame([(at("09:00"), at("12:00"))], s)
    assert rows(new_since(src, dst, "l", "t", date(2024, 1, 10))) == [(at("10:00"), at("13:00"))]


def test_reload_day(spark):
    dst = table(spark, ("2024-01-09 10:00", 1), ("10:00", 2))
    src = table(spark, ("2024-01-09 10:00", 9), ("10:00", 8), ("12:00", 7))
    assert rows(reload_day(src, dst, "t", date(2024, 1, 10))) == [
        (at("2024-01-09 10:00"), 1), (at("10:00"), 8), (at("12:00"), 7),
    ]


def test_overwrite_partitions_leaves_other_days(spark):
    path = work_path(spark, "days")
    s = "d string, v int"
    spark.createDataFrame([("x", 1), ("y", 2), ("y", 3)], s).write.partitionBy("d").parquet(path)
    for _ in range(2):
        overwrite_partitions(spark.createDataFrame([("y", 9), ("z", 7)], s), path, "d")
        assert rows(spark.read.parquet(path).select("d", "v")) == [("x", 1), ("y", 9), ("z", 7)]


def test_full_refresh_switches_versions(spark):
    root = work_path(spark, "r")
    assert current_version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        read_current(spark, root)
    assert full_refresh(table(spark, ("10:00", 1)), root, at("10:00")).version == 1
    done = full_refresh(table(spark, ("10:00", 1), ("11:00", 2)), root, at("11:00"))
    assert (done.version, done.source_count, done.target_count) == (2, 2, 2)
    assert read_current(spark, root).count() == 2
    # A version that was written but never logged is not read.
    table(spark).write.parquet(f"{root}/version=3")
    assert read_current(spark, root).count() == 2
    assert full_refresh(table(spark, ("10:00", 1)), root, at("12:00")).version == 3
    assert read_current(spark, root).count() == 1


def test_zero_fill(spark):
    daily = spark.createDataFrame(
        [("a", at("00:00"), 2023, 9, 3.5), ("a", at("00:00"), 2024, 1, 3.5), ("b", at("2024-01-09 00:00"), 2024, 2, 1.0)],
        "u string, d timestamp_ntz, year int, week int, co2 double",
    )
    units = spark.createDataFrame(
        [("a", 1, "A"), ("b", 1, "B"), ("c", 0, "C"), ("T_BPGRD-1", 1, "T")], "u string, include int, name string"
    )
    assert rows(zero_fill(daily, units, "u", "d", "co2", ["year", "week"], ["name"], ["T_BPGRD-1"])) == [
        ("b", "B", at("00:00"), 2024, 1, 0.0)
    ]


def test_densify_repeats_old_hours(spark):
    newest = at("2024-01-10 23:00")
    hourly = spark.createDataFrame(
        [("a", newest, 1.0), ("a", newest - timedelta(hours=72), 2.0), ("a", newest - timedelta(hours=5), 3.0)],
        "u string, h timestamp_ntz, v double",
    )
    units = spark.createDataFrame([("a",), ("b",)], "u string")
    got = densify(hourly, units, "u", "h", "v", as_of=at("2024-01-11 01:00"))
    hours = {r.h for r in got.where("u = 'a'").collect()}
    # 73 hours less two known ones; the oldest lies before the look-back and comes again.
    assert len(hours) == 71 and newest - timedelta(hours=72) in hours
    assert got.where("u = 'b'").count() == 73 and got.where("v <> 0").count() == 0


def test_week_starts_on_monday(spark):
    df = table(spark, ("2024-01-07 23:59", 1), ("2024-01-08 00:00", 2))
    got = {r.v: r.partition_name for r in route(df, "t", "week", "m").collect()}
    assert got == {1: "m_20240101_week", 2: "m_20240108_week"}
    with pytest.raises(ValueError):
        route(df, "t", "day", "m")


def test_route_month_quarter_and_bounds(spark):
    df = table(spark, ("2024-02-10 01:00", 1), ("2024-02-29 01:00", 2))
    assert {r.partition_name for r in route(df, "t", "month", "m").collect()} == {"m_20240201_month"}
    assert {r.partition_name for r in route_quarter(df, "t", "m").collect()} == {"m_2024_Q1"}
    assert df.select(quarter_label("t")).first()[0] == "2024q1"
    assert rows(partition_bounds(df, "t", "month", "m")) == [
        ("m_20240201_month", at("2024-02-01 00:00"), at("2024-03-01 00:00")),
    ]


def test_write_routed(spark):
    path = work_path(spark, "routed")
    df = table(spark, ("2024-01-07 23:59", 1), ("2024-01-08 00:00", 2))
    write_routed(df, path, "t", "week", "m")
    back = spark.read.parquet(path)
    assert {r.partition_name for r in back.collect()} == {"m_20240101_week", "m_20240108_week"}


PART = (
    "schemaname string, tablename string, partitionrank int, partitionrangestart timestamp_ntz,"
    " partitionrangeend timestamp_ntz, partitiontype string, partitionisdefault boolean"
)


def extend(spark, start, end, needed, kind="range", default=False):
    data = [("s", "t", 1, at(start), at(end), kind, False)]
    if default:
        data.append(("s", "t", None, None, None, kind, True))
    got = extend_partitions(spark.createDataFrame(data, PART), at(needed))
    return [tuple(r)[2:] for r in got.orderBy("range_start").collect()]


def test_extend_months_weeks_and_long_steps(spark):
    assert extend(spark, "2024-01-01", "2024-02-01", "2024-03-15") == [
        ("p2024_02_01", at("2024-02-01"), at("2024-03-01"), "ADD"),
        ("p2024_03_01", at("2024-03-01"), at("2024-04-01"), "ADD"),
    ]
    assert extend(spark, "2024-01-01", "2024-01-08", "2024-01-15", default=True) == [
        ("p2024_01_08", at("2024-01-08"), at("2024-01-15"), "SPLIT"),
    ]
    # 128 days are 128 days, though the digits hold a 28.
    assert extend(spark, "2024-01-01", "2024-05-08", "2024-05-09") == [
        ("p2024_05_08", at("2024-05-08"), at("2024-09-13"), "ADD"),
    ]


def test_extend_hours_and_skips(spark):
    assert extend(spark, "2024-01-01 00:00", "2024-01-01 06:00", "2024-01-01 12:30") == [
        ("p2024_01_01_06", at("2024-01-01 06:00"), at("2024-01-01 12:00"), "ADD"),
        ("p2024_01_01_12", at("2024-01-01 12:00"), at("2024-01-01 18:00"), "ADD"),
    ]
    assert extend(spark, "2024-01-01", "2024-02-01", "2024-02-01") == []
    assert extend(spark, "2024-01-01", "2024-02-01", "2024-03-01", kind="list") == []


def test_retention_cutoff_is_inclusive(spark):
    s = "partition_name string, partition_start timestamp_ntz"
    parts = spark.createDataFrame([("m_old", at("2023-11-13")), ("m_at", at("2023-11-20")), ("m_new", at("2023-11-27"))], s)
    as_of = at("2024-01-17 12:00")
    assert {r[0] for r in expired(parts, as_of, 8, "week").collect()} == {"m_old", "m_at"}
    assert expired(parts, as_of, 180, "day").count() == 0
    parent = parts.withColumn("partition_name", F.replace("partition_name", F.lit("m_"), F.lit("b_")))
    got = [(r.partition_name) for r in expired_pairs(parts, parent, as_of, 8, "week").collect()]
    assert got == ["m_old", "b_old", "m_at", "b_at"]


def test_checks(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "a int, b int")
    assert rows(null_count(df, "b")) == [(3, 1)]
    assert rows(duplicate_keys(df, ["a", "b"])) == [(1, 1, 2)]
    with pytest.raises(CheckFailed):
        require_unique(df, ["a"])
    with pytest.raises(Exception, match="must not be NULL"):
        require_not_null(df, "b").collect()
    assert require_not_null(df, "a").count() == 3


def test_orphans_look_in_the_same_partition(spark):
    child = spark.createDataFrame([(1, "w1"), (2, "w1"), (None, "w1")], "b int, w string")
    parent = spark.createDataFrame([(1, "w1"), (2, "w2")], "b int, w string")
    assert rows(orphans(child, parent, "b", ["w"])) == [(2, "w1")]
    assert orphans(child, parent, "b").count() == 0
    require_parents(child, parent, "b")
    with pytest.raises(CheckFailed):
        require_parents(child, parent, "b", ["w"])


def test_two_writers_get_two_versions(spark):
    from concurrent.futures import ThreadPoolExecutor

    root = work_path(spark, "r")
    full_refresh(table(spark, ("10:00", 1)), root, at("10:00"))
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda i: full_refresh(table(spark, *[("10:00", i)] * i), root, at("11:00")), [2, 3, 4]))
    assert len({d.version for d in done}) == 3
    last = max(done, key=lambda d: d.version)
    assert read_current(spark, root).count() == last.target_count
    # A number that another writer has claimed is left to it.
    create_empty(spark, f"{root}/claims/50.other")
    assert full_refresh(table(spark, ("10:00", 1)), root, at("12:00")).version == 51


def test_expire_keeps_the_newest_and_what_still_runs(spark):
    root = work_path(spark, "r")
    for i in range(1, 6):
        full_refresh(table(spark, *[("10:00", 1)] * i), root, at("10:00"))
    table(spark).write.parquet(f"{root}/version=0")
    table(spark).write.parquet(f"{root}/version=9")
    assert expire(spark, root, 2) == [0, 1, 2, 3]
    assert logged_versions(spark, root) == [4, 5] and read_current(spark, root).count() == 5
    assert path_exists(spark, f"{root}/version=9") and not path_exists(spark, f"{root}/version=3")
    assert expire(spark, root, 2) == []
    with pytest.raises(ValueError):
        expire(spark, root, 0)
    assert full_refresh(table(spark, ("10:00", 1)), root, at("11:00")).version == 6
    assert expire(spark, work_path(spark, "none"), 1) == []


WEEKLY = "k int, t timestamp_ntz, v string"


def weekly(spark):
    data = [(i, at(f"2024-01-{1 + i % 28:02d} 10:00"), None if i % 5 == 0 else f"v|{i}\\ \n") for i in range(200)]
    return spark.createDataFrame(data + [(-1, None, "no time")], WEEKLY)


def test_prune_run_proves_each_partition(spark):
    path = work_path(spark, "old")
    audit = prune_run(weekly(spark), path, "t", "week", "msg", at("2024-01-29 00:00"), 1, "week")
    got = audit.orderBy("partition_name").collect()
    assert [r.partition_name for r in got] == ["msg_20240101_week", "msg_20240108_week", "msg_20240115_week", "msg_20240122_week"]
    assert all(r.safe_to_drop and r.n_rows == r.n_archived > 40 for r in got)
    assert [r[0] for r in droppable(audit).collect()] == [r.partition_name for r in got]
    early = prune_run(weekly(spark), work_path(spark, "old"), "t", "week", "msg", at("2024-01-16 00:00"), 7, "day")
    assert [r.partition_name for r in early.orderBy("partition_name").collect()] == ["msg_20240101_week", "msg_20240108_week"]


def test_a_spoiled_partition_is_not_safe_to_drop(spark):
    path = work_path(spark, "old")
    old = expired_rows(weekly(spark), "t", "week", "msg", at("2024-01-29 00:00"), 1, "week")
    archive_partitions(old, path, "partition_name")
    changed, lost, added = (f"{path}/partition_name=msg_202401{d}_week" for d in ("01", "08", "15"))
    # One line changed, one partition lost, one line too many, and a partition no one asked for.
    lines = [r.value for r in spark.read.text(changed).collect()]
    spark.createDataFrame([(x,) for x in [lines[0] + "x", *lines[1:]]], "value string").coalesce(1).write.mode("overwrite").text(changed)
    remove_path(spark, lost)
    spark.createDataFrame([("1|2|3",)], "value string").coalesce(1).write.mode("append").text(added)
    spark.createDataFrame([("1|2|3",)], "value string").write.text(f"{path}/partition_name=other")
    got = {r.partition_name: r for r in audit_partitions(old, path, "partition_name").collect()}
    assert {k: (r.counts_equal, r.content_equal, r.safe_to_drop) for k, r in got.items()} == {
        "msg_20240101_week": (True, False, False), "msg_20240108_week": (False, False, False),
        "msg_20240115_week": (False, False, False), "msg_20240122_week": (True, True, True), "other": (False, False, False),
    }


def test_expired_rows_limit_the_scan(spark):
    path = work_path(spark, "rows")
    weekly(spark).write.parquet(path)
    plan = expired_rows(spark.read.parquet(path), "t", "week", "msg", at("2024-01-16 00:00"), 1, "week")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(t," in plan
