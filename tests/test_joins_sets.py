from __future__ import annotations

import os

import pytest

from conftest import at, rows
from gridmill.operators import graph
from gridmill.operators.aggregates import (
    active_items,
    capacity_report,
    count_audit,
    data_max,
    over_threshold,
    watermark,
)
from gridmill.operators.graph import DependencyCycle, create_order, dependency_closure, drop_order
from gridmill.operators.joins import (
    eligible_output,
    exclude,
    find_instances,
    latest_backup_pieces,
    not_yet_loaded,
    selected_units,
    semi,
    within,
)
from gridmill.operators.sets import (
    manifest_mismatch,
    manifests_equal,
    missing_files,
    missing_pieces,
    ordered,
    ordered_union,
    require_all,
)
from gridmill.session import work_path


def ints(spark, *data, schema="k int"):
    return spark.createDataFrame([d if isinstance(d, tuple) else (d,) for d in data], schema)


def test_not_in_rules(spark):
    df = ints(spark, 1, 2, None)
    assert rows(exclude(df, ints(spark, 1), "k")) == [(2,)]
    assert exclude(df, ints(spark, 1, None), "k").count() == 0
    assert exclude(df, ints(spark), "k").count() == 3


def test_anti_and_semi(spark):
    df = ints(spark, (1, 1), (1, 2), (None, 1), schema="a int, b int")
    other = ints(spark, (1, 1), (1, 1), schema="a int, b int")
    assert rows(not_yet_loaded(df, other, ["a", "b"])) == [(1, 2), (None, 1)]
    assert rows(semi(df, other, ["a", "b"])) == [(1, 1)]


def test_eligible_output(spark):
    hourly = spark.createDataFrame([("a", at("10:00"), 1.0), ("a", at("12:00"), 2.0), ("x", at("12:00"), 3.0)], "u string, h timestamp_ntz, v double")
    units = spark.createDataFrame([("a", at("12:00"))], "u string, online timestamp_ntz")
    assert [r.v for r in eligible_output(hourly, units, "u", "h", "online").collect()] == [2.0]


def test_selected_units(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("T_BPGRD-1", 1)], "u string, include int")
    assert rows(selected_units(df, "u", ["T_BPGRD-1"])) == [("a",)]


def test_latest_backup_pieces(spark):
    jobs = spark.createDataFrame(
        [(1, 10, at("01:00"), "COMPLETED", "DB INCR"), (2, 10, at("02:00"), "COMPLETED WITH WARNINGS", "DB INCR"),
         (3, 10, at("03:00"), "COMPLETED", "DB INCR"), (4, 10, at("04:00"), "FAILED", "DB INCR"),
         (5, 10, at("05:00"), "COMPLETED", "ARCHIVELOG"), (6, 11, at("06:00"), "COMPLETED", "DB INCR")],
        "session_key int, db_key int, end_time timestamp_ntz, status string, input_type string",
    )
    sets = spark.createDataFrame(
        [(21, 1, 10, 0, "I"), (22, 2, 10, 0, "I"), (23, 3, 10, 1, "I"), (24, 4, 10, 0, "I"), (25, 2, 10, 1, "I"), (26, 6, 11, None, "D")],
        "bs_key int, session_key int, db_key int, incremental_level int, backup_type string",
    )
    pieces = spark.createDataFrame(
        [(22, "/b/x/p2", at("02:02")), (22, "/b/x/p1", at("02:01")), (25, "p3", at("02:03")), (21, "/b/p0", at("01:01")), (26, "/b/q", at("06:01"))],
        "bs_key int, handle string, completion_time timestamp_ntz",
    )
    sites = spark.createDataFrame([(10, "DB1"), (11, "DB2")], "db_key int, db_unique_name string")
    one = latest_backup_pieces(jobs, sets, pieces, sites, "DB1")
    assert [r.piece for r in one.collect()] == ["p1", "p2", "p3"]
    assert latest_backup_pieces(jobs, sets, pieces, sites).count() == 4


def test_find_instances(spark):
    df = spark.createDataFrame(
        [("current", "db-one", "one.RedShift.example", "5439", "adm"), ("current", "db-two", "two.example", "5432", "adm"), ("deleted", "db-three", "x", "1", "adm")],
        "dba_state string, instance_name string, endpoint string, port string, master_user string",
    )
    assert rows(find_instances(df, "db-", "padb_harvest", "postgres")) == [
        ("db-one", "psql -h one.RedShift.example -p 5439 -d padb_harvest -U adm"),
        ("db-two", "psql -h two.example -p 5432 -d postgres -U adm"),
    ]


def test_capacity(spark):
    mb = 1024 * 1024
    files = spark.createDataFrame(
        [("A", "YES", 100 * mb, mb), ("A", "NO", 100 * mb, 10 * mb), ("UNDO1", "NO", 0, mb)],
        "tablespace_name string, autoextensible string, maxbytes long, bytes long",
    )
    segments = spark.createDataFrame([("A", 60 * mb), ("A", 39 * mb), ("UNDO1", mb), ("Z", mb)], "tablespace_name string, bytes long")
    assert rows(data_max(files)) == [("A", 110 * mb), ("UNDO1", mb)]
    report = capacity_report(files, segments)
    assert rows(report) == [("A", 99.0, 110.0, 90.0, 11.0)]
    assert over_threshold(report).first().warning == "Tablespace A is at 90.0 Percent USED!"
    assert over_threshold(report, 91).count() == 0


def test_active_items(spark):
    df = spark.createDataFrame(
        [(at("10:00"), "select\n  1"), (at("09:00"), "x\t y"), (at("09:00"), "<IDLE>"), (at("09:00"), None), (None, "q")], "s timestamp_ntz, q string"
    )
    got = [tuple(r) for r in active_items(df, "s", "q", at("10:01")).collect()]
    assert got == [(None, "q"), (3660.0, "x y"), (60.0, "select 1")]


def test_count_audit_and_watermark(spark):
    assert rows(count_audit(ints(spark, 1, 2), ints(spark, 1))) == [(2, 1, False)]
    assert rows(watermark(ints(spark), "k")) == [(None,)]


def test_ordering_places_nulls_like_postgres(spark):
    df = ints(spark, (1, None), (None, 5), (1, 2), (1, 9), schema="a int, b int")
    assert [tuple(r) for r in ordered(df, "a", "-b").collect()] == [(1, None), (1, 9), (1, 2), (None, 5)]


def test_ordered_union_is_distinct(spark):
    s = "name string, command string"
    a = spark.createDataFrame([("t", "begin"), ("t", "begin")], s)
    b = spark.createDataFrame([("t", "copy 2"), ("t", "copy 1")], s)
    got = [tuple(r) for r in ordered_union([a, b, a], "name", "command").collect()]
    assert got == [("t", "begin", 1), ("t", "copy 1", 2), ("t", "copy 2", 2), ("t", "begin", 3)]


def test_missing_files_counts_copies(spark):
    s = "name string, m timestamp_ntz"
    local = spark.createDataFrame([("/x/a.gz", at("10:00")), ("/y/a.gz", at("10:00")), ("b.gz", at("10:00")), ("old.gz", at("01:00"))], s)
    remote = spark.createDataFrame([("a.gz.gpg",), ("bxgpg",)], "name string")
    assert rows(missing_files(local, remote, "name", "m", at("09:00"))) == [("a.gz",), ("b.gz",)]


def test_manifests(spark):
    a, b = ints(spark, 1, 1, 2), ints(spark, 1, 2, 3)
    assert rows(manifest_mismatch(a, b, "k")) == [(1, 2, 1), (3, 0, 1)]
    assert manifests_equal(a, ints(spark, 2, 1, 1), "k") and not manifests_equal(a, b, "k")
    assert rows(missing_pieces(b, a, "k")) == [(3,)]
    with pytest.raises(ValueError):
        require_all(b, a, "k")
    require_all(a, b, "k")


def test_closure_takes_the_longest_way(spark):
    edges = spark.createDataFrame(
        [("t", "a"), ("t", "b"), ("a", "b"), ("b", "c"), ("t", "t"), ("z", "q")], "parent string, child string"
    )
    got = dependency_closure(edges, spark.createDataFrame([("t",)], "node string"))
    assert rows(got) == [("a", 1), ("b", 2), ("c", 3)]
    assert [r.node for r in create_order(got).collect()] == ["a", "b", "c"]
    assert [r.node for r in drop_order(got).collect()] == ["c", "b", "a"]
    assert dependency_closure(edges, spark.createDataFrame([("c",)], "node string")).count() == 0


def test_closure_reports_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    with pytest.raises(DependencyCycle, match="cycle"):
        dependency_closure(edges, spark.createDataFrame([("a",)], "node string"))
    # A cycle that the roots do not reach does not matter.
    more = edges.unionByName(spark.createDataFrame([("a", "x"), ("r", "x"), ("x", "y"), (None, "y"), ("x", None)], edges.schema))
    got = dependency_closure(more, spark.createDataFrame([("r",), (None,)], "node string"))
    assert rows(got) == [("x", 1), ("y", 2)]


def test_closure_names_a_small_cycle_in_a_large_graph(spark, monkeypatch):
    # Two nodes that lead to each other below a tree of 100,000 edges, and a long tail behind them.
    tree = spark.range(1, 100_001).selectExpr("(id - 1) div 50 AS parent", "id AS child")
    loop = spark.createDataFrame([(70_000, 200_000), (200_000, 200_001), (200_001, 200_000), (200_001, 200_002)], "parent long, child long")
    tail = spark.range(200_002, 200_010).selectExpr("id AS parent", "id + 1 AS child")
    begun = []
    path = graph.work_path
    monkeypatch.setattr(graph, "work_path", lambda spark, label: begun.append(path(spark, label)) or begun[-1])
    with pytest.raises(DependencyCycle) as found:
        dependency_closure(tree.unionByName(loop).unionByName(tail), spark.createDataFrame([(0,)], "node long"))
    assert found.value.node in (200_000, 200_001)
    # A round for each level, not for each node.
    assert all(len([f for f in os.listdir(at.removeprefix("file:")) if "=" in f]) < 20 for at in begun) and len(begun) == 2


def test_closure_of_a_hot_parent_and_many_ways(spark):
    # Every node of a layer leads to every node of the next, and one node to all.
    layered = [((i, a), (i + 1, b)) for i in range(6) for a in range(8) for b in range(8)]
    name = lambda n: f"{n[0]}-{n[1]}"
    edges = [(name(a), name(b)) for a, b in layered] + [("0-0", name(b)) for _, b in layered]
    got = dependency_closure(ints(spark, *edges, schema="parent string, child string"), ints(spark, *[(f"0-{a}",) for a in range(8)], schema="node string"))
    assert rows(got) == sorted((f"{i}-{a}", i) for i in range(1, 7) for a in range(8))
    # A root below another root is a dependant, too.
    got = dependency_closure(ints(spark, ("a", "b"), ("b", "c"), schema="parent string, child string"), ints(spark, "a", "b", schema="node string"))
    assert rows(got) == [("b", 1), ("c", 2)]


def test_closure_has_no_depth_limit(spark):
    n = 110
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "parent int, child int")
    got = dependency_closure(edges, spark.createDataFrame([(0,)], "node int"))
    assert rows(got) == sorted((i, i) for i in range(1, n + 1)) or got.agg({"depth": "max"}).first()[0] == n


def scanned(df):
    """Rows that the scans of an executed plan gave out, largest last."""
    df.collect()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            found.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        if inner is not None:
            return walk(inner)
        children = node.children().iterator()
        while children.hasNext():
            walk(children.next())

    walk(df._jdf.queryExecution().executedPlan())
    return sorted(found)


def test_only_the_range_in_question_of_a_long_history_is_read(spark):
    path = work_path(spark, "history")
    spark.range(400_000).selectExpr("id AS k", "id * 2 AS h").repartitionByRange(8, "h").sortWithinPartitions("h").write.parquet(path)
    history = spark.read.parquet(path).where("k <> 399000 OR k IS NULL")
    df = spark.range(398_900, 399_100).selectExpr("id AS k", "IF(id = 398950, NULL, id * 2) AS h")
    plain = not_yet_loaded(df, history, ["k", "h"])
    near = not_yet_loaded(df, history, ["k", "h"], within(df, "h", "h"))
    assert rows(near) == rows(plain) == [(398_950, None), (399_000, 798_000)]
    # One file of eight at most; the whole history without the range.
    assert scanned(near)[-1] <= 50_000 and scanned(plain)[-1] == 400_000
    # No incoming rows, or none with a value: nothing is read, nothing is lost.
    assert not_yet_loaded(df.limit(0), history, ["k", "h"], within(df.limit(0), "h", "h")).count() == 0
    nulls = df.where("h IS NULL")
    assert not_yet_loaded(nulls, history, ["k", "h"], within(nulls, "h", "h")).count() == 1
