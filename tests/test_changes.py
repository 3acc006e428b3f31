from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from gridmill.operators import changes
from gridmill.operators.changes import (
    acknowledge,
    apply_deletes,
    batch_range,
    latest_changes,
    latest_deletes,
    latest_upserts,
    merge_changes,
    reconcile,
    replication_entry,
    snapshot_diff,
    upsert,
)
from gridmill.operators.inventory import mark_absent, mark_superseded, scd_upsert
from gridmill.operators.runs import run_history
from gridmill.operators.tablesync import PublishConflict, publish, read_current
from gridmill.plans import replication
from gridmill.plans.replication import (
    create_buckets,
    merge_buckets,
    merge_partitions,
    read_buckets,
    replicate,
    touched_buckets,
    upsert_buckets,
)
from gridmill.session import path_exists, work_path
from gridmill.streaming.merge import merge_stream

TRACK = "k int, s long, v string, status string"
TARGET = "k int, v string"


def track(spark, *data):
    return spark.createDataFrame(list(data), TRACK)


def test_insert_then_delete_and_delete_then_update(spark):
    t = track(spark, (1, 1, "a", "I"), (1, 2, "a", "D"), (2, 3, "b", "D"), (2, 4, "c", "U"), (3, 5, "x", None))
    latest = latest_changes(t, ["k"], "s")
    assert rows(latest_deletes(latest, ["k"])) == [(1,)]
    assert rows(latest_upserts(latest)) == [(2, 4, "c", "U")]


def test_merge_is_idempotent(spark):
    target = spark.createDataFrame([(1, "old"), (2, "old"), (9, "stay"), (3, "keep")], TARGET)
    t = track(spark, (1, 1, "new", "U"), (2, 2, None, "D"), (4, 3, "in", "I"), (3, 4, "lost", None))
    once = merge_changes(target, t, ["k"], "s")
    assert rows(once) == [(1, "new"), (3, "keep"), (4, "in"), (9, "stay")]
    assert rows(merge_changes(once, t, ["k"], "s")) == rows(once)


def test_merge_equals_deletes_then_upsert(spark):
    target = spark.createDataFrame([(i, "old") for i in range(6)], TARGET)
    t = track(spark, (1, 1, "a", "U"), (2, 2, "b", "D"), (8, 3, "c", "I"))
    latest = latest_changes(t, ["k"], "s")
    two = upsert(apply_deletes(target, latest_deletes(latest, ["k"]), ["k"]), latest_upserts(latest), ["k"])
    assert rows(two) == rows(merge_changes(target, t, ["k"], "s"))


def test_merge_matches_null_keys(spark):
    target = spark.createDataFrame([(None, "old")], TARGET)
    t = track(spark, (None, 1, "new", "U"))
    once = merge_changes(target, t, ["k"], "s")
    assert rows(once) == rows(merge_changes(once, t, ["k"], "s")) == [(None, "new")]


def test_reconcile_notices_a_repeated_key(spark):
    up = track(spark, (1, 1, "a", "U"), (1, 2, "b", "U"))
    assert reconcile(spark.createDataFrame([], TARGET), up, ["k"]).first().rows_match is False


def test_reconcile(spark):
    target = spark.createDataFrame([(1, "old")], TARGET)
    up = latest_upserts(latest_changes(track(spark, (1, 1, "a", "U"), (2, 2, "b", "I")), ["k"], "s"))
    assert reconcile(target, up, ["k"], 2).first().asDict() == {
        "batch_rows": 2, "inserts": 1, "updates": 1, "rows_match": True, "batch_range": 2,
    }


@pytest.mark.parametrize("scale", [1, 1 << 19, 1 << 41])
def test_acknowledge_numbers_densely_over_slices(spark, scale):
    seqs = [i * scale for i in range(40)]
    random.Random(1).shuffle(seqs)
    data = [(i % 7, s, 100 if s < 10 * scale else None, None) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(data, "k int, s long, ack long, t timestamp_ntz")
    got = acknowledge(df, ["k"], "s", "ack", "t", 100, at("10:00"))
    fresh = [(r.s, r.ack) for r in got.where(F.col("t").isNotNull()).orderBy("s").collect()]
    assert fresh == [(i * scale, 91 + i) for i in range(10, 40)]
    assert got.count() == 40


LOG = "target_tablename string, last_row_replicated long"


def test_batch_range(spark):
    t = track(spark, (1, 1, "a", "I"), (1, 7, "b", "U"))
    b = batch_range(t, "s", spark.createDataFrame([("x", 3), ("x", 5), ("y", 9)], LOG), "x")
    assert (b.low, b.high, b.length) == (6, 7, 2)
    assert batch_range(t, "s", spark.createDataFrame([("x", 7)], LOG), "x") is None
    assert batch_range(t, "s", spark.createDataFrame([], LOG), "x").low == 1


def test_replicate_publishes_then_logs(spark):
    root = work_path(spark, "t")
    publish(spark.createDataFrame([(1, "old"), (2, "old")], TARGET), root, at("09:00"))
    t = track(spark, (1, 1, "skip", "U"), (1, 2, "new", "U"), (2, 3, None, "D"), (3, 4, "in", "I"))
    log = spark.createDataFrame([("t", 1)], LOG)
    done = replicate(t, log, root, ["k"], "s", "src", "t", at("10:00"))
    assert rows(read_current(spark, root)) == [(1, "new"), (3, "in")]
    assert (done.inserts, done.updates, done.rows_match, done.published.version) == (1, 1, True, 2)
    entry = done.entry.first()
    assert (entry.target_tablename, entry.last_row_replicated) == ("t", 4)
    log2 = log.unionByName(done.entry.select(*log.columns))
    assert replicate(t, log2, root, ["k"], "s", "src", "t", at("11:00")) is None


def test_replication_entry(spark):
    r = replication_entry(track(spark), "a", "b", 7, at("10:00"), 12).first()
    assert r.last_row_replicated == 7 and r.batch_elapsed_seconds == 12


def test_merge_stream_survives_a_rerun(spark):
    root, src, ckpt = (work_path(spark, n) for n in ("tab", "src", "ckpt"))
    publish(spark.createDataFrame([(1, "old"), (2, "old")], TARGET), root, at("09:00"))

    def run(checkpoint):
        stream = spark.readStream.schema(TRACK).parquet(src)
        merge_stream(stream, root, ["k"], "s", checkpoint).awaitTermination(120)

    track(spark, (1, 1, "new", "U"), (2, 2, None, "D")).write.parquet(src)
    run(ckpt)
    assert rows(read_current(spark, root)) == [(1, "new")]
    track(spark, (3, 3, "in", "I"), (1, 4, "newer", "U")).write.mode("append").parquet(src)
    run(ckpt)
    want = [(1, "newer"), (3, "in")]
    assert rows(read_current(spark, root)) == want
    run(work_path(spark, "ckpt"))
    assert rows(read_current(spark, root)) == want


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", 1)], "k int, v string, n int")
    assert rows(snapshot_diff(old, new, ["k"], "me")) == [
        (2, "b", None, "U", "me"), (3, "c", 1, "D", "me"), (4, "d", 1, "I", "me"),
    ]


INST = "account_name string, account_number string, instance_name string, create_date string, ppm double"


def test_scd_upsert(spark):
    cur = spark.createDataFrame(
        [("deleted", "A", "1", "i1", "2020", 1.0), ("current", "A", "1", "i2", "2020", None), ("current", "B", "2", "i3", "2020", 3.0)],
        "dba_state string, " + INST,
    )
    snap = spark.createDataFrame(
        [("A", "1", "i1", "2020", 1.5), ("A", "1", "i2", "2020", None), ("A", "1", "i9", "2021", 9.0), ("B", "2", "i8", "2021", 8.0)], INST
    )
    accounts = spark.createDataFrame([("A", "1", "prod safety"), ("B", "2", "prod")], "account_name string, account_number string, label string")
    got = rows(scd_upsert(cur, snap, accounts))
    assert got == [
        ("current", "A", "1", "i2", "2020", None, None),
        ("current", "A", "1", "i9", "2021", 9.0, "insert"),
        ("current", "B", "2", "i3", "2020", 3.0, None),
        ("deleted", "A", "1", "i1", "2020", 1.5, "update"),
    ]


def test_mark_superseded_and_absent(spark):
    schema = "k string, created string, dba_state string"
    cur = spark.createDataFrame(
        [("a", "1", "current"), ("a", "2", "current"), ("b", "1", "current"), ("c", "1", "deleted"), ("b", "0", "kept")], schema
    )
    new = spark.createDataFrame([("a", "2")], "k string, created string")
    assert rows(mark_superseded(cur, new, ["k"], "created"))[:2] == [("a", "1", "deleted"), ("a", "2", "current")]
    got = rows(mark_absent(cur, new, ["k"]))
    assert got == [
        ("a", "1", "current"), ("a", "2", "current"), ("b", "0", "deleted"), ("b", "1", "deleted"), ("c", "1", "deleted"),
    ]


def test_run_history(spark):
    ev = spark.createDataFrame(
        [("s", "START", at("10:00"), None), ("s", "END", at("10:05"), 1), ("s", "END", at("10:06"), 0),
         ("s", "START", at("11:00"), None), ("r", "END", at("09:00"), 5)],
        "n string, state string, t timestamp_ntz, rc int",
    )
    assert rows(run_history(ev, ["n"], "state", "t", end_cols=["rc"])) == [
        ("s", at("10:00"), at("10:06"), "END", 360.0, 0),
        ("s", at("11:00"), None, "START", None, None),
    ]


DAY_TRACK = "k int, d string, s long, v string, status string"


def test_merge_partitions_rewrites_touched_days_only(spark):
    path = work_path(spark, "days")
    spark.createDataFrame(
        [(1, "2024-01-01", "a"), (2, "2024-01-01", "b"), (1, "2024-01-02", "c"), (1, "2024-01-03", "d")],
        "k int, d string, v string",
    ).write.partitionBy("d").parquet(path)
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        untouched = spark.read.parquet(path).where("d = '2024-01-02'").select("_metadata.file_path").first()[0]
        t = spark.createDataFrame(
            [(1, "2024-01-01", 1, "new", "U"), (2, "2024-01-01", 2, None, "D"), (1, "2024-01-03", 3, None, "D"),
             (5, "2024-01-04", 4, "in", "I"), (9, "2024-01-05", 5, None, "D")],
            DAY_TRACK,
        )
        want = [("2024-01-01", 1, "new"), ("2024-01-02", 1, "c"), ("2024-01-04", 5, "in")]
        for _ in range(2):
            merge_partitions(t, path, ["k", "d"], "s", "d")
            assert rows(spark.read.parquet(path).select("d", "k", "v")) == want
        again = spark.read.parquet(path).where("d = '2024-01-02'").select("_metadata.file_path").first()[0]
        assert again == untouched
        with pytest.raises(ValueError):
            merge_partitions(t, path, ["k"], "s", "d")

        src, ckpt = work_path(spark, "src"), work_path(spark, "ckpt")
        spark.createDataFrame([(5, "2024-01-04", 6, "late", "U")], DAY_TRACK).write.parquet(src)
        stream = spark.readStream.schema(DAY_TRACK).parquet(src)
        merge_stream(stream, path, ["k", "d"], "s", ckpt, partition="d").awaitTermination(120)
        assert rows(spark.read.parquet(path).where("d = '2024-01-04'").select("k", "v")) == [(5, "late")]
    finally:
        spark.conf.unset("spark.sql.sources.partitionColumnTypeInference.enabled")


def test_acknowledge_keeps_rows_without_sequence(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, 5, None, None), (3, None, 9, None)], "k int, s long, ack long, t timestamp_ntz")
    got = acknowledge(df, ["k"], "s", "ack", "t", 0, at("10:00")).collect()
    assert sorted((r.k, r.ack) for r in got) == [(1, 2), (2, 1), (3, 9)]


def test_merge_partitions_empties_odd_names_and_finishes_a_failed_try(spark, monkeypatch):
    path = work_path(spark, "odd")
    days = ["2024-01-01 10:00", None, "a=b/c%", "kept"]
    spark.createDataFrame([(i, d, "x") for i, d in enumerate(days)], "k int, d string, v string").write.partitionBy("d").parquet(path)
    t = spark.createDataFrame([(i, d, i, None, "D") for i, d in enumerate(days[:3])], DAY_TRACK)
    monkeypatch.setattr(replication, "remove_path", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        merge_partitions(t, path, ["k", "d"], "s", "d")
    monkeypatch.undo()
    # The next merge first finishes the one before.
    merge_partitions(spark.createDataFrame([(7, "new", 9, "y", "I")], DAY_TRACK), path, ["k", "d"], "s", "d")
    assert rows(spark.read.parquet(path).select("d", "k", "v")) == [("kept", 3, "x"), ("new", 7, "y")]
    assert not path_exists(spark, f"{path}.pending")


def test_late_changes_do_not_win(spark):
    root, src, ckpt = (work_path(spark, n) for n in ("tab", "src", "ckpt"))
    publish(spark.createDataFrame([(1, "old"), (2, "old")], TARGET), root, at("09:00"))
    for batch in ([(1, 9, "new", "U"), (2, 8, None, "D")], [(1, 5, "late", "U"), (2, 7, "back", "I"), (3, 1, "in", "I")]):
        track(spark, *batch).write.mode("append").parquet(src)
        merge_stream(spark.readStream.schema(TRACK).parquet(src), root, ["k"], "s", ckpt).awaitTermination(120)
    assert rows(read_current(spark, root)) == [(1, "new"), (3, "in")]


def test_replication_log_is_read_and_appended_to(spark):
    root, log = work_path(spark, "t"), work_path(spark, "log")
    publish(spark.createDataFrame([(1, "old")], TARGET), root, at("09:00"))
    t = track(spark, (1, 1, "a", "U"))
    run = lambda frame: replication.replicate_logged(frame, log, root, ["k"], "s", "src", "t", at("10:00"))
    assert run(t) is not None and run(t) is None
    assert run(t.unionByName(track(spark, (2, 4, "b", "I")))).bounds.low == 2
    assert [r.last_row_replicated for r in replication.read_log(spark, log).orderBy("last_row_replicated").collect()] == [1, 4]


@pytest.mark.parametrize("per_slice", [3, 1_000_000])
def test_rows_without_sequence_are_numbered_in_slices(spark, per_slice, monkeypatch):
    # A third of the rows share one sequence, a third have none.
    data = [(i, None if i % 3 == 0 else (5 if i % 3 == 1 else 1000 - i), None, None) for i in range(120)] + [(500, 2, 9, None)]
    df = spark.createDataFrame(data, "k int, s long, ack long, t timestamp_ntz").repartition(4)
    cut = []
    real = changes.cut_slices
    monkeypatch.setattr(changes, "cut_slices", lambda *a: cut.append(real(*a)) or cut[-1])
    got = acknowledge(df, ["k"], "s", "ack", "t", 100, at("10:00"), per_slice).collect()
    want = {k: 101 + i for i, (k, *_) in enumerate(sorted(data[:-1], key=lambda r: (r[1] is None, r[1] or 0, r[0])))}
    assert {r.k: r.ack for r in got} == {**want, 500: 9}
    assert cut[0].count == (40 if per_slice == 3 else 1)


def test_a_million_rows_without_sequence_are_numbered_in_many_tasks(spark):
    df = spark.range(1_000_000).select("id", F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("ack"), F.lit(None).cast("timestamp_ntz").alias("t"))
    got = acknowledge(df, ["id"], "s", "ack", "t", 0, at("10:00"), per_slice=50_000)
    assert got.where("ack = id + 1").count() == 1_000_000


def bucket_files(spark, path):
    table = spark.read.parquet(path)
    return {r.f for r in table.select(F.input_file_name().alias("f")).distinct().collect()}


def test_merge_buckets_rewrites_the_buckets_of_changed_keys_only(spark):
    path = work_path(spark, "buckets")
    create_buckets(spark.range(2000).selectExpr("CAST(id AS INT) AS k", "'old' AS v"), path, ["k"], 64)
    before = bucket_files(spark, path)
    t = track(spark, *[(i, 10 + i, "new", "U") for i in range(8)], (1999, 50, None, "D"), (5000, 51, "in", "I"), (7, 3, "early", "U"))
    want = sorted([(i, "new") for i in range(8)] + [(i, "old") for i in range(8, 1999)] + [(5000, "in")])
    for _ in range(2):
        merge_buckets(t, path, ["k"], "s", 64)
        got = read_buckets(spark, path)
        assert got.columns == ["k", "v"] and sorted(map(tuple, got.collect())) == want
    # Ten keys: ten of the 64 buckets at most are written anew.
    kept = before & bucket_files(spark, path)
    assert len({f.split("/")[-2] for f in before}) == 64 and len({f.split("/")[-2] for f in kept}) >= 54
    with pytest.raises(ValueError):
        merge_buckets(t, path, ["k"], "s", 32)


def test_buckets_with_null_keys_no_rows_and_another_status(spark):
    path = work_path(spark, "buckets")
    empty = spark.createDataFrame([], TARGET)
    create_buckets(empty, path, ["k"], 4)
    assert read_buckets(spark, path).columns == ["k", "v"] and read_buckets(spark, path).count() == 0
    t = track(spark, (None, 1, "n", "I"), (1, 2, "a", "I"), (2, 3, "b", "I")).withColumnRenamed("status", "op")
    merge_buckets(t, path, ["k"], "s", 4, status="op")
    assert rows(read_buckets(spark, path)) == [(1, "a"), (2, "b"), (None, "n")]
    gone = track(spark, (None, 4, None, "D"), (1, 5, None, "D"), (2, 6, None, "D"))
    merge_buckets(gone, path, ["k"], "s", 4)
    assert read_buckets(spark, path).count() == 0
    merge_buckets(track(spark, (3, 7, "c", "I")), path, ["k"], "s", 4)
    assert rows(read_buckets(spark, path)) == [(3, "c")]


def test_failed_bucket_merge_is_finished_by_the_next(spark, monkeypatch):
    path = work_path(spark, "buckets")
    create_buckets(spark.createDataFrame([(i, "old") for i in range(40)], TARGET), path, ["k"], 8)
    real = replication.overwrite_partitions
    monkeypatch.setattr(replication, "overwrite_partitions", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        merge_buckets(track(spark, (1, 1, "new", "U")), path, ["k"], "s", 8)
    monkeypatch.setattr(replication, "overwrite_partitions", real)
    merge_buckets(track(spark, (2, 2, "new", "U")), path, ["k"], "s", 8)
    assert [r.k for r in read_buckets(spark, path).where("v = 'new'").orderBy("k").collect()] == [1, 2]


def test_status_column_of_another_name(spark):
    path = work_path(spark, "days")
    spark.createDataFrame([(1, "x", "a"), (2, "x", "b")], "k int, d string, v string").write.partitionBy("d").parquet(path)
    t = spark.createDataFrame([(1, "x", 1, "new", "U"), (2, "x", 2, None, "D")], "k int, d string, s long, v string, op string")
    merge_partitions(t, path, ["k", "d"], "s", "d", status="op")
    assert rows(spark.read.parquet(path).select("k", "v")) == [(1, "new")]
    src = work_path(spark, "src")
    spark.createDataFrame([(1, "x", 3, None, "D"), (3, "y", 4, "c", "I")], t.schema).write.parquet(src)
    stream = spark.readStream.schema(t.schema).parquet(src)
    merge_stream(stream, path, ["k", "d"], "s", work_path(spark, "ckpt"), status="op", partition="d").awaitTermination(120)
    assert rows(spark.read.parquet(path).select("d", "k", "v")) == [("y", 3, "c")]
    root = work_path(spark, "root")
    publish(spark.createDataFrame([(1, "old")], TARGET), root, at("09:00"))
    log = spark.createDataFrame([], changes.LOG_SCHEMA)
    batch = replicate(track(spark, (1, 1, None, "D"), (2, 2, "b", "I")).withColumnRenamed("status", "op"), log, root, ["k"], "s", "a", "b", at("10:00"), status="op")
    assert (batch.inserts, batch.updates) == (1, 0) and rows(read_current(spark, root)) == [(2, "b")]


def test_stream_state_is_rewritten_in_proportion_to_the_batch(spark):
    path, src, ckpt = (work_path(spark, n) for n in ("tab", "src", "ckpt"))
    create_buckets(spark.createDataFrame([], TARGET), path, ["k"], 32)

    def arrive(*data):
        track(spark, *data).write.mode("append").parquet(src)
        merge_stream(spark.readStream.schema(TRACK).parquet(src), path, ["k"], "s", ckpt, buckets=32).awaitTermination(120)

    arrive(*[(i, 100 + i, "first", "I") for i in range(600)])
    state, table = bucket_files(spark, f"{path}.applied"), bucket_files(spark, path)
    # Late, deleted, repeated and new.
    arrive((1, 5, "late", "U"), (2, 900, None, "D"), (3, 901, "next", "U"), (3, 901, "next", "U"))
    arrive((2, 899, "back", "I"))
    got = {r.k: r.v for r in read_buckets(spark, path).where("k < 5").collect()}
    assert got == {0: "first", 1: "first", 3: "next", 4: "first"}
    assert len(state - bucket_files(spark, f"{path}.applied")) <= 2 and len(table - bucket_files(spark, path)) <= 2
    assert {r.k: r.s for r in read_buckets(spark, f"{path}.applied").where("k < 4").collect()} == {0: 100, 1: 101, 2: 900, 3: 901}


def test_touched_buckets_and_upsert(spark):
    path = work_path(spark, "state")
    upsert_buckets(track(spark, *[(i, i, "a", "U") for i in range(100)]).select("k", "s"), path, ["k"], 16)
    asked = track(spark, (7, 0, "", "U"))
    near = touched_buckets(asked, path, ["k"], 16)
    assert 1 <= near.count() < 40 and near.where("k = 7").count() == 1
    upsert_buckets(track(spark, (7, 70, "", "U"), (200, 1, "", "U")).select("k", "s"), path, ["k"], 16)
    got = read_buckets(spark, path)
    assert got.count() == 101 and got.where("k = 7").first().s == 70


def test_a_merge_on_an_outdated_version_is_refused(spark, monkeypatch):
    root = work_path(spark, "r")
    publish(spark.createDataFrame([(1, "old")], TARGET), root, at("09:00"))
    log = spark.createDataFrame([], changes.LOG_SCHEMA)
    real = replication.merge_latest

    def meanwhile(*a):
        publish(spark.createDataFrame([(9, "other")], TARGET), root, at("09:30"))
        return real(*a)

    monkeypatch.setattr(replication, "merge_latest", meanwhile)
    with pytest.raises(PublishConflict):
        replicate(track(spark, (1, 1, "new", "U")), log, root, ["k"], "s", "a", "b", at("10:00"))
    assert rows(read_current(spark, root)) == [(9, "other")]
    monkeypatch.undo()
    replicate(track(spark, (1, 1, "new", "U")), log, root, ["k"], "s", "a", "b", at("10:00"))
    assert rows(read_current(spark, root)) == [(1, "new"), (9, "other")]


def test_digest_tells_apart_what_runs_together(spark):
    from gridmill.functions.rows import row_digest

    pairs = [("a\u0001vb", "c"), ("a", "b\u0001vc"), ("a1:", "c"), ("a", "1:c"), (None, ""), ("", None), ("n", ""), ("", "n")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.select(row_digest(["a", "b"])).distinct().count() == len(pairs)
