from __future__ import annotations

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import at, rows
from gridmill.catalog.source_queries import order_documents
from gridmill.functions.rows import rows_hash
from gridmill.functions.masking import mask_email, mask_secret, md5_pair
from gridmill.session import work_path
from gridmill.sources.archive import archive_partition
from gridmill.sources.delimited import (
    TooManyBadRows,
    export_delimited,
    load_delimited,
    to_lines,
    write_lines,
)
from gridmill.sources.documents import malformed_allocations, read_documents, split_documents, write_documents
from gridmill.sources.inventory_json import flatten_inventory
from gridmill.sources.messages import parse_acceptance_messages, unfit_messages
from gridmill.sources.tables import scan


def text(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_scan_prunes_and_pushes(spark, sf):
    df = scan(spark, f"{sf}/orders.parquet", ["o_orderkey"], F.col("o_custkey") == 7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan
    assert "o_totalprice" not in plan


MESSAGE = (
    "2024:01:10:09:30:05:GMT: subject=BMRA.BM.T_UNIT-1.BOALF, message={NK=77,SO=F,"
    "TA=2024:01:10:09:29:00:GMT,AD=F,NP=3,TS=2024:01:10:09:30:00:GMT,VA=10.5,"
    "TS=2024:01:10:09:45:00:GMT,VA=-2.0,TS=2024:01:10:10:00:00:GMT,VA=0.0}"
)


def test_message_gives_np_rows(spark):
    got = parse_acceptance_messages(text(spark, MESSAGE, "x.BM.U.FPN, message={NP=1}")).orderBy("time_gmt").collect()
    assert [(r.time_gmt, r.va_level) for r in got] == [
        (at("09:30"), Decimal("10.5")), (at("09:45"), Decimal("-2")), (at("10:00"), Decimal("0")),
    ]
    r = got[0]
    assert (r.bm_unit_id, r.acceptance_id, r.so, r.acceptance_time, r.ad, r.np) == ("T_UNIT-1", "77", "F", at("09:29"), "F", 3)


def test_broken_message_is_not_fatal(spark):
    bad = MESSAGE.replace("NP=3", "NP=x")
    short = MESSAGE.split(",TS=2024:01:10:09:45")[0] + "}"
    got = rows(parse_acceptance_messages(text(spark, bad, short)).select("time_gmt", "va_level"))
    assert got == [(at("09:30"), Decimal("10.5"))]


def test_inventory(spark):
    doc = (
        '[{"account":{"name":"A, B","owner_id":"12"},"instance_id":"i1","create_date":"2019-01-01 00:00:00 UTC",'
        '"region":{"name":"east"},"engine":"postgres","version":"9.6","auto_update":true,"is_multi_zone":false,'
        '"endpoint":"h.example:5432","username":"adm","flavor":"m4","price_per_month":"$1,234.50","hourly_cost":"","is_active":true}]'
    )
    r = flatten_inventory(text(spark, doc)).first()
    assert len(r) == 16
    assert (r.account_name, r.endpoint, r.port, r.ppm, r.pph) == ("A, B", "h.example", "5432", Decimal("1234.5"), Decimal("0"))


SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("t", T.TimestampNTZType())])


def test_load_tolerates_bad_rows_up_to_the_limit(spark):
    path = work_path(spark, "load")
    text(spark, "1,a,2024-01-10 10:00:00", "x,b,2024-01-10 10:00:00", "2,,", "3,c", "").write.text(path)
    load = load_delimited(spark, path, SCHEMA, max_errors=2, null="")
    assert (load.n_read, load.n_bad) == (4, 2)
    assert rows(load.rows) == [(1, "a", at("10:00")), (2, None, None)]
    assert rows(load.bad) == [("3,c",), ("x,b,2024-01-10 10:00:00",)]
    with pytest.raises(TooManyBadRows):
        load_delimited(spark, path, SCHEMA, max_errors=1, null="")


ODD = ["  a b  ", "a|b", "", None, "\\", "\\n", "a\nb\r\tc", "\\N", "\u0001", "\u0001b|\\|", 'q"x,\\', "|", "\\|"]


@pytest.mark.parametrize("sep", ["|", ",", "\x02"])
def test_export_round_trip(spark, sep):
    path = work_path(spark, "export")
    df = spark.createDataFrame([(i, v, at("10:00") if i % 2 else None) for i, v in enumerate(ODD)], SCHEMA)
    export_delimited(df, path, sep=sep)
    assert len(spark.read.text(path).collect()) == len(ODD)
    load = load_delimited(spark, path, SCHEMA, max_errors=0, sep=sep)
    assert rows(load.rows) == rows(df) and (load.n_read, load.n_bad) == (len(ODD), 0)


def test_lines_are_written_in_order(spark):
    df = spark.createDataFrame([(i * 7 % 50, "v", None) for i in range(50)], SCHEMA).repartition(4)
    path = work_path(spark, "lines")
    write_lines(to_lines(df, ["k", "v"], order=["k"]), path)
    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    text = [r.value for f in files for r in spark.read.text(f).collect()]
    assert text == [f"{i},v" for i in range(50)]


def test_lines_propagate_null_and_order(spark):
    df = spark.createDataFrame([(2, "b", at("10:00")), (1, "a", at("10:01")), (3, None, at("10:00"))], SCHEMA)
    got = [r.line for r in to_lines(df, ["k", "v", "t"], order=["t", "-k"]).collect()]
    assert got == [None, "2,b,2024-01-10 10:00", "1,a,2024-01-10 10:01"]


def test_archive_audit(spark):
    df = spark.createDataFrame([(1, "a|b", at("10:00")), (2, None, None), (2, 'q"x\\', None)], SCHEMA)
    r = archive_partition(df, work_path(spark, "arc")).first()
    assert (r.n_rows, r.n_archived, r.content_equal, r.safe_to_drop) == (3, 3, True, True)


def test_archive_keeps_odd_text_and_null_apart(spark):
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(ODD)], SCHEMA)
    assert archive_partition(df, work_path(spark, "arc")).first().safe_to_drop is True
    hashes = {df.where(F.col("k") == k).select(F.col("v")).agg(rows_hash(["v"])).first()[0] for k in (2, 3)}
    assert len(hashes) == 2


def test_point_count_is_bounded_by_the_fields(spark):
    huge = MESSAGE.replace("NP=3", "NP=3000000")
    lines = text(spark, MESSAGE, huge)
    assert parse_acceptance_messages(lines).count() == 6
    assert [r.line for r in unfit_messages(lines).collect()] == [huge]


def test_masks(spark):
    df = spark.createDataFrame([("a@b", "u"), ("keep@x", "v"), (None, "w")], "e string, u string")
    got = [r[0] for r in df.select(mask_email("e", ["keep@x"])).collect()]
    assert got == ["a_at_b@company.com", "keep@x", None]
    secret = df.select(mask_secret("u", F.lit("pw"), "salt", ["v"])).collect()
    assert secret[1][0] == "pw" and len(secret[0][0]) == 64 and secret[0][0] != secret[2][0]
    assert df.select(md5_pair(F.lit("pw"), F.lit("me"))).first()[0].startswith("md5")
    # User and secret do not run together.
    near = spark.createDataFrame([("ab", "c"), ("a", "bc")], "u string, s string").select(mask_secret("u", "s", "salt")).collect()
    assert near[0][0] != near[1][0]


def alloc(ship, qty):
    return "Z2EDP01SDQ".ljust(211) + qty.ljust(10) + ship


def item(no, fill="0"):
    return f"E2EDP01{no:03d}".ljust(74) + fill.ljust(15) + "END"


def documents(spark, *docs):
    path = work_path(spark, "idoc")
    spark.sparkContext.parallelize(["\n".join(docs)], 1).saveAsTextFile(path)
    return read_documents(spark, path)


PLAIN = "EDI_DC40 1\nE2EDKA1001AG\n" + item(1) + "\nE2EDS01 s"
PARTY = "E2EDKA1001WE".ljust(70, "x")
SPLIT = "\n".join(
    ["EDI_DC40 2", PARTY, item(1), "E2EDP02 a", alloc("10", "5.000"), alloc("9", "7"), alloc("9", "8"),
     item(2), alloc("10", "6.000".rjust(10)), "E2EDS01 s", "E2EDS02 t"]
)


def test_documents_without_allocations_pass(spark):
    got = split_documents(documents(spark, PLAIN, PLAIN.replace("40 1", "40 3"))).orderBy("text").collect()
    assert [r.text for r in got] == [PLAIN, PLAIN.replace("40 1", "40 3")]
    assert got[0].ship_to is None


def test_documents_split_by_ship_to(spark):
    got = split_documents(documents(spark, PLAIN, SPLIT, PLAIN)).where("ship_to is not null").orderBy("ship_to_no").collect()
    assert [r.ship_to for r in got] == ["9", "10"]
    head = "E2EDKA1001WE".ljust(65, "x").ljust(83)
    assert got[0].text.split("\n") == [
        "EDI_DC40 2", head + "9", item(1, "8"), "E2EDP02 a", "E2EDS01 s", "E2EDS02 t",
    ]
    assert got[1].text.split("\n") == [
        "EDI_DC40 2", head + "10", item(1, "5.000"), "E2EDP02 a", item(2, "6.000"), "E2EDS01 s", "E2EDS02 t",
    ]


def test_every_document_of_a_file_is_read_once(spark):
    docs = [SPLIT if i % 3 else PLAIN for i in range(50)]
    assert documents(spark, *docs).count() == 50
    assert split_documents(documents(spark, *docs)).count() == sum(2 if i % 3 else 1 for i in range(50))


def test_malformed_allocations_are_counted(spark):
    short = SPLIT.replace(alloc("9", "7"), "Z2EDP01SDQ short")
    assert malformed_allocations(documents(spark, short)).count() == 1
    assert {r.ship_to for r in split_documents(documents(spark, short)).collect()} == {"", "9", "10"}


def test_large_document_is_split_in_one_pass(spark):
    items = [item(i) + "\n" + "\n".join(alloc(str(s), str(i)) for s in range(i % 5, 500, 50)) for i in range(1000)]
    got = split_documents(documents(spark, "\n".join(["EDI_DC40 9", *items, "E2EDS01 s"]))).select("ship_to", "ship_to_no", F.size(F.split("text", "\n")).alias("n")).collect()
    want = {str(s): sum(s in range(i % 5, 500, 50) for i in range(1000)) for s in range(500) if s % 50 < 5}
    assert {r.ship_to: r.n - 2 for r in got} == want


def test_written_documents_take_less_than_their_table(spark, sf, tmp_path):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    path = str(tmp_path / "docs")
    write_documents(order_documents(lines), path)
    held = sum(f.stat().st_size for f in (tmp_path / "docs").iterdir())
    table = spark.read.parquet(f"{sf}/lineitem.parquet").inputFiles()
    assert held < 8 * sum(os.path.getsize(f.removeprefix("file://")) for f in table)
    back = read_documents(spark, path)
    assert rows(back.select("text")) == rows(order_documents(lines).select("text"))


def test_documents_are_written_in_short_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gridmill.sources.documents.FILE_DOCUMENTS", 7)
    docs = spark.createDataFrame([(f"EDI_DC40 {i}\nx",) for i in range(30)], "text string").coalesce(1)
    write_documents(docs, str(tmp_path / "docs"))
    assert len(list((tmp_path / "docs").glob("part-*"))) == 5
    assert read_documents(spark, str(tmp_path / "docs")).count() == 30
