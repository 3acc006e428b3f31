from __future__ import annotations

import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from gridmill.llm import queries, warc

SCHEMA = "page_id long, url string, html string, key string, copies int"


def plain(rows, least=1000):
    heads = {}
    for i, _, html, *_ in rows:
        text = (html or "").encode()
        if len(text) >= least and i is not None:
            heads[text] = max(heads.get(text, i), i)
    out = []
    for i, _, html, *_ in rows:
        text = (html or "").encode()
        head = heads.get(text)
        again = head is not None and i != head
        out.append((i, len(text), hashlib.sha1(text).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)


ODD = [
    (1, None, None), (2, "", ""), (3, "no scheme", "x" * 999), (4, "http://a.b/c?d#e", "x" * 1000), (5, "http://a.b/c?d#e", "x" * 1000),
    (6, "http://é.com/\r\nWARC-Type: warcinfo", "ü" * 500), (7, "http://a?q", "ü" * 500), (7, "http://a?q", "ü" * 500), (7, "http://b", "ü" * 500),
    (8, "http://c", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 30), (None, "http://d", "x" * 1000),
    (None, None, None), (9, "http://e", "\u0000\ufeff\U0001f600" * 300), (10, "x://", "long " * 2_000_000), (11, "x://", "long " * 2_000_000), (3, "no scheme", "x" * 999),
]


def test_round_trip_of_odd_pages(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.write_warc(pages(spark, ODD), path)
    got = warc.assemble(warc.read_warc(spark, path)).collect()
    assert sum(r.copies for r in got) == len(ODD) and max(r.copies for r in got) == 2
    assert all(len(r.requests) == len(r.metadata) == 1 for r in got)
    texts = {(html or "").encode() for _, _, html in ODD}
    assert {bytes(r.payload) for r in got if r.type == "response"} == texts
    assert all(r.payload is None and r.refers.payload_digest == r.payload_digest for r in got if r.type == "revisit")
    assert all(r.payload_digest == hashlib.sha1(r.payload).hexdigest() for r in got if r.type == "response")
    import json

    stored = [json.loads(r.metadata[0].content) for r in got]
    assert sorted({(x["id"], x["url"]) for x in stored}, key=str) == sorted({r[:2] for r in ODD}, key=str)
    by_url = {x["url"]: r for x, r in zip(stored, got)}
    assert by_url["http://a.b/c?d#e"].requests[0].http == "GET /c?d HTTP/1.1\r\nHost: a.b\r\n\r\n"
    assert by_url["http://a?q"].requests[0].http.startswith("GET /?q HTTP/1.1\r\nHost: a\r\n")
    assert by_url["http://é.com/\r\nWARC-Type: warcinfo"].target_uri == "http://%C3%A9.com/%0D%0AWARC-Type:%20warcinfo"


def test_digest_rows_match_a_plain_pass(spark, tmp_path):
    pages(spark, ODD).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op11_warc(spark, str(tmp_path))
    want = plain([(*r, None, None) for r in ODD])
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == want


def test_files_are_gzip_members_that_other_readers_take(spark, tmp_path):
    path = f"{tmp_path}/warc"
    warc.write_warc(pages(spark, ODD), path)
    records = []
    for f in glob.glob(f"{path}/part-*"):
        data = open(f, "rb").read()
        texts = [h for h, _ in warc.records_of(gzip.decompress(data))]
        assert not data or dict(texts[0])["warc-type"] == "warcinfo"
        records += [h for h in texts if dict(h)["warc-type"] != "warcinfo"]
    assert len(records) == 3 * len(ODD)
    foreign = warc.read_warc_files(spark, path)
    assert sorted(map(str, foreign.collect())) == sorted(map(str, warc.read_warc(spark, path).collect()))


def test_many_splits_read_the_same(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = [(i, f"http://h{i % 7}/", "".join(rng.choice("abcdefgh <>é") for _ in range(rng.randint(0, 4000)))) for i in range(400)]
    path = f"{tmp_path}/warc"
    warc.write_warc(pages(spark, rows).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        records = warc.read_warc(spark, path)
        assert records.rdd.getNumPartitions() > 20
        got = {r.page: r.payload for r in warc.assemble(records).select(F.get_json_object(F.col("metadata")[0]["content"], "$.id").cast("long").alias("page"), "payload").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: html.encode() for i, _, html in rows}


def test_foreign_records(spark, tmp_path):
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"hi").digest()).decode()

    def record(kind, rid, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "X-Long: a", "  b", *more, f"Content-Length: {len(block)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    body = b"".join([
        record("warcinfo", "<i>", b"software: x"),
        record("response", "<r1>", b"HTTP/1.1 200 OK\r\n\r\nhi", http, "WARC-Concurrent-To: <q1>", f"WARC-Payload-Digest: {digest}"),
        record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("metadata", "<m1>", b"a: 1", "WARC-Concurrent-To: <r1>"), record("metadata", "<m2>", b"a: 2", "WARC-Concurrent-To: <r1>", "WARC-Concurrent-To: <z>"),
        record("resource", "<r2>", b"raw", "WARC-Target-URI: x:y"), record("metadata", "<m3>", b"orphan"),
        record("revisit", "<r3>", b"HTTP/1.1 200 OK\r\n\r\n", http, "WARC-Refers-To: <r1>"), record("revisit", "<r4>", b"", "WARC-Refers-To: <gone>"),
    ])
    (tmp_path / "a.warc").write_bytes(body)
    (tmp_path / "b.warc").write_bytes(gzip.compress(record("response", "<r5>", b"HTTP/1.1 200 OK\r\n\r\n", http)))
    got = {r.record_id: r for r in warc.assemble(warc.read_warc_files(spark, f"{tmp_path}/*.warc")).collect()}
    assert set(got) == {"<r1>", "<r2>", "<r3>", "<r4>", "<r5>"}
    r1 = got["<r1>"]
    assert [m.content for m in r1.metadata] == ["a: 1", "a: 2"] and [q.record_id for q in r1.requests] == ["<q1>"] and r1.payload == b"hi"
    assert r1.payload_digest == hashlib.sha1(b"hi").hexdigest() and got["<r2>"].payload == b"raw" and got["<r5>"].payload == b""
    assert got["<r3>"].refers.record_id == "<r1>" and got["<r4>"].refers is None and got["<r3>"].payload is None
    with pytest.raises(ValueError):
        list(warc.records_of(b"HTTP/1.1 200 OK\r\n\r\n"))


def test_empty_table(spark, tmp_path):
    warc.write_warc(pages(spark, ODD).limit(0), f"{tmp_path}/none")
    assert warc.assemble(warc.read_warc(spark, f"{tmp_path}/none")).count() == 0
