"""WARC archives: written as captures, read as records, assembled by their identifiers.

A capture is a request, a response (or a revisit, if its payload is stored elsewhere) and
a metadata record; the others name the response's identifier as concurrent. Every record
is a gzip member of its own, as the format asks for. After each capture stands an empty
member, which readers skip and at which Spark splits the files: Spark's own text writer
and reader handle them with that member as the line separator, so files are committed
and read like any table's, in splits, with no file held whole.
"""

from __future__ import annotations

import base64
import gzip
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.session import cut_lineage

VERSION = b"WARC/1.1"
# Fixed value: the profile of a revisit whose payload is the same.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 1_000
DATE = "2024-01-01T00:00:00Z"
# Fixed value: an empty gzip member, header, empty block, checksum and length of nothing.
_EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03" + b"\x03\x00" + bytes(8)
_SPLIT = {"lineSep": _EMPTY.decode("latin-1"), "encoding": "ISO-8859-1"}
_BATCH = 4 << 20
RECORD = (
    "record_id string, type string, date string, target_uri string, concurrent_to array<string>,"
    " refers_to string, payload_digest string, content_type string, http string, content string, payload binary"
)


def captures_of(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(id, url, payload, digest, key, refers_to, refers_key): what to write of every row.

    refers_to is the largest id of the rows with the same payload, for the others of them,
    if the payload has least_bytes or more; rows with a null id are the smallest. key is a
    hash of id, url and payload and makes the record's identifier: equal rows are one
    capture, written again.
    """
    named = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    key = lambda i, url, sum_: F.md5(F.to_json(F.struct(i.alias("a"), url.alias("b"), sum_.alias("c"))))
    rows = named.withColumns({"digest": F.sha1("payload"), "sum": F.sha2("payload", 256)})
    rows = rows.withColumn("key", key(F.col("id"), F.col("url"), F.col("sum")))
    # Only keys meet here, and only those of payloads that stand twice.
    thin = rows.where(F.octet_length("payload") >= least_bytes).select("sum", "id", "key")
    heads = (
        thin.groupBy("sum")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "key")).alias("head"))
        .where((F.col("n") > 1) & F.col("head.id").isNotNull())
        .select(F.col("sum").alias("same"), "head")
    )
    later = F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head.id"))
    return rows.join(heads, F.col("sum") == F.col("same"), "left").select(
        "id", "url", "payload", "digest", "key", F.when(later, F.col("head.id")).alias("refers_to"), F.when(later, F.col("head.key")).alias("refers_key")
    )


def _urn(key: str, kind: int) -> str:
    """An identifier for one of a capture's records: kind 0 the response, 1 the request, 2 the metadata."""
    h = f"{key[:12]}5{key[13:16]}{'89ab'[kind]}{key[17:]}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)])
    return gzip.compress(b"%b\r\n\r\n%b\r\n\r\n" % (head, block), 6, mtime=0)


def _capture(row: dict, date: str) -> bytes:
    """The gzip members of one capture."""
    main = _urn(row["key"], 0)
    uri = quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~") if row["url"] else None
    about = [("WARC-Date", date), *([("WARC-Target-URI", uri)] if uri else [])]
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()
    # The length stays that of the whole payload where a revisit leaves it out.
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(row["payload"])
    again = row["refers_to"] is not None
    kind = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", main), *about]
    kind += [("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if again:
        kind += [("WARC-Refers-To", _urn(row["refers_key"], 0)), ("WARC-Profile", SAME_PAYLOAD)]
    rest = (uri or "").partition("://")[2]
    host = rest.partition("/")[0].partition("?")[0].partition("#")[0]
    path = rest[len(host) :].partition("#")[0]
    asked = f"GET {path if path[:1] == '/' else '/' + path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    tied = [*about, ("WARC-Concurrent-To", main)]
    request = [("WARC-Type", "request"), ("WARC-Record-ID", _urn(row["key"], 1)), *tied, ("Content-Type", "application/http; msgtype=request")]
    meta = [("WARC-Type", "metadata"), ("WARC-Record-ID", _urn(row["key"], 2)), *tied, ("Content-Type", "application/json")]
    facts = json.dumps({"id": row["id"], "url": row["url"]}).encode()
    return _record(kind, http + (b"" if again else row["payload"])) + _record(request, asked) + _record(meta, facts)


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, date: str = DATE
) -> None:
    """Write a capture for every row of pages, as gzipped WARC files under path.

    The payload is the html in UTF-8; null is empty. Of rows with equal payloads of
    least_bytes or more, those with the largest id are responses and the others revisit
    them. A null or empty url gives no target URI; other characters than a URI has are
    percent-encoded there, and the metadata record holds id and url as they are. Rows equal
    in id, url and html make equal records. Every file starts with a warcinfo record; no
    rows, no records. Other columns are not written. Spark names the files; path must be new.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(f"{0:032x}", 3)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")]
        size, any_rows = 0, False
        for b in batches:
            columns = {c: b.column(c) for c in b.schema.names}
            for i in range(b.num_rows):
                any_rows = True
                out.append(_capture({c: x[i].as_py() for c, x in columns.items()}, date))
                size += len(out[-1])
                if size >= _BATCH:
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["bytes"])
                    out, size = [], 0
        if any_rows and out:
            yield pa.record_batch([pa.array(out, pa.binary())], names=["bytes"])

    rows = captures_of(pages, id_col, url_col, html_col, least_bytes)
    # As a string the bytes stay as they are; nothing decodes them.
    rows.mapInArrow(members, "bytes binary").select(F.col("bytes").cast("string")).write.options(**_SPLIT).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The members of a piece of gzip, or the piece itself if it is not compressed."""
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        yield z.decompress(data) + z.flush()
        data = z.unused_data
    if data:
        yield data


def records_of(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of the records in a piece of WARC, each inside one member or not.

    Header names are in lower case; a line that continues a header is joined to it. A
    record without a length ends the piece; what stands there in its place fails.
    """
    for text in _inflated(data):
        at = 0
        while at < len(text):
            if text[at : at + 2] == b"\r\n":
                at += 2
                continue
            end = text.find(b"\r\n\r\n", at)
            if text[at : at + 5] != b"WARC/" or end < 0:
                raise ValueError(f"no WARC record at byte {at}: {text[at : at + 40]!r}")
            headers: list[tuple[str, str]] = []
            for line in text[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                if line[:1] in (" ", "\t") and headers:
                    headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
                else:
                    name, _, value = line.partition(":")
                    headers.append((name.strip().lower(), value.strip()))
            length = int(dict(headers)["content-length"])
            at = end + 4 + length
            if at > len(text):
                raise ValueError("a WARC record is cut off")
            yield headers, text[end + 4 : at]


def _hex(value: str | None) -> str | None:
    """A SHA-1 digest header, in base32 or hex, as bare lower-case hex; any other as it is."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() == "sha1" and len(text) == 32:
        return base64.b32decode(text.upper()).hex()
    return text.lower() if kind.lower() == "sha1" else value


def _row(headers: list[tuple[str, str]], block: bytes) -> tuple:
    of = dict(headers)
    kind, about = of.get("warc-type"), of.get("content-type")
    http = content = payload = None
    if kind in ("metadata", "warcinfo"):
        content = block.decode("utf-8", "replace")
    elif (about or "").startswith("application/http"):
        head, mark, payload = block.partition(b"\r\n\r\n")
        http = (head + mark).decode("utf-8", "replace")
    else:
        payload = block
    tied = [v for k, v in headers if k == "warc-concurrent-to"]
    names = ("warc-record-id", "warc-type", "warc-date", "warc-target-uri")
    return (
        *(of.get(n) for n in names), tied, of.get("warc-refers-to"), _hex(of.get("warc-payload-digest")), about, http, content,
        None if kind == "revisit" else payload,
    )


def _parsed(pieces: DataFrame) -> DataFrame:
    names = [f.partition(" ")[0] for f in RECORD.split(", ")]
    kinds = [pa.string()] * 4 + [pa.list_(pa.string())] + [pa.string()] * 5 + [pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for piece in b.column(0):
                for headers, block in records_of(piece.as_py()):
                    out.append(_row(headers, block))
                    size += len(block)
                    if size >= _BATCH:
                        yield _batch(out)
                        out, size = [], 0
            if out:
                yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return pieces.mapInArrow(parse, RECORD)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives that write_warc wrote, as in RECORD; files are read in splits.

    http is the head of an HTTP message and payload what follows it; content is the text of
    a metadata or warcinfo record; any other block is the payload. A revisit has none. A
    payload digest is bare hex.
    """
    lines = spark.read.options(**_SPLIT).text(path)
    return _parsed(lines.select(F.col("value").cast("binary").alias("bytes")))


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of any WARC files, gzipped or not: a file is read whole, 2 GB at most."""
    return _parsed(spark.read.format("binaryFile").load(path).select(F.col("content").alias("bytes")))


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: its record's columns, copies, requests, metadata, refers.

    A capture is a response, revisit or resource record. A request or metadata record
    belongs to every capture that it names as concurrent, or that names it. requests and
    metadata are arrays of structs (record_id, http, content) in order of the identifier,
    as many as the capture has, empty if none; a record that is tied to no capture is in
    none. refers is, for a revisit, the record_id, target_uri, payload_digest and metadata
    of the capture it refers to, null if that is not among the records. Records of one
    identifier are one capture, copies counts them; records without identifier take no part.

    records are as in RECORD; payload, date and content_type may be left out beforehand
    and further columns added, all of which are kept for captures.
    """
    known = records.where(F.col("record_id").isNotNull())
    mains = known.where(F.col("type").isin("response", "revisit", "resource"))
    rest = [c for c in records.columns if c != "record_id"]
    captures = mains.groupBy("record_id").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct(*rest)).alias("r"))
    parts = known.where(F.col("type").isin("request", "metadata")).select(
        "concurrent_to", F.struct("type", "record_id", "http", "content").alias("part")
    )
    naming = parts.select(F.explode("concurrent_to").alias("capture"), "part")
    named = mains.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("other"))
    by_capture = named.join(parts.select("part"), F.col("other") == F.col("part.record_id")).select("capture", "part")
    of = lambda kind: F.sort_array(F.collect_set(F.when(F.col("part.type") == kind, F.col("part").dropFields("type"))))
    tied = naming.unionByName(by_capture).groupBy("capture").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    none = F.array().cast("array<struct<record_id: string, http: string, content: string>>")
    whole = captures.join(tied, F.col("record_id") == F.col("capture"), "left").select(
        "record_id", "r.*", "copies", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata")
    )
    asked = mains.where(F.col("type") == "revisit").select(F.col("refers_to").alias("record_id")).distinct()
    # Written, so that Spark can split the join where one capture has most of the revisits.
    target = cut_lineage(
        whole.where(F.col("type") != "revisit")
        .join(asked, "record_id", "left_semi")
        .select(F.col("record_id").alias("found"), F.struct("record_id", "target_uri", "payload_digest", "metadata").alias("refers"))
    )
    return whole.join(target, F.col("refers_to") == F.col("found"), "left").drop("found")


def repeated(rows: DataFrame) -> DataFrame:
    """Every row as often as its column copies says, without that column."""
    step = 1_000
    runs = rows.withColumn("_run", F.explode(F.sequence(F.lit(0), F.call_function("div", F.col("copies") - 1, F.lit(step)).cast("int"))))
    here = F.least(F.col("copies") - F.col("_run") * step, F.lit(step)).cast("int")
    return runs.withColumn("_copy", F.explode(F.sequence(F.lit(1), here))).drop("copies", "_run", "_copy")
