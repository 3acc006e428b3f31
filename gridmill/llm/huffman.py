"""Token ids in files of canonical length-limited Huffman codes.

A table of blocks: each holds up to BLOCK ids in one bit string, the bit offset of every
STEPth id of each document, and the documents it covers. A block needs only the code lengths to be read,
and inside it every stretch between checkpoints is decoded side by side through one
table, so blocks can be read in any order and by any task. Documents lie in ascending id
order over parts, blocks and ids; a document longer than a block has blocks of its own.
Spark's own writer commits the files, so a lost executor leaves no half of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.llm.bpe import encoder
from gridmill.session import work_path

BLOCK = 65_536
STEP = 64
LIMIT = 20
# Ids of the documents in one range of document ids, about; ids that are encoded at once.
PART = 8_000_000
_AT_ONCE = 1_000_000
_BLOCKS = (
    "part int, block int, start long, doc_start long, piece int, n_ids int,"
    " doc_ids array<long>, doc_sizes array<int>, offsets binary, payload binary"
)

_CODED = "part int, id long, mix long, row long, piece int, n_ids int, offsets binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length for each count (0 where the count is 0), at most `limit`; package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} different ids need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(row) // 2 * 2
        both = np.concatenate([leaves, row[0:even:2] + row[1:even:2]])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        row = both[at]
    size, take = np.zeros(n, np.uint8), 2 * n - 2
    for leaf in reversed(levels):
        inside = int(leaf[:take].sum())
        size[:inside] += 1
        take = 2 * (take - inside)
    lengths[order] = size
    return lengths


class Codes:
    """Canonical codes of given lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        self.length = lengths.astype(np.int64)
        self.symbols = used[np.lexsort((used, lengths[used]))]
        self.bits = int(lengths.max()) if len(used) else 0
        span = np.int64(1) << (self.bits - self.length[self.symbols])
        self.code = np.zeros(len(lengths), np.uint64)
        self.code[self.symbols] = ((np.cumsum(span) - span) >> (self.bits - self.length[self.symbols])).astype(np.uint64)
        self._span = span

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[bytes, bytes]]:
        """(bit string, bit offsets of every STEPth id) of each of the texts in turn.

        sizes: ids of each text, none empty. Every text begins at a whole byte.
        """
        length, first = self.length[ids], np.cumsum(sizes) - sizes
        used = -(-np.add.reduceat(length, first) // 8)
        base = (np.cumsum(used) - used) * 8
        at = np.cumsum(length) - length
        at += np.repeat(base - at[first], sizes)
        words = np.zeros(int(used.sum()) // 8 + 2, np.uint64)
        word, left = at >> 6, 64 - (at & 63) - length
        code = self.code[ids]
        high = np.where(left >= 0, code << np.maximum(left, 0).astype(np.uint64), code >> np.maximum(-left, 0).astype(np.uint64))
        new = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[new]] = np.add.reduceat(high, new)
        over = left < 0
        words[word[over] + 1] += code[over] << (64 + left[over]).astype(np.uint64)
        raw, marks = words.astype(">u8").tobytes(), -(-sizes // STEP)
        step = np.repeat(first - (np.cumsum(marks) - marks) * STEP, marks) + np.arange(int(marks.sum())) * STEP
        offsets = (at[step] - np.repeat(base, marks)).astype("<u4").tobytes()
        ends, begins = np.cumsum(marks) * 4, base // 8
        return [(raw[x : x + n], offsets[e - 4 * m : e]) for x, n, e, m in zip(begins.tolist(), used.tolist(), ends.tolist(), marks.tolist())]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length by the next `bits` bits."""
        full = 1 << self.bits
        symbol, length = np.zeros(full, "<u4"), np.ones(full, np.int64)
        n = int(self._span.sum())
        symbol[:n] = np.repeat(self.symbols, self._span)
        length[:n] = np.repeat(self.length[self.symbols], self._span)
        return symbol, length


def decode(payload: bytes, offsets: np.ndarray, sizes: np.ndarray, bits: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a block's documents; all stretches between checkpoints advance together.

    Each document begins a stretch of its own; its last may be short.
    """
    symbol, length = table
    raw = np.frombuffer(payload + bytes(STEP * bits // 8 + 8), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at, out = offsets.astype(np.int64), np.empty((STEP, len(offsets)), "<u4")
    mask = np.uint32((1 << bits) - 1)
    for i in range(STEP):
        key = (window[at >> 3] >> (32 - bits - (at & 7)).astype(np.uint32)) & mask
        out[i] = symbol[key]
        at += length[key]
    stretches = -(-sizes // STEP)
    last = np.cumsum(stretches) - 1
    full = np.full(len(offsets), STEP)
    full[last] = sizes - (stretches - 1) * STEP
    return out.T[np.arange(STEP) < full[:, None]]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): little-endian unsigned 32-bit ids of each text, and the end id."""

    @F.arrow_udf("binary")
    def ids_of(texts: pa.Array) -> pa.Array:
        sizes, ids = encoder(tokenizer)(texts)
        ends = np.cumsum(sizes)
        all_ids = np.insert(ids, ends, end_id).astype("<u4")
        cuts = np.r_[0, 4 * (ends + np.arange(1, len(ends) + 1))]
        return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(all_ids)]).cast(pa.binary())

    return docs.select(F.col(id_col).cast("long").alias("id"), ids_of(F.col(text_col)).alias("ids"))


def write_ids(tokens: DataFrame, path: str) -> None:
    """Write (id, ids) as code lengths and blocks under path, ids ascending, null first.

    Rows with the same id follow each other. Reads `tokens` twice: to count all ids, and
    to encode each document, which is then dealt out in its coded form. Only the counts,
    at most one row for each different id, come to the driver.
    """
    counts = tokens.select("ids").mapInArrow(_count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    pairs = counts.toPandas()
    total = np.zeros(int(pairs["token"].max()) + 1 if len(pairs) else 1, np.int64)
    total[pairs["token"]] = pairs["n"]
    codes = Codes(code_lengths(total))
    spark = tokens.sparkSession
    table = [(int(s), int(codes.length[s])) for s in codes.symbols]
    spark.createDataFrame(table, "token int, length int").coalesce(1).write.parquet(f"{path}/codes")

    # Documents are dealt out by ranges of their ids, cut where these quantiles lie.
    parts = -(-int(total.sum()) // PART)
    cuts = tokens.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = np.unique(np.array(cuts, np.float64))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(batches, codes, bounds)

    (
        tokens.mapInArrow(encoded, _CODED)
        .repartitionById(len(bounds) + 1, F.col("part"))
        .sortWithinPartitions("part", "id", "mix", "row", "piece")
        .mapInArrow(_blocks, _BLOCKS)
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for x in batch.column(0):
            new = np.bincount(np.frombuffer(x.as_buffer(), "<u4"), minlength=len(total))
            new[: len(total)] += total
            total = new
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["token", "n"])


def _encoded(batches: Iterator[pa.RecordBatch], codes: Codes, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each document as a bit string of its own, or as several where it is longer than a block.

    row keeps the pieces of equal documents apart.
    """
    row_no = TaskContext.get().partitionId() << 32
    names = ["part", "id", "mix", "row", "piece", "n_ids", "offsets", "payload"]
    kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.int32()] * 2, *[pa.binary()] * 2]
    rows: list[tuple] = []
    held: list[np.ndarray] = []

    def made() -> pa.RecordBatch:
        coded = codes.encode(np.concatenate(held), np.array([len(h) for h in held], np.int64))
        columns = [*zip(*rows), [o for _, o in coded], [p for p, _ in coded]]
        held.clear()
        rows.clear()
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    size = 0
    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            buffer = raw.as_buffer()
            ids, mix = np.frombuffer(buffer, "<u4"), xxhash.xxh64_intdigest(buffer) >> 1
            part = 0 if doc_id is None else int(np.searchsorted(bounds, doc_id, "right"))
            for at in range(0, len(ids), BLOCK):
                held.append(ids[at : at + BLOCK])
                rows.append((part, doc_id, mix, row_no, at // BLOCK if len(ids) > BLOCK else -1, len(held[-1])))
            row_no += 1
            size += len(ids)
            if size > _AT_ONCE:
                yield made()
                size = 0
    if rows:
        yield made()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit strings in order, joined into blocks; each begins at a whole byte."""
    schema = pa.schema(
        [("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_start", pa.int64()), ("piece", pa.int32()), ("n_ids", pa.int32()),
         ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int32())), ("offsets", pa.binary()), ("payload", pa.binary())]
    )
    part, block, start, doc_start = -1, 0, 0, 0

    def made(rows: list[tuple], piece: int) -> pa.RecordBatch:
        nonlocal block, start
        ids, sizes, offsets, payloads = zip(*rows)
        first = np.cumsum([0, *map(len, payloads[:-1])]) * 8
        shifted = np.concatenate([np.frombuffer(o, "<u4") + f for o, f in zip(offsets, first)]).astype("<u4")
        row = [part, block, start, doc_start if piece >= 0 else start, piece, sum(sizes), list(ids), list(sizes), shifted.tobytes(), b"".join(payloads)]
        block, start = block + 1, start + sum(sizes)
        return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for own, doc_id, _, _, piece, n, offsets, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (piece >= 0 or size + n > BLOCK or own != part):
                yield made(held, -1)
                held, size = [], 0
            if own != part:
                part, block, start = own, 0, 0
            if piece >= 0:
                doc_start = start if piece == 0 else doc_start
                yield made([(doc_id, n, offsets, payload)], piece)
            else:
                held.append((doc_id, n, offsets, payload))
                size += n
    if held:
        yield made(held, -1)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of each document; start counts the ids of all before it."""
    pairs = spark.read.parquet(f"{path}/codes").toPandas()
    lengths = np.zeros(int(pairs["token"].max()) + 1 if len(pairs) else 1, np.uint8)
    lengths[pairs["token"]] = pairs["length"]
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # One row for each part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def docs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(lengths)
        table = codes.table()
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["doc_sizes"], np.int64)
                ids = decode(r["payload"], np.frombuffer(r["offsets"], "<u4"), sizes, codes.bits, table)
                ends = np.cumsum(sizes)
                starts = r["base"] + (r["doc_start"] if r["piece"] >= 0 else r["start"] + ends - sizes)
                raw = [ids[e - s : e].tobytes() for s, e in zip(sizes, ends)]
                yield pa.record_batch(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(np.broadcast_to(starts, len(sizes)), pa.int64()), pa.array([r["piece"]] * len(sizes), pa.int32()), pa.array(raw, pa.binary())],
                    names=["id", "start", "piece", "ids"],
                )

    # Blocks of several documents give whole ones; only long documents' pieces meet again.
    found = blocks.join(bases, "part")
    schema = "id long, start long, piece int, ids binary"
    whole = found.where("piece < 0").mapInArrow(docs_of, schema)
    pieces = found.where("piece >= 0").mapInArrow(docs_of, schema)
    joined = pieces.groupBy("start", "id").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    glued = joined.select("id", "start", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return whole.select("id", "start", "ids").unionByName(glued.select("id", "start", "ids")).select(
        "id", "start", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), "ids"
    )


def huffman_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty) and write the ids of docs under path.

    Each document ends with end_id. Repeated rows stay; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    held = work_path(spark, "tokens")
    tokenized(docs, tokenizer, end_id, id_col, text_col).write.option("compression", "zstd").parquet(held)
    write_ids(spark.read.parquet(held), path)
