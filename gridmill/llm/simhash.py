"""SimHash near-dedup: fingerprints, links by shared blocks, components.

A fingerprint's 64 bits are cut into BLOCKS blocks. Two fingerprints that differ in at
most `bits` bits agree on at least BLOCKS - bits blocks, so they meet under the key of
those blocks. Only different fingerprints meet: copies share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm.components import components
from gridmill.llm.rows import identified
from gridmill.session import cut_lineage

BLOCKS = 7
_AT_ONCE = 65_536


def fingerprint_of(text: bytes | None, words: int = 4) -> int:
    """Unsigned fingerprint of one text: a bit is set if over half of the shingles set it."""
    parts = text.lower().split() if text else []  # bytes: ASCII letters and white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(parts) - words + 1)
    spans = zip(start[:n].tolist(), end[min(words, len(parts)) - 1 :].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        part = np.ascontiguousarray(hashes[at : at + _AT_ONCE].astype("<u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """The fingerprint as a signed long. Lower-cases A-Z; words lie between ASCII white space.

    Fewer words than a shingle make one shingle; none (empty or null text) give 0.
    """

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint_of(x.as_py(), words) for x in column), np.uint64, len(column))
        return pa.array(found.view(np.int64))

    return of(text.cast("binary"))


def _keys(bits: int) -> list[tuple[int, int]]:
    """(number, mask) of each choice of blocks that a close pair may agree on."""
    if not 0 <= bits < BLOCKS:
        raise ValueError(f"bits must be under {BLOCKS}")
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = combinations(masks, BLOCKS - bits)
    return [(i, signed(reduce(int.__or__, c))) for i, c in enumerate(chosen)]


def links(prints: DataFrame, bits: int = 4) -> DataFrame:
    """Links (a, b) between fingerprints of at most `bits` differing bits.

    prints(fp): different, not null. Members of one key are joined up by a walk that
    leaves what it has reached: one link for each member reached, no more, so a dense
    group gives as many links as members, and no connection is lost.
    """
    keyed = prints.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in _keys(bits)])
        ).alias("key"),
    ).select("key.no", "key.part", "fp")
    ordered = keyed.repartition("no", "part").sortWithinPartitions("no", "part", "fp")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, part, fp in _whole_runs(batches):
            a, b = _tree(no, part, fp, bits)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return ordered.mapInArrow(walk, "a long, b long").distinct()


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted batches as arrays that never end inside a key; a key's rest is carried on."""
    rest: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = tuple(batch.column(i).to_numpy() for i in range(3))
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cut = int(np.argmax(last))  # sorted: the last key's first row
        if cut or (rest and (rest[-1][0][-1], rest[-1][1][-1]) != (cols[0][0], cols[1][0])):
            yield tuple(np.concatenate(x) for x in zip(*rest, tuple(c[:cut] for c in cols)))
            rest = []
        rest.append(tuple(c[cut:] for c in cols))
    if rest:
        yield tuple(np.concatenate(x) for x in zip(*rest))


def _tree(no: np.ndarray, part: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, (no[1:] != no[:-1]) | (part[1:] != part[:-1])]) if len(fp) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(fp)])
    two = first[size == 2]
    near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= bits if len(two) else np.zeros(0, bool)
    a, b = [fp[two][near]], [fp[two + 1][near]]
    for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        left = fp[at : at + n]
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                here = queue.pop()
                close = np.bitwise_count((left ^ here).view(np.uint64)) <= bits
                reached = left[close]
                if len(reached):
                    a.append(np.full(len(reached), here))
                    b.append(reached)
                    queue.extend(reached)
                    left = left[~close]
    return np.concatenate(a), np.concatenate(b)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4
) -> DataFrame:
    """(id, fp, component_id): one row per document.

    Documents link if their fingerprints differ in at most `bits` bits; component_id is
    the smallest id reachable. Null text counts as empty; empty texts link to each other
    as any equal fingerprints do. A null id gets a row too, and counts only where no
    other id is in reach. Repeated ids and rows stay.
    """
    rows = cut_lineage(
        docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp"))
    )
    least = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("id")))
    roots = components(links(least.select("fp"), bits)).select(F.col("node").alias("fp"), "root")
    classes = least.join(roots, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    of_print = cut_lineage(classes.join(smallest, "root").select("fp", "component_id"))
    return rows.join(of_print, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One document of each near-duplicate group, all columns: the smallest id, null last.

    Of rows with the same id that with the smallest hash of
    its text stays.
    """
    rows, row = identified(docs)
    place = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(row).alias("row"))
    groups = near_groups(rows.select(place.alias("place"), F.col(text_col).alias("text")), "place", "text", words, bits)
    kept = groups.select(F.col("component_id.row").alias(row)).distinct()
    return rows.join(kept, row, "left_semi").select(*docs.columns)
