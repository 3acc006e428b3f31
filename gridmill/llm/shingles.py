"""Near-dedup by SimHash, and the Jaccard similarity of word shingles.

Candidates meet under the component of their fingerprints (simhash.links), which holds all
pairs that few bits part. Of pairs of similarity 0.8 most differ in more bits than blocks
can bear, so candidates also meet under bands of MinHash values. Of the texts of one
component or band those whose sets of shingle hashes are at least as similar as asked are
linked, exactly. A pair of similarity 0.8 meets in none of BANDS bands of ROWS values with
a chance of (1 - 0.8**4)**24, 3e-6; more similar pairs with less. Texts of one set are one
class and meet once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm.components import components
from gridmill.llm.rows import identified
from gridmill.llm.simhash import fingerprint
from gridmill.llm.simhash import links as close_prints
from gridmill.session import cut_lineage

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 24, 4
BITS = 4
_AT_ONCE = 16_384
_FACTORS = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(BANDS * ROWS)], np.uint64)
_ADDED = np.array([xxhash.xxh64_intdigest(str(i), 1) for i in range(BANDS * ROWS)], np.uint64)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted different hashes of a text's shingles. Lower-cases A-Z; words lie between
    ASCII white space. Fewer words than a shingle make one shingle, none make none.
    """
    parts = text.lower().split() if text else []  # bytes: ASCII letters and white space only
    if not parts:
        return np.zeros(0, np.uint64)
    n = max(1, len(parts) - words + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(parts[i : i + words])) for i in range(n)), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS MinHash values each; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _AT_ONCE):
        least = np.minimum(least, (hashes[at : at + _AT_ONCE] * _FACTORS[:, None] + _ADDED[:, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _signed(text: Column, words: int) -> Column:
    """Struct of a digest of the shingles, and their bands."""

    @F.arrow_udf("set long, bands array<long>")
    def of(column: pa.Array) -> pa.Array:
        sets = [shingles(x.as_py(), words) for x in column]
        digests = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        lists = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(digests), lists], ["set", "bands"])

    return of(text.cast("binary"))


def _hashes(text: Column, words: int) -> Column:
    @F.arrow_udf("binary")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([shingles(x.as_py(), words).tobytes() for x in column], pa.binary())

    return of(text.cast("binary"))


def _tree(ids: list[int], sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Links that join up all members of a band that similar pairs connect."""
    a, b, left = [], [], list(range(len(ids)))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and left:
            here = queue.pop()
            rest = []
            for other in left:
                if _similar(sets[here], sets[other], least):
                    a.append(ids[here])
                    b.append(ids[other])
                    queue.append(other)
                else:
                    rest.append(other)
            left = rest
    return a, b


def _similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if len(x) < least * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both >= least * (len(x) + len(y) - both)


def links(texts: DataFrame, prints: DataFrame, words: int = WORDS, least: float = LEAST, bits: int = BITS) -> DataFrame:
    """Links (a, b) between sets of at least that similarity.

    texts(set, bands, text): one row for each set. prints(set, fp): fingerprints of its
    texts, different rows. Members of one band, or of one component of fingerprints that
    differ in at most `bits` bits, are joined up by a walk in one task, which holds their
    hashes; bands with the same members are walked once.
    """
    roots = components(close_prints(prints.select("fp").distinct(), bits)).select(F.col("node").alias("fp"), "root")
    close = prints.join(roots, "fp", "left").select("set", F.lit(BANDS).alias("no"), F.coalesce("root", "fp").alias("band")).distinct()
    banded = texts.select("set", F.posexplode("bands").alias("no", "band")).unionByName(close)
    met = banded.groupBy("no", "band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set")).alias("all"), F.min("set").alias("least"))
    once = met.where("n > 1").groupBy("n", "all", "least").agg(F.min(F.struct("no", "band")).alias("key")).select("key.no", "key.band")
    members = cut_lineage(banded.join(once, ["no", "band"]))
    hashed = texts.join(members.select("set").distinct(), "set", "left_semi").select("set", _hashes(F.col("text"), words).alias("hashes"))
    ordered = members.join(cut_lineage(hashed), "set").select("no", "band", "set", "hashes").repartition("no", "band").sortWithinPartitions("no", "band", "set")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for _, group in groupby(rows, lambda r: r[:2]):
            _, _, ids, sets = zip(*group)
            a, b = _tree(list(ids), [np.frombuffer(s, np.uint64) for s in sets], least)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(walk, "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One document of each group that similar pairs connect, all columns: the smallest id, null last.

    Null and empty texts are copies of each other. Of rows with the same id that with
    the smallest hash of its text stays.
    """
    rows, row = identified(docs)
    place = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(row).alias("row"))
    # As generated rows the sets are made once, whatever asks for them.
    made = F.struct(_signed(F.col(text_col), words).alias("s"), fingerprint(F.col(text_col), words).alias("fp"))
    signed = cut_lineage(rows.select(place.alias("place"), F.explode(F.array(made)).alias("m")).select("place", "m.s.*", "m.fp"))
    classes = cut_lineage(signed.groupBy("set").agg(F.min(F.struct("place", "bands")).alias("x")).select("set", "x.*"))
    texts = classes.join(rows.select(F.col(row).alias("of"), F.col(text_col).alias("text")), F.col("place.row") == F.col("of"))
    prints = cut_lineage(signed.select("set", "fp").distinct())
    roots = components(links(texts, prints, words, least)).select(F.col("node").alias("set"), "root")
    firsts = classes.join(roots, "set", "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("place").alias("place"))
    return rows.join(firsts.select(F.col("place.row").alias(row)), row, "left_semi").select(*docs.columns)
