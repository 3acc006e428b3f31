"""Hard negatives by slots of scores.

An anchor's positives set upper limits. The limits cut its scores into disjoint slots, so
every row that may be a negative falls into one slot; each task keeps the best k of a
slot, the tasks' lists are cut to k again, and an anchor's windows, which overlap, are
answered by joining the slots from their own limit downwards.

Anchors meet rows as blocks meet chunks, both dealt out by a hash of the id, so no task
holds more than one block and one chunk, whatever a label's share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.session import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative's score is at least this share of the positive's, in hundredths, and at most all of it.
LOWEST = 80
# Components of a block of anchors and of a chunk of rows.
BLOCK = 1 << 17
CHUNK = 1 << 20
_STEP = 128
_SCORED = "anchor long, slot int, id long, score long"


def prepared(rows: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, dim, vec) of the rows that take part; vec has whole numbers as doubles.

    Left out: rows with a null id, label or vector, or a component that is null or not
    finite. Rows of one id count once, with the smallest label and vector.
    """
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    # Doubles, as long as a whole number is exact in them; floor() alone would give longs.
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**44, F.floor(v * SCALE).cast("double")).otherwise(v * SCALE))
    named = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vec"), finite.alias("ok"))
    known = named.where("ok AND id IS NOT NULL AND label IS NOT NULL")
    one = known.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"))
    return one.select("id", "r.label", F.size("r.vec").alias("dim"), "r.vec")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: by doubles if every partial sum fits them."""
    most = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    ints = [np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) for x in (a, b)]
    return ints[0].dot(ints[1].T)


def _best(valid: np.ndarray, slots: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest valid scores of every row and slot; ties to the left."""
    r, c = np.nonzero(valid)
    s, slot = scores[r, c], slots[r, c]
    if s.dtype == object:
        s = np.unique(s, return_inverse=True)[1]
    order = np.lexsort((c, -s, slot, r))
    r, c, slot = r[order], c[order], slot[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (slot[1:] != slot[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    keep = np.arange(len(r)) - first < k
    return r[keep], c[keep]


def same_label(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A chunk's best k rows of each anchor's own label, all in slot 0."""

    def combine(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        def choose(at: slice, scores: np.ndarray, same: np.ndarray, a_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            valid = same & (a_ids[:, None] != ids)
            if scores.dtype != object and scores.shape[1] > k:
                ranked = np.where(valid, -scores, np.iinfo(np.int64).max)
                valid &= -scores <= np.partition(ranked, k - 1, axis=1)[:, k - 1 : k]
            return valid, np.zeros(scores.shape, np.int8)

        return _combined(anchors, rows, k, choose)

    return combine


def by_slot(k: int, lowest: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A chunk's best k rows of other labels, in every slot between an anchor's limits.

    Slot j holds scores up to limit j and above limit j + 1. Below its own limit's window
    a score is in no window that reaches the slot.
    """

    def combine(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        limits = anchors["limits"].to_pylist()

        def choose(at: slice, scores: np.ndarray, same: np.ndarray, a_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            valid, slots = np.zeros(scores.shape, bool), np.zeros(scores.shape, np.int16)
            for i, tops in enumerate(limits[at]):
                below = np.array([-t for t in tops], dtype=scores.dtype)  # ascending
                least = np.array([-(-lowest * t // 100) for t in tops], dtype=scores.dtype)
                # Limits not under the score, less one: the lowest limit that still admits it.
                slot = np.searchsorted(below, -scores[i], side="right") - 1
                slots[i] = slot
                valid[i] = (slot >= 0) & (scores[i] >= least[np.maximum(slot, 0)]) & ~same[i]
            return valid, slots

        return _combined(anchors, rows, k, choose)

    return combine


def _combined(anchors: pa.Table, rows: pa.Table, k: int, choose: Callable) -> pa.Table:
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if anchors.num_rows and rows.num_rows:
        dim = anchors["dim"][0].as_py()
        order = np.argsort(rows["id"].to_numpy())
        ids, labels, x = rows["id"].to_numpy()[order], rows["label"].to_numpy()[order], _matrix(rows["vec"], dim)[order]
        a_ids, a_labels, a = anchors["id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["vec"], dim)
        for start in range(0, len(a), _STEP):
            at = slice(start, start + _STEP)
            scores = _products(a[at], x)
            valid, slots = choose(at, scores, a_labels[at, None] == labels, a_ids[at], ids)
            r, c = _best(valid, slots, scores, k)
            found.append((a_ids[at][r], slots[r, c].astype(np.int32), ids[c], scores[r, c].astype(np.int64)))
    return pa.table([np.concatenate(x) for x in zip(*found)], names=["anchor", "slot", "id", "score"])


def _kept(scored: DataFrame, k: int) -> DataFrame:
    """The best k of every anchor and slot over all chunks, ranked from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _met(anchors: DataFrame, rows: DataFrame, chunks: Column, blocks: Column, combine: Callable) -> DataFrame:
    """What combine makes of every block of anchors and every chunk of rows of their length."""
    chunk = F.pmod(F.xxhash64("id"), chunks).cast("int")
    block = F.pmod(F.xxhash64(F.lit(1), "id"), blocks).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keys = ["dim", "block", "chunk"]
    left = anchors.select("*", block.alias("block"), each(chunks).alias("chunk")).drop("chunks", "blocks")
    own = [F.col(c).alias(c) for c in ("id", "label", "dim", "vec")]  # two sides of one frame, told apart
    right = rows.select(*own, chunk.alias("chunk"), each(blocks).alias("block"))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(combine, _SCORED)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    label: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: which rows are anchors, a condition on the column `id`; label: an expression
    on the columns of rows. A score is the inner product of the components times 256,
    rounded down; larger scores come first, ties by smaller id. An anchor's positives are
    its first `positives` other rows of the same label. Of the rows of other labels whose
    score lies between `lowest` hundredths of the positive's and all of it, the first
    `negatives` are returned for each positive, ranked from 1; a positive without any gives
    no row, and neither does one with a score below zero, whose window is empty.

    Rows that take no part: see `prepared`. Rows meet rows of their own length only.
    Empty tables give no rows. A score that does not fit a long fails. Other columns of
    rows are not read, whatever their names.
    """
    used = cut_lineage(prepared(rows, id_col, vec_col, label))
    parts = lambda n, size: F.greatest(F.ceil(n * F.col("dim") / size), F.lit(1)).cast("int")
    sizes = used.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(anchors, 1)).alias("asking"))
    sizes = sizes.select("dim", parts(F.col("n"), chunk).alias("chunks"), parts(F.col("asking"), block).alias("blocks"))
    sized = used.join(sizes, "dim")
    asking = sized.where(anchors)
    near = _met(asking, sized, F.col("chunks"), F.col("blocks"), same_label(positives))
    least = F.ceil(F.col("score").cast("decimal(30,0)") * lowest / 100).cast("long")
    liked = cut_lineage(_kept(near, positives).select(F.col("anchor").alias("anchor_id"), (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("least")))
    # At most `positives` entries for an anchor.
    tops = liked.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    limited = asking.join(tops.select("id", F.col("p.positive_score").alias("limits")), "id")
    slotted = _kept(_met(limited, sized, F.col("chunks"), F.col("blocks"), by_slot(negatives, lowest)), negatives)
    # A row of slot j is under the limits up to j; those of equal limits have one slot.
    entry = F.struct((-F.col("score")).alias("order"), "id", "slot", "score")
    listed = slotted.groupBy(F.col("anchor").alias("anchor_id")).agg(F.sort_array(F.collect_list(entry)).alias("found"))
    # From a limit's slot downwards the slots are one descending list; its window is a cut of it.
    merged = F.slice(F.filter("found", lambda x: x["slot"] >= F.col("place")), 1, negatives)
    window = F.filter(merged, lambda x: x["score"] >= F.col("least"))
    return (
        liked.join(listed, "anchor_id")
        .select("anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("at", "x"))
        .select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))
    )
