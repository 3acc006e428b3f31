"""Ordered work over keys of any size, in slices of an order.

An order (a time and what ranks equal times) is cut into slices that hold about the same
number of rows, at splitters from a sample. Work inside a slice of a key is a window; what
crosses slices is joined up over one row for each slice and key. Slice numbers that may be
many are taken together in groups of 2**GROUP_BITS, groups in groups of groups, so that no
window ever holds more rows than one group has slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.session import cut_lineage

GROUP_BITS = 20
# Rows that a slice is meant to hold, and slices at most; beyond both, slices grow.
ROWS = 1_000_000
MOST = 4_096
# Sampled rows for each slice. With 64, one slice in a million holds twice its share.
_SAMPLED = 64


@dataclass(frozen=True)
class Slices:
    """Where an order is cut. count 1: not at all."""

    count: int
    cuts: DataFrame | None = None

    def numbered(self, df: DataFrame, order: Column, name: str) -> DataFrame:
        """df with the number of the slice that a row falls in: of cuts that are not after it.

        order: a struct of the types that the slices were cut by. Each step halves the
        cuts that are left, so 4,096 slices cost 12 comparisons a row, in generated code.
        """
        if self.cuts is None:
            return df.withColumn(name, F.lit(0))
        cuts, own = self.cuts.scalar(), f"{name}_order"
        out = df.select("*", order.alias(own), F.lit(0).alias(name))
        for i in reversed(range(self.count.bit_length())):
            after = F.get(cuts, F.col(name) + ((1 << i) - 1)) <= F.col(own)
            out = out.withColumn(name, F.when(after, F.col(name) + (1 << i)).otherwise(F.col(name)))
        return out.drop(own)


def cut_slices(rows: DataFrame, order: Column, per_slice: int = ROWS) -> Slices:
    """Slices of about per_slice rows each, over all keys, so they hold even if one key has
    every row; at most MOST.

    The rows are counted, and if they need cuts, a sample of 64 rows a slice is sorted and
    every 64th of it is a cut. So no shuffle grows with the rows or with different values,
    and many rows at one moment are cut by the next columns. Only rows equal in the whole
    order, a struct, cannot be cut. The cuts are written, so all that reads them sees the same.
    """
    wanted = rows.select(order.alias("order"))
    n = wanted.count()
    count = min(MOST, -(-n // per_slice))
    if count <= 1:
        return Slices(1)
    few = wanted.sample(fraction=min(1.0, _SAMPLED * count / n), seed=1)
    at = lambda i: F.floor(i * F.size("sorted") / count).cast("int")
    cuts = few.agg(F.sort_array(F.collect_list("order")).alias("sorted")).select(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(count - 1)), lambda i: F.get("sorted", at(i)))).alias("cuts")
    )
    return Slices(count, cut_lineage(cuts))


def link_neighbours(
    ends: DataFrame, keys: Sequence[str], slice_no: str, levels: int
) -> list[DataFrame]:
    """Pairs of a slice's last row and the first row of the key's next slice.

    ends: keys, slice_no, head and tail (structs). Each level gives keys, tail, next.
    """
    found = []
    for level in range(levels, 0, -1):
        group = _group(slice_no)
        last = level == 1
        order = Window.partitionBy(*keys, *([] if last else [group])).orderBy(slice_no)
        found.append(
            ends.withColumn("next", F.lead("head").over(order))
            .where(F.col("next").isNotNull())
            .select(*keys, "tail", "next")
        )
        if not last:
            ends = ends.groupBy(*keys, group.alias(slice_no)).agg(
                F.min("head").alias("head"), F.max("tail").alias("tail")
            )
    return found


def sums_before(
    totals: DataFrame, keys: Sequence[str], slice_no: str, cols: Sequence[str], levels: int
) -> DataFrame:
    """Per slice, the sum of each column over the key's earlier slices (NULL for none).

    totals: keys, slice_no, cols; keys are not NULL.
    """
    last = levels == 1
    group = f"_group{levels}"
    grouped = totals if last else totals.withColumn(group, _group(slice_no))
    before = (
        Window.partitionBy(*keys, *([] if last else [group]))
        .orderBy(slice_no)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = grouped.select(
        *keys,
        slice_no,
        *([] if last else [group]),
        *[F.sum(c).over(before).alias(c) for c in cols],
    )
    if last:
        return within
    groups = totals.groupBy(*keys, _group(slice_no).alias(group)).agg(
        *[F.sum(c).alias(c) for c in cols]
    )
    outer = sums_before(groups, keys, group, cols, levels - 1).select(
        *keys, group, *[F.col(c).alias(f"_outer_{c}") for c in cols]
    )
    return within.join(outer, [*keys, group]).select(
        *keys, slice_no, *[_plus(F.col(c), F.col(f"_outer_{c}")).alias(c) for c in cols]
    )


def _group(slice_no: str) -> Column:
    return F.shiftright(slice_no, GROUP_BITS)


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)
