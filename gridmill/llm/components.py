"""Connected components of a link table, by rounds of grouping and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node it can reach.

    links(a, b), any direction, repeats and self-links allowed. Large-star and
    small-star rounds, each written to the shared folder, until a round changes nothing;
    a hot node costs one minimum and a join that Spark may split, never a list. Nodes
    without a link to another are not returned.
    """
    now = cut_lineage(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _mark(links: DataFrame) -> tuple:
    """Count and an order-free digest of the links."""
    bits = F.xxhash64("hi", "lo")
    row = links.agg(F.count(F.lit(1)), F.bit_xor(bits), F.sum(F.shiftright(bits, 24))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    return larger.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
