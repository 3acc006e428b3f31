"""Dependency closure."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridmill.session import cut_lineage, path_exists, work_path

# Levels that one round goes down from what is newly reached: one at first, as most graphs
# are shallow, more of them after so many rounds.
_STEPS = 4
_SHALLOW = 8


class DependencyCycle(ValueError):
    """The dependencies of the roots go round in a circle through `node`."""

    def __init__(self, node: object) -> None:
        super().__init__(f"dependencies form a cycle through {node!r}")
        self.node = node


def dependency_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every dependant of the roots once, with its greatest depth.

    edges(parent, child), roots(node). Self-edges and NULL ends are left out. Create in
    ascending depth, drop in descending depth. What the roots reach is found first, each
    node once; then nodes are taken off whose parents all have been, and the round that
    takes a node off is its depth. A round writes only what is new or still waits, and a
    lost executor costs a round's tasks at most. If a round takes nothing off and nodes are left, those hold a cycle: an
    error, DependencyCycle, that names a node on it.
    """
    links = cut_lineage(
        edges.where(F.col("parent") != F.col("child")).select("parent", "child").distinct()
    )
    reached = _reached(links, roots)
    inner = cut_lineage(links.join(reached.select(F.col("node").alias("parent")), "parent", "left_semi"))
    parents = inner.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("waits"))
    first = reached.join(parents, "node", "left").select("node", F.coalesce("waits", F.lit(0)).alias("waits"))
    return _peeled(inner, first)


def _reached(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): the roots and all that depends on them, each once."""
    spark = links.sparkSession
    base = work_path(spark, "reach")
    fresh = roots.where(F.col("node").isNotNull()).select("node").distinct()
    for at in count():
        seen = Observation()
        fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{base}/at={at}")
        known = spark.read.schema(fresh.schema).parquet(base).select("node")
        if not seen.get["n"]:
            return known
        steps = [spark.read.schema(fresh.schema).parquet(f"{base}/at={at}")]
        for _ in range(1 if at < _SHALLOW else _STEPS):
            below = links.join(steps[-1], F.col("parent") == F.col("node"), "left_semi")
            steps.append(below.select(F.col("child").alias("node")).distinct())
        fresh = reduce(DataFrame.unionByName, steps[1:]).distinct().join(known, "node", "left_anti")


def _peeled(inner: DataFrame, waiting: DataFrame) -> DataFrame:
    """(node, depth) of all nodes that have a parent. waiting(node, waits): parents not yet taken off."""
    spark = inner.sparkSession
    base = work_path(spark, "peel")
    schema = waiting.schema
    left = "node", F.col("waits")

    def kept(depth: int, waits: bool) -> DataFrame | None:
        path = f"{base}/depth={depth}/waiting={str(waits).lower()}"
        return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else None

    depth, state = 0, waiting.select(*left)
    while True:
        state.withColumn("waiting", F.col("waits") > 0).write.partitionBy("waiting").parquet(f"{base}/depth={depth}")
        off, still = kept(depth, False), kept(depth, True)
        if still is None:
            break
        if off is None:
            raise DependencyCycle(_on_cycle(inner, still))
        gone = inner.join(off, F.col("parent") == F.col("node"), "left_semi").groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("gone"))
        state = still.join(gone, "node", "left").select("node", (F.col("waits") - F.coalesce("gone", F.lit(0))).alias("waits"))
        depth += 1
    done = spark.read.option("basePath", base).schema(f"{schema[0].simpleString().replace(':', ' ')}, waits long, depth int, waiting boolean").parquet(base)
    return done.where(~F.col("waiting") & (F.col("depth") > 0)).select("node", "depth")


def _on_cycle(inner: DataFrame, still: DataFrame) -> object:
    """A node on a cycle among the nodes that still wait.

    Each of them has a parent among them; going up to the smallest such parent as many
    steps as there are nodes ends on a cycle, and each round doubles the steps.
    """
    names = still.select("node")
    among = inner.join(names.select(F.col("node").alias("parent")), "parent", "left_semi").join(
        names.select(F.col("node").alias("child")), "child", "left_semi"
    )
    up = cut_lineage(among.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("above")))
    steps, nodes = 1, still.count()
    while steps < nodes:
        over = up.select(F.col("node").alias("above"), F.col("above").alias("next"))
        up = cut_lineage(up.join(over, "above").select("node", F.col("next").alias("above")))
        steps *= 2
    return up.agg(F.min("above")).first()[0]


def create_order(closure: DataFrame) -> DataFrame:
    """Parents first."""
    return closure.orderBy("depth", "node")


def drop_order(closure: DataFrame) -> DataFrame:
    """Dependants first."""
    return closure.orderBy(F.col("depth").desc(), "node")
