"""Nearest neighbours by inner product over balanced posting lists.

Centroids are fitted on a bounded sample by halving it again and again along its widest
direction, so lists are balanced. Every vector goes to its nearest list and, near a
boundary, to further ones. A query finds its centroids by walking a graph that is held in
memory, keeps all within a ratio of the nearest, and is scored against their lists. The
centroids in memory are bounded in number, so lists that outgrow PART are split the same
way once more, each by itself, and queries are led to the parts by the same ratio.
Equal vectors are searched once, as one class with its smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.session import cut_lineage

SAMPLE = 32_768
LIST = 128
# Centroids in memory at most; what they leave in lists of more than PART is split again.
TOP = 4_096
PART = 4_096
# Vectors within this ratio of the nearest centroid's distance go to those lists too.
NEAR = 1.08
COPIES = 6
# All lists within this ratio of the nearest centroid's distance are searched, and the
# nearest few in any case; in a list that is split, its parts likewise.
RATIO = 1.1
LEAST = 24
LEAST_PARTS = 6
# Centroids that a query visits before its walk may end.
WALK = 96
# Rows of one side that meet rows of the other in one group; rows led to parts at once.
CHUNK = 4_096
_ROUTE = 65_536
_LINKS = 24


@dataclass
class Centroids:
    points: np.ndarray
    graph: list[np.ndarray]
    top: float  # largest squared norm: the room that lifted vectors share

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with one more component, so that the nearest has the largest product."""
        rest = np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0.0))
        return np.column_stack([x, rest])

    def lists_of(self, x: np.ndarray, copies: int = COPIES) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of vectors: the nearest list, and others that are nearly as near."""
        rows, lists = [], []
        for at in range(0, len(x), 512):
            part = self.lifted(x[at : at + 512])
            d = np.maximum(((part**2).sum(1)[:, None] + (self.points**2).sum(1)) - 2 * part @ self.points.T, 0)
            m = min(copies, d.shape[1])
            best = np.argpartition(d, m - 1, axis=1)[:, :m]
            near = np.take_along_axis(d, best, 1)
            r, c = np.nonzero(near <= NEAR**2 * near.min(axis=1, keepdims=True))
            rows.append(r + at)
            lists.append(best[r, c])
        return np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, int), *lists])

    def nearest(self, q: np.ndarray) -> list[int]:
        """Lists to search for one query: best-first over the graph, then by the ratio."""
        x = np.append(q, 0.0)
        away = lambda nodes: ((self.points[nodes] - x) ** 2).sum(axis=1)
        seen = np.zeros(len(self.points), bool)
        seen[0] = True
        open_ = [(float(away([0])[0]), 0)]
        found: list[tuple[float, int]] = []
        limit = np.inf
        while open_ and (len(found) < WALK or open_[0][0] <= limit):
            found.append(heapq.heappop(open_))
            limit = min(limit, RATIO**2 * found[-1][0])
            node = found[-1][1]
            fresh = self.graph[node][~seen[self.graph[node]]]
            seen[fresh] = True
            for e, other in zip(away(fresh).tolist() if len(fresh) else [], fresh.tolist()):
                heapq.heappush(open_, (e, other))
        return [node for i, (d, node) in enumerate(sorted(found)) if i < LEAST or d <= limit]

    def parts_for(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of queries: by the ratio over all points."""
        rows, parts = [], []
        for at in range(0, len(q), 512):
            x = np.column_stack([q[at : at + 512], np.zeros(len(q[at : at + 512]))])
            d = np.maximum(((x**2).sum(1)[:, None] + (self.points**2).sum(1)) - 2 * x @ self.points.T, 0)
            few = np.partition(d, min(LEAST_PARTS, d.shape[1]) - 1, axis=1)[:, min(LEAST_PARTS, d.shape[1]) - 1]
            r, c = np.nonzero(d <= np.maximum(few, RATIO**2 * d.min(axis=1))[:, None])
            rows.append(r + at)
            parts.append(c)
        return np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, int), *parts])


def _halves(x: np.ndarray, n: int) -> list[np.ndarray]:
    """n (a power of two) equal parts of x, each part's mean."""
    if n == 1:
        return [x.mean(axis=0)]
    centred = x - x.mean(axis=0)
    way = centred[np.argmax((centred**2).sum(axis=1))]
    for _ in range(8):
        way = centred.T @ (centred @ way)
        way = way / (np.linalg.norm(way) or 1.0)
    order = np.argsort(centred @ way, kind="stable")
    half = len(order) // 2
    return _halves(x[order[:half]], n // 2) + _halves(x[order[half:]], n // 2)


def centres(sample: np.ndarray, lists: int, top: float) -> np.ndarray:
    """Centroids of a sample; lists is cut down to a power of two the sample can fill."""
    n = 1
    while 2 * n <= min(lists, len(sample) // 4):
        n *= 2
    return np.array(_halves(Centroids(np.zeros((0, 0)), [], top).lifted(sample), n))


def fit(sample: np.ndarray, lists: int, top: float) -> Centroids:
    """Centroids with the graph that is walked to find them."""
    points = centres(sample, min(lists, TOP), top)
    n = len(points)
    # Each with its nearest, and with the nearest before it, so all can be reached.
    links: list[set[int]] = [set() for _ in range(n)]
    norm = (points**2).sum(axis=1)
    for i in range(n):
        d = norm - 2 * points @ points[i]
        d[i] = np.inf
        near = np.argpartition(d, min(_LINKS, n - 1) - 1)[:_LINKS] if n > 1 else []
        for j in [*near, *([int(np.argmin(d[:i]))] if i else [])]:
            if j != i:
                links[i].add(int(j))
                links[int(j)].add(i)
    return Centroids(points, [np.array(sorted(x), int) for x in links], top)


def usable(vec: Column) -> Column:
    """Not null, not zero, every component there and finite."""
    x = vec.cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _ranked(vectors: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(d1, d2, id, vec, place): the k smallest ids of each different vector."""
    one = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(vec_col).alias("vec"))
    sized = one.withColumn("dim", F.size("vec"))
    dims = sized.groupBy("dim").count().orderBy(F.col("count").desc(), F.col("dim").desc()).limit(1).select("dim")
    keyed = sized.join(dims, "dim").select(F.xxhash64("vec").alias("d1"), F.xxhash64(F.lit(1), "vec").alias("d2"), "id", "vec")
    place = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("id"))
    return keyed.withColumn("place", place).where(F.col("place") <= k)


def _split(postings: DataFrame, calls: DataFrame, dim: int, top: float) -> tuple[DataFrame, DataFrame]:
    """Postings and calls (list, id, vec) with the part of the list; part 0 where it is whole.

    Lists of 2 * PART vectors or more are split; a part's centroids come from a sample
    of the list, SAMPLE at most. A vector goes to one part of each of its lists. Of split lists there are as many as of lists at most.
    """
    large = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * PART)
    parts = F.floor(F.col("n") / PART)
    share = F.least(16 * parts, F.lit(SAMPLE)).cast("long")
    sample = postings.join(large, "list").where(F.pmod(F.xxhash64(F.lit(2), "id"), F.col("n")) < share).select("list", parts.cast("int").alias("parts"), "vec")

    def fitted(group: pa.Table) -> pa.Table:
        points = centres(_matrix(group["vec"].combine_chunks(), dim), group["parts"][0].as_py(), top)
        return pa.table({"list": pa.array([group["list"][0].as_py()] * len(points), pa.int32()), "part": pa.array(np.arange(len(points)), pa.int32()), "point": pa.array(list(points))})

    points = cut_lineage(sample.groupBy("list").applyInArrow(fitted, "list int, part int, point array<double>"))
    split = points.select("list").distinct()

    def led(rows: DataFrame, queries: bool) -> DataFrame:
        def lead(group: pa.Table, centre: pa.Table) -> pa.Table:
            x = _matrix(group["vec"].combine_chunks(), dim)
            known = Centroids(_matrix(centre.sort_by("part")["point"].combine_chunks(), dim + 1), [], top)
            row, part = known.parts_for(x) if queries else known.lists_of(x, 1)
            return group.select(["list", "id", "vec"]).take(pa.array(row)).add_column(1, "part", pa.array(part.astype(np.int32)))

        some = rows.join(split, "list", "left_semi")
        chunks = some.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / _ROUTE).cast("int").alias("chunks"))
        dealt = some.join(chunks, "list").select("list", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", "vec")
        centre = points.join(chunks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "part", "point")
        kind = f"list int, part int, id long, vec {dict(rows.dtypes)['vec']}"
        found = dealt.groupBy("list", "chunk").cogroup(centre.groupBy("list", "chunk")).applyInArrow(lead, kind)
        whole = rows.join(split, "list", "left_anti").select("list", F.lit(0).alias("part"), "id", "vec")
        return cut_lineage(whole.unionByName(found))

    return led(postings, False), led(calls, True)


def neighbours(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, id, score): the k found with the largest product, ties to smaller ids.

    asks: which rows are queries, a condition on the column `id`. Every row but the
    query's own is a candidate. Rows that are not usable, without id, or of another
    length than most take no part. Rows of one id count once, with the smallest vector.
    """
    spark = vectors.sparkSession
    members = cut_lineage(_ranked(vectors, id_col, vec_col, k + 1))
    classes = members.where("place = 1").select("d1", "d2", "id", "vec")
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))).alias("top")).first()
    schema = "query_id long, rank int, id long, score double"
    if not stats["n"]:
        return spark.createDataFrame([], schema)
    dim = stats["dim"]
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    index = spark.sparkContext.broadcast(fit(_matrix(sample, dim), -(-stats["n"] // LIST), stats["top"]))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lists = index.value.lists_of(_matrix(b.column(1), dim)) if b.num_rows else (np.zeros(0, int), np.zeros(0, int))
            yield pa.record_batch([pa.array(lists.astype(np.int32)), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], names=["list", "id", "vec"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [index.value.nearest(x) for x in _matrix(b.column(1), dim)] if b.num_rows else []
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            lists = np.array([x for f in found for x in f], np.int32)
            yield pa.record_batch([pa.array(lists), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], names=["list", "id", "vec"])

    kind = f"list int, id long, vec {dict(classes.dtypes)['vec']}"
    postings = cut_lineage(classes.select("id", "vec").mapInArrow(post, kind))
    asked = vectors.where(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(asks).groupBy("id").agg(F.min("vec").alias("vec"))
    queries = cut_lineage(asked.where(F.size("vec") == dim).select("id", "vec", F.xxhash64("vec").alias("d1"), F.xxhash64(F.lit(1), "vec").alias("d2")))
    distinct = queries.groupBy("d1", "d2").agg(F.min(F.struct("id", "vec")).alias("q")).select("q.id", "q.vec")
    calls = cut_lineage(distinct.repartition("id").mapInArrow(ask, kind))
    listed, called = _split(postings, calls, dim, stats["top"])
    key = ["list", "part"]
    chunks = listed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    turns = called.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("turns"))
    # Each chunk of a list meets each turn of its queries; lists without queries drop out.
    blocks = chunks.join(turns, key)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    chunked = listed.join(blocks, key).select(*key, own("chunks").alias("chunk"), every("turns").alias("turn"), "id", "vec")
    spread = called.join(blocks, key).select(*key, every("chunks").alias("chunk"), own("turns").alias("turn"), "id", "vec")

    def score(asking: pa.Table, listed: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asking.num_rows and listed.num_rows:
            ids, x = listed["id"].to_numpy(), _matrix(listed["vec"].combine_chunks(), dim)
            order = np.argsort(ids)
            ids, x = ids[order], x[order]
            q_ids, q = asking["id"].to_numpy(), _matrix(asking["vec"].combine_chunks(), dim)
            m = min(k + 1, len(ids))
            for at in range(0, len(q_ids), 512):
                product = q[at : at + 512] @ x.T
                # Stable, so that of equal products the smaller ids stay.
                best = np.argsort(-product, axis=1, kind="stable")[:, :m]
                out.append((np.repeat(q_ids[at : at + 512], m), ids[best].ravel(), np.take_along_axis(product, best, 1).ravel()))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table(columns, names=["q", "id", "score"])

    scored = spread.groupBy(*key, "chunk", "turn").cogroup(chunked.groupBy(*key, "chunk", "turn")).applyInArrow(score, "q long, id long, score double")
    best = scored.groupBy("q", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    top = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("q", F.col("id").alias("c"), "score")
    # Classes back to their members, then the best k + 1 of those as one short list.
    of_class = members.select("d1", "d2", "id").join(classes.select("d1", "d2", F.col("id").alias("c")), ["d1", "d2"])
    best = top.join(of_class.select("c", "id"), "c").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    answers = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found"))
    firsts = queries.groupBy("d1", "d2").agg(F.min("id").alias("q"))
    return (
        queries.select("d1", "d2", F.col("id").alias("query_id"))
        .join(firsts.join(answers, "q").select("d1", "d2", "found"), ["d1", "d2"])
        .select("query_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k).alias("found"))
        .select("query_id", F.posexplode("found").alias("at", "x"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.id", "x.score")
    )
