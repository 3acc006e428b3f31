"""URL filter: a blocked Bloom filter in front of an exact join with a list.

The list holds canonical hosts and paths with a verdict. An entry fits a page on its host
or a subdomain whose path starts with the entry's path. So a page asks for each of its
host's suffixes with each start of its path, of the lengths that the list has. Most
questions end at the filter; what passes is joined with the list itself, which removes
false positives, and of the entries that fit the longest wins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm.rows import free_name

# A block is 256 bits, four longs: one probe touches one cache line.
_PROBES = 8
_MAX_BLOCKS = 1 << 21
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _hashes(host: Column, path: Column) -> tuple[Column, Column]:
    return F.xxhash64(host, path), F.xxhash64(path, host, F.lit("bits"))


class BlockedBloom:
    """Filter over the entries of a list; at most 64 MB however long the list is.

    A longer list only lets more through to the join.
    """

    def __init__(self, listed: DataFrame) -> None:
        n = listed.count()
        self.blocks = min(_MAX_BLOCKS, 1 << max(0, (n * 16 // 256).bit_length()))
        where, bits = _hashes(F.col("host"), F.col("path"))
        byte = [F.shiftrightunsigned(F.col("bits"), 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(_PROBES)]
        word = lambda w: reduce(
            Column.bitwiseOR,
            [F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")) for b in byte],
        )
        rows = (
            listed.select(F.pmod(where, F.lit(self.blocks)).cast("int").alias("block"), bits.alias("bits"))
            .groupBy("block")
            .agg(*[F.bit_or(word(w)).alias(f"w{w}") for w in range(4)])
            .toPandas()
        )
        table = np.zeros((self.blocks, 4), np.int64)
        table[rows["block"].to_numpy(np.int64)] = rows[[f"w{w}" for w in range(4)]].to_numpy(np.int64)
        self._table = listed.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def may_hold(self, host: Column, path: Column) -> Column:
        shared, n = self._table, self.blocks

        @F.arrow_udf("boolean")
        def probe(where: pa.Array, bits: pa.Array) -> pa.Array:
            table, block = shared.value, where.to_numpy() % n
            own, found = bits.to_numpy().view(np.uint64), np.ones(len(block), bool)
            for i in range(_PROBES):
                byte = (own >> np.uint64(8 * i)) & np.uint64(255)
                found &= (table[block, (byte >> np.uint64(6)).astype(np.int64)] >> (byte & np.uint64(63))) & np.uint64(1) == 1
            return pa.array(found)

        return probe(*_hashes(host, path))


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names are replaced).

    listed(host, path, verdict): canonical, host in lower case; of entries that name the
    same host and path the smallest verdict holds. Longest: by characters of host and
    path together, then of the host. A page that no entry fits has a null rule and the
    default verdict; so has a null url or one without ://, whose host and path are empty,
    unless an entry with empty host and path fits. Repeated pages stay.
    """
    entries = listed.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    bloom = BlockedBloom(entries)
    lengths = sorted(r[0] for r in entries.select(F.length("path")).distinct().collect())
    # Suffixes of as many labels as an entry has; a long host has no more of them than a short one.
    counts = sorted(r[0] for r in entries.select(F.size(F.split("host", "[.]"))).distinct().collect())
    told = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    labels = F.size(F.split("host", "[.]"))
    suffixes = F.array_compact(F.array(*[F.when(labels >= n, F.substring_index("host", ".", -n)) for n in counts or [1]]))
    starts = F.array(*[F.struct(F.lit(n).alias("n"), F.left("path", F.lit(n)).alias("of")) for n in lengths or [0]])
    asked = (
        told.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(suffixes).alias("r_host"))
        .select("host", "path", "r_host", F.explode(starts).alias("start"))
        .where(F.length("path") >= F.col("start.n"))
        .select("host", "path", "r_host", F.col("start.of").alias("r_path"))
        .where(bloom.may_hold(F.col("r_host"), F.col("r_path")))
    )
    exact = entries.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict")
    rule = F.concat("r_host", "r_path")
    best = (
        asked.join(exact, ["r_host", "r_path"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length(rule).alias("n"), F.length("r_host").alias("h"), rule.alias("rule"), "verdict")).alias("best"))
    )
    own = free_name("best", told)
    return (
        told.drop("rule", "verdict")
        .join(best.withColumnRenamed("best", own), ["host", "path"], "left")
        .withColumns({"rule": F.col(f"{own}.rule"), "verdict": F.coalesce(f"{own}.verdict", F.lit(default))})
        .drop(own)
    )
