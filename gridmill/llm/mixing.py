"""Mixing sources to target weights: fixed-length blocks, drawn shard by shard.

Each source's words, in a fixed pseudorandom order of its documents, are packed into
blocks of BLOCK words. The mix is a list of slots, dealt into shards; a shard draws each
slot's source, so its counts are multinomial. A source's slots, numbered over all shards,
run through its blocks by a pseudorandom permutation of the block numbers, a new one for
each pass. Native functions only; only one row for each source comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.llm.rows import identified
from gridmill.operators.slices import sums_before
from gridmill.session import cut_lineage

BLOCK = 64
SHARD = 16_384
ROUNDS = 16
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
_WORD = r"[^\x20\x09-\x0D]+"
_SLICE_BITS = 16


@dataclass
class Source:
    name: str | None
    size: int
    target: float = 0.0
    blocks: int = 0
    slots: int = 0


def plan_sources(sizes: list[tuple[str | None, int]], block: int = BLOCK) -> list[Source]:
    """Sources by code point, null last, with targets and the slots that come near them.

    Weights 5, 2, 1 repeat; the mix has 150% of all words. A target stops at twice its
    source's size; what is left over is shared again by weight until none is above.
    """
    sources = [Source(n, s) for n, s in sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))]
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))]
    rest, open_ = SHARE * sum(s.size for s in sources), list(range(len(sources)))
    while open_:
        total = sum(weight[i] for i in open_)
        full = [i for i in open_ if rest * weight[i] / total > MOST * sources[i].size]
        for i in full or open_:
            sources[i].target = float(MOST * sources[i].size) if full else rest * weight[i] / total
        rest -= sum(sources[i].target for i in full)
        open_ = [i for i in open_ if i not in full] if full else []
    for s in sources:
        s.blocks = -(-s.size // block)
        if s.size:
            s.slots = min(MOST * s.blocks, round(s.target * s.blocks / s.size))
    return sources


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _at(values: list[int], i: Column) -> Column:
    return F.get(_longs(values), i)


def _range_of(ends: list[int], at: Column) -> Column:
    """Number of the range, by their ascending ends, that `at` lies in."""
    return F.size(F.filter(_longs(ends), lambda e: e <= at)).cast("int")


def _sums(values: list[int]) -> list[int]:
    out = [0]
    for v in values:
        out.append(out[-1] + v)
    return out


def placed(
    docs: DataFrame, key_col: str, id_col: str, text_col: str, source_col: str, seed: int
) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """(key, source, size, mix) of each row, written to the shared folder; the sources' sizes.

    mix orders the source's stream. It follows from id and text, so that it does not
    depend on how the table is split; key only breaks ties of equal rows.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col(key_col).alias("key"),
            F.col(source_col).alias("source"),
            F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), id_col, text_col).alias("mix"),
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    return rows, [(r["source"], r["size"]) for r in sizes]


def numbered(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """rows with s, the source's number, and start, the words of its stream before the row.

    Rows without words have no place in the stream and are left out. The stream is
    ordered by the hash, in slices of its upper bits, so no window holds a whole source.
    """
    # One row for each source, from the driver's own list.
    names = F.broadcast(rows.sparkSession.createDataFrame([(s.name, i) for i, s in enumerate(sources)], "name string, s int"))
    slice_no = F.shiftrightunsigned("mix", 64 - _SLICE_BITS)
    known = rows.where("size > 0").join(names, F.col("source").cast("string").eqNullSafe(F.col("name"))).drop("name").withColumn("part", slice_no)
    totals = known.groupBy("s", "part").agg(F.sum("size").alias("size"))
    before = sums_before(totals, ["s"], "part", ["size"], 1).withColumnRenamed("size", "outer")
    order = Window.partitionBy("s", "part").orderBy("mix", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = known.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0)))
    return inside.join(before, ["s", "part"]).select("key", "source", "size", "s", (F.col("inner") + F.coalesce("outer", F.lit(0))).alias("start"))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Pseudorandom place of x in a permutation of 0..n-1, one for each key.

    Rounds of swap-or-not: in each, x and its mirror at a keyed point are exchanged or
    not, by a keyed bit of the pair; every round is its own inverse, for any n.
    """

    def swapped(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        bit = F.xxhash64(*key, r, F.greatest(at, mirror)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, mirror).otherwise(at)

    # Never null; said so, a join has no null to look for and the rounds run once.
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swapped), F.lit(0).cast("long"))


def slots(spark: SparkSession, sources: list[Source], seed: int) -> DataFrame:
    """(shard, slot, s, turn, block): the mix. Each source has exactly its slots.

    A shard draws the source of each slot. Where all draws together give a source more
    than its slots, its last ones go to the sources that are short, in order; that moves
    about the square root of all.
    """
    want = [s.slots for s in sources]
    total = sum(want)
    ends = _sums(want)[1:]
    drawn = (
        spark.range(-(-total // SHARD))
        .select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(SHARD - 1))).alias("slot"))
        .where(F.col("shard") * SHARD + F.col("slot") < total)
        .select("shard", "slot", _range_of(ends, F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "shard", "slot"), F.lit(max(total, 1)))).alias("s"))
    )
    counts = cut_lineage(drawn.groupBy("s", "shard").agg(F.count(F.lit(1)).alias("n")))
    got = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    have = [got.get(i, 0) for i in range(len(sources))]
    over = _sums([max(0, h - w) for h, w in zip(have, want)])
    short = _sums([max(0, w - h) for h, w in zip(have, want)])
    # Shards may be many: their sums are taken in groups of groups.
    before = sums_before(counts, ["s"], "shard", ["n"], 2)
    rank = F.row_number().over(Window.partitionBy("shard", "s").orderBy("slot")) - 1
    # Spark takes generated rows for few, so joins of them are told to sort, not to broadcast.
    own = drawn.withColumn("rank", rank).hint("merge").join(before, ["s", "shard"]).withColumn("turn", F.col("rank") + F.coalesce("n", F.lit(0)))
    extra = _at(over, F.col("s")) + F.col("turn") - _at(want, F.col("s"))
    told = own.withColumn("extra", F.when(F.col("turn") >= _at(want, F.col("s")), extra)).withColumn("to", _range_of(short[1:], F.col("extra")))
    moved = F.col("extra").isNotNull()
    final = told.select(
        "shard",
        "slot",
        F.when(moved, F.col("to")).otherwise(F.col("s")).alias("s"),
        F.when(moved, _at(have, F.col("to")) + F.col("extra") - _at(short, F.col("to"))).otherwise(F.col("turn")).alias("turn"),
    )
    n = _at([max(1, s.blocks) for s in sources], F.col("s"))
    return final.select("shard", "slot", "s", "turn", permuted(F.pmod("turn", n), n, F.lit(seed), F.col("s"), F.floor(F.col("turn") / n)).alias("block"))


def _pieces(stream: DataFrame, block: int) -> DataFrame:
    """(s, block, key, size, start, skip, n): the words of each block, by document."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    each = stream.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    skip = F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("start"))
    end = F.least("size", (F.col("block") + 1) * block - F.col("start"))
    return each.withColumns({"skip": skip, "n": end - skip})


def taken_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 0
) -> DataFrame:
    """(key, source, size, source_size, target, taken), one row per row of docs.

    size counts words between ASCII white space; null text has none, and a row without
    words is taken 0 times. A null source is a source of its own. Rows that repeat are
    documents of their own. The same table gives the same mix, however it is split.
    """
    rows, sizes = placed(docs, id_col, id_col, text_col, source_col, seed)
    sources = plan_sources(sizes, block)
    stream = cut_lineage(numbered(rows, sources))
    times = slots(docs.sparkSession, sources, seed).groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (
        _pieces(stream, block)
        .join(times.hint("merge"), ["s", "block"], "left")
        .groupBy("key", "source", "size", "s", "start")
        .agg(F.sum(F.col("n") * F.coalesce("times", F.lit(0))).alias("taken"))
        .select("key", "source", "size", "taken")
        .unionByName(rows.where("size = 0").select("key", "source", "size", F.lit(0).cast("long").alias("taken")))
    )
    told = docs.sparkSession.createDataFrame([(s.name, s.size, s.target) for s in sources], "name string, source_size long, target double")
    return taken.join(F.broadcast(told), F.col("source").cast("string").eqNullSafe(F.col("name"))).select("key", "source", "size", "source_size", "target", "taken")


def mixed_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 0
) -> DataFrame:
    """(shard, slot, source, block, ids, words): the mix itself, each slot with its block.

    ids: the documents that the block's words are from, in order.
    """
    rows, row = identified(docs)
    places, sizes = placed(rows, row, id_col, text_col, source_col, seed)
    sources = plan_sources(sizes, block)
    stream = numbered(places, sources).select("key", "s", "source", "start")
    texts = rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.regexp_extract_all(text_col, F.lit(f"({_WORD})")).alias("all"))
    words = stream.hint("merge").join(texts, F.col("key") == F.col("row")).select("s", "source", "start", "id", F.posexplode("all").alias("i", "word"))
    place = F.col("start") + F.col("i")
    entry = F.struct(place.alias("at"), "start", "id", "word")
    packed = (
        words.groupBy("s", "source", F.floor(place / block).alias("block"))
        .agg(F.sort_array(F.collect_list(entry)).alias("all"))
        .select("s", "source", "block", F.array_distinct(F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["id"].alias("id")))).alias("of"), F.col("all.word").alias("words"))
        .select("s", "source", "block", F.col("of.id").alias("ids"), "words")
    )
    return slots(docs.sparkSession, sources, seed).hint("merge").join(packed, ["s", "block"]).select("shard", "slot", "source", "block", "ids", "words")


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 0
) -> DataFrame:
    """The mix as documents: for each pass over its source, the words a document is taken with.

    All columns stay, whatever their names; text keeps its white space where all of it is
    taken, and otherwise that before each word. A document whose words are not taken goes;
    one that is taken twice is there twice.
    """
    rows, row = identified(docs)
    places, sizes = placed(rows, row, id_col, text_col, source_col, seed)
    sources = plan_sources(sizes, block)
    times = slots(docs.sparkSession, sources, seed).groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
    # How often each of a document's blocks is taken, from its first on, without a gap.
    entry = F.struct("block", F.coalesce("times", F.lit(0)).alias("times"))
    counts = (
        _pieces(cut_lineage(numbered(places, sources)), block)
        .join(times.hint("merge"), ["s", "block"], "left")
        .groupBy("key", "start")
        .agg(F.sort_array(F.collect_list(entry)).alias("of"))
        .select("key", F.struct("start", F.col("of")[0]["block"].alias("first"), F.col("of.times").alias("times")).alias("c"))
        .where(F.array_max("c.times") > 0)
    )
    packed = rows.select(F.col(row).alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc").getField(text_col)
    parts = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{_WORD})"))
    held = lambda w, i: F.get("c.times", (F.floor((F.col("c.start") + i) / block) - F.col("c.first")).cast("int")) >= F.col("pass")
    some = F.array_join(F.filter(parts, held), "")
    return (
        packed.join(counts.hint("merge"), F.col("row") == F.col("key"))
        .withColumn("pass", F.explode(F.array(*[F.lit(i + 1) for i in range(MOST)])))
        .withColumn("left", F.when(F.array_min("c.times") >= F.col("pass"), text).otherwise(some))
        .where(F.length("left") > 0)
        .select(*[F.col("left").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])
    )
