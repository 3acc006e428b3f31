"""Line dedup over all documents: exact copies, and lines one word away, after the first go.

Native functions only. A line is its words; lines of `near` words and more are also near
copies if one word is changed, added or left out. Such pairs meet under the hash of what
remains when one word is left out. As few lines have a near copy, a line emits these
variants only if it shares its first or its last half with a different line, which every
pair within the bound does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.session import cut_lineage

MIN_WORDS = 5
NEAR = 8
_SPACE = r"[\x20\x09-\x0D]+"
_KEY = ["h1", "h2"]


def _words(line: Column) -> Column:
    return F.filter(F.split(line, _SPACE), lambda w: w != "")


def _place(id_col: str) -> Column:
    """Order of documents and lines: by id, null last, then by text, then by line."""
    return F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), "th", "line")


def line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int, near: int = NEAR) -> DataFrame:
    """(place, h1, h2, n, halves) of every line with at least min_words words.

    halves: hashes of the halves that a line one word away shares, as the shorter or
    equal and as the longer of the two; none for lines too short to have near copies.
    """
    named = docs.select(F.col(id_col), F.xxhash64(text_col).alias("th"), F.split(text_col, "\n").alias("all"))
    lines = named.select(id_col, "th", F.posexplode("all").alias("line", "t"))
    # As generated rows the words are split once, whatever asks for them.
    worded = lines.select(_place(id_col).alias("place"), F.explode(F.array(_words(F.col("t")))).alias("w")).select(
        "place", "w", F.size("w").alias("n")
    )
    n, w = F.col("n"), F.col("w")

    def half(of: Column, side: str) -> Column:
        head = F.floor(of / 2).cast("int")
        part = F.slice(w, F.lit(1), head) if side == "head" else F.slice(w, n - (of - head) + 1, of - head)
        return F.xxhash64(F.lit(side), of, part)

    halves = F.array(half(n, "head"), half(n, "tail"), half(n - 1, "head"), half(n - 1, "tail"))
    return worded.where(n >= min_words).select(
        "place", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("second"), "w").alias("h2"), "n", F.when(n >= near, halves).alias("halves")
    )


def _candidates(lines: DataFrame) -> DataFrame:
    """h1 of the lines that share a half with a different line."""
    asked = lines.where("halves IS NOT NULL").select("h1", F.explode(F.array_distinct("halves")).alias("half")).repartition("half")
    shared = asked.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("half")
    return asked.join(shared, "half", "left_semi").select("h1").distinct()


def _variants(lines: DataFrame) -> DataFrame:
    """(h1, h2, m, i, rest): the m words of a line without its word i; i = 0: the whole.

    lines(h1, h2, n, w). rest is a hash: words are hashed with their place and combined
    by exclusive or, so that all variants of a line cost one pass over its words.
    """
    word = lines.repartition(*_KEY).select(*_KEY, "n", F.posexplode("w").alias("i", "word")).select(
        *_KEY, "n", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("moved")
    )
    order = Window.partitionBy(*_KEY).orderBy("i")
    running = word.withColumns(
        {
            "before": F.coalesce(F.bit_xor("here").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "upto": F.bit_xor("moved").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "all": F.bit_xor("moved").over(Window.partitionBy(*_KEY)),
        }
    )
    left = F.struct((F.col("n") - 1).alias("m"), (F.col("i") + 1).alias("i"), F.col("before").bitwiseXOR(F.col("upto")).bitwiseXOR(F.col("all")).alias("rest"))
    whole = F.struct(F.col("n").alias("m"), F.lit(0).alias("i"), F.col("before").bitwiseXOR(F.col("here")).alias("rest"))
    last = F.col("i") == F.col("n") - 1
    return running.select(*_KEY, F.explode(F.when(last, F.array(left, whole)).otherwise(F.array(left))).alias("v")).select(*_KEY, "v.*")


def _without(words: str, i: Column) -> Column:
    w = F.col(words)
    return F.when(i == 0, w).otherwise(F.concat(F.slice(w, F.lit(1), i - 1), F.slice(w, i + 1, F.size(w))))


def near_lines(lines: DataFrame) -> DataFrame:
    """Keys of the lines that have an earlier line within one word, verified.

    lines(h1, h2, first, n, w), each line once. Of the lines that agree without word i
    every one is within the bound of the earliest, so a line asks only that one: links
    grow with the lines, not with their pairs.
    """
    # Dealt out once; most variants meet no other line's and go no further.
    variants = _variants(lines).repartition("m", "rest")
    met = variants.groupBy("m", "rest").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("m", "rest")
    hits = cut_lineage(variants.join(met, ["m", "rest"]).join(lines.select(*_KEY, "first"), _KEY))
    left_out = hits.where("i > 0")
    earliest = left_out.groupBy("m", "i", "rest").agg(F.min(F.struct("first", *_KEY)).alias("e"))
    changed = (
        left_out.join(earliest, ["m", "i", "rest"])
        .where(F.col("first") > F.col("e.first"))
        .select(*_KEY, "i", F.col("e.h1").alias("o1"), F.col("e.h2").alias("o2"), F.col("i").alias("oi"))
    )
    whole = hits.where("i = 0").select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("first").alias("s_first"), "m", "rest")
    added = left_out.join(whole, ["m", "rest"])
    longer = added.where(F.col("first") > F.col("s_first")).select(*_KEY, "i", F.col("s1").alias("o1"), F.col("s2").alias("o2"), F.lit(0).alias("oi"))
    shorter = added.where(F.col("first") < F.col("s_first")).select(F.col("s1").alias("h1"), F.col("s2").alias("h2"), F.lit(0).alias("i"), F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("i").alias("oi"))
    links = changed.unionByName(longer).unionByName(shorter)
    # One link is enough for a line; verify that one by its words.
    chosen = links.groupBy(*_KEY).agg(F.min(F.struct("o1", "o2", "i", "oi")).alias("o")).select(*_KEY, "o.*")
    texts = lines.select(*_KEY, "w")
    other = lines.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("w").alias("ow"))
    same = _without("w", F.col("i")) == _without("ow", F.col("oi"))
    return chosen.join(texts, _KEY).join(other, ["o1", "o2"]).where(same).select(*_KEY)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near: int = NEAR) -> DataFrame:
    """docs with text without repeated lines, and n_lines, n_removed and n_near.

    A line goes if the same words stand in an earlier line of any document, or if an
    earlier line is within one word of it (n_near counts those that have no exact copy
    before them; both lines have `near` words or more). Lines of under min_words words stay. Rows equal in id and text are one
    document and keep the same lines. Null text stays null, with no lines; a text that
    loses every line becomes empty. All columns stay; n_lines, n_removed, n_near replace
    columns of those names.
    """
    lines = cut_lineage(line_table(docs, id_col, text_col, min_words, near))
    firsts = cut_lineage(lines.groupBy(*_KEY).agg(F.min("place").alias("first"), F.max("n").alias("n")))
    wanted = firsts.where(F.col("n") >= near).join(_candidates(lines), "h1", "left_semi")
    by_doc = wanted.groupBy("first.id", "first.th").agg(F.collect_list(F.struct("first.line", "first", *_KEY, "n")).alias("wanted"))
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_th"))
    held = (
        named.join(by_doc, F.col("_th").eqNullSafe(F.col("th")) & F.col("_id").eqNullSafe(F.col("id")))
        .select(F.split("_text", "\n").alias("all"), F.explode("wanted").alias("x"))
        .select("x.h1", "x.h2", "x.first", "x.n", _words(F.get("all", F.col("x.line"))).alias("w"))
        .dropDuplicates(_KEY)
    )
    close = cut_lineage(near_lines(cut_lineage(held)).withColumn("near", F.lit(True)))
    told = firsts.select(*_KEY, "first").join(close, _KEY, "left")
    late = F.col("place") > F.col("first")
    gone = (
        lines.select(*_KEY, "place")
        .join(told, _KEY)
        .where(late | F.col("near"))
        .select("place.id", "place.th", "place.line", late.alias("late"))
        .distinct()
        .groupBy("id", "th")
        .agg(F.collect_set("line").alias("gone"), F.sum(F.when(F.col("late"), 0).otherwise(1)).alias("near"))
    )
    made = ("n_lines", "n_removed", "n_near")
    names = [c for c in docs.columns if c not in made]
    rest = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    joined = rest.join(gone, F.col("h").eqNullSafe(F.col("th")) & F.col("i").eqNullSafe(F.col("id")), "left")
    text = F.col("doc").getField(text_col)
    split = F.split(text, "\n")
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined.select(
        *[F.when(F.col("gone").isNull(), text).otherwise(left).alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in names],
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("near", F.lit(0)).alias("n_near"),
    )
