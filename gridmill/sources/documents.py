"""Fixed-width order documents split by ship-to.

A document is read as one row (the record separator is the line that starts the
next one), so plain files of any size split over tasks and no shuffle is needed. Written
documents are compressed, in files short enough for one task each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Segment names and field places (0-based starts) of the layout.
HEADER = "EDI_DC"
ITEM = r"E2EDP01\d\d\d"
ALLOCATION = "Z2EDP01SDQ"
SUMMARY = "E2EDS01"
PARTY_MARK = "WE"
PARTY_CUT = 65
PARTY_PAD = 83
QTY_START, QTY_LEN = 211, 10
SHIP_START, SHIP_LEN = 221, 17
SLOT_START, SLOT_END, SLOT_LEN = 74, 89, 15

# Documents in one written file: compressed, a file is read by one task.
FILE_DOCUMENTS = 40_000

_ITEM_MARK, _BLOCK_MARK = "\u0001", "\u0002"


def write_documents(docs: DataFrame, path: str, col: str = "text") -> None:
    """Write each text as a document, in compressed files of bounded length.

    The layout is mostly padding: written plain, documents take many times their content.
    """
    files = docs.select(col).write.option("compression", "lz4").option("maxRecordsPerFile", FILE_DOCUMENTS)
    files.text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: `text`, lines parted by newlines, and its `file`."""
    raw = spark.read.option("lineSep", "\n" + HEADER).text(path)
    value = F.col("value")
    whole = F.when(value.startswith(HEADER), value).otherwise(F.concat(F.lit(HEADER), value))
    return raw.where(F.length(F.trim(value)) > 0).select(
        F.regexp_replace(whole, r"\n+$", "").alias("text"),
        F.col("_metadata.file_path").alias("file"),
    )


def split_documents(docs: DataFrame, col: str = "text") -> DataFrame:
    """One output document per ship-to; documents with no allocation pass unchanged.

    Adds `ship_to` (NULL when passed through) and `ship_to_no` (1, 2, .. in numeric
    order) and replaces the text column; all other columns are kept. Everything
    happens within the row: one pass, no shuffle.
    """
    others = [c for c in docs.columns if c != col]
    text = F.col(col)
    # Items and blocks are marked first, so that the parts need no pattern search.
    marked = F.regexp_replace(text, rf"\n(?={ITEM})", _ITEM_MARK)
    for start in (ALLOCATION, SUMMARY):
        marked = F.replace(marked, F.lit("\n" + start), F.lit(_BLOCK_MARK + start))
    has_alloc = F.concat(F.lit("\n"), text).contains("\n" + ALLOCATION)
    # Part 0 holds the header, every further part one item with its allocations.
    parts = F.transform(F.split(marked, _ITEM_MARK), lambda p: F.split(p, _BLOCK_MARK))
    parsed = docs.withColumn("_parts", F.when(has_alloc, parts))
    raw_items = F.transform(F.slice(F.col("_parts"), F.lit(2), F.size("_parts")), _item)
    items = F.transform(raw_items, _slotted)
    summary = F.flatten(
        F.transform("_parts", lambda b: F.filter(b, lambda x: x.startswith(SUMMARY)))
    )
    shaped = parsed.select(
        *others,
        text.alias("_text"),
        F.split(F.get(F.get("_parts", F.lit(0)), F.lit(0)), "\n").alias("_header"),
        # As a generated row, so that it is built once, whatever asks for it.
        F.explode(F.array(_allocated(items))).alias("_alloc"),
        summary.alias("_summary"),
    )
    # Sorted by ship-to and item: each ship-to is one stretch, so every allocation is
    # looked at once, however many items and ship-tos a document has.
    size = F.size("_alloc")
    new = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda k: (k == 0) | (F.get("_alloc", k - 1)["ship"] != F.get("_alloc", k)["ship"]),
    )
    cut = shaped.select(
        *others, "_text", "_header", "_alloc", "_summary",
        F.explode(F.array(F.when(size > 0, new))).alias("_new"),
    )
    stretch = F.transform(
        "_new",
        lambda k, g: F.slice("_alloc", k + 1, F.coalesce(F.get("_new", g + 1), size) - k),
    )
    per_ship = cut.select(
        *others, "_text", "_header", "_summary",
        F.posexplode(F.coalesce(stretch, F.array(F.lit(None)))).alias("_i", "_own"),
    )
    ship = F.get("_own", F.lit(0))["ship"]
    header = F.transform("_header", lambda line: _header_line(line, ship))
    # Of several allocations of an item to a ship-to the last counts.
    last = F.filter(
        "_own", lambda e, k: F.coalesce(F.get("_own", k + 1)["item"] != e["item"], F.lit(True))
    )
    lines = F.concat(header, F.transform(last, lambda e: e["text"]), F.col("_summary"))
    return per_ship.select(
        *others,
        ship.alias("ship_to"),
        (F.col("_i") + 1).alias("ship_to_no"),
        F.when(F.col("_own").isNull(), F.col("_text")).otherwise(F.array_join(lines, "\n")).alias(col),
    )


def _allocated(items: Column) -> Column:
    """Allocations of all items as (n, ship, item, no, text), sorted; text: the item's, filled in."""
    each = F.transform(
        items,
        lambda it, i: F.transform(
            it["alloc"],
            lambda a, j: F.struct(
                _number(a["ship"]).alias("n"),
                a["ship"].alias("ship"),
                i.alias("item"),
                j.alias("no"),
                F.concat(
                    it["head"],
                    F.rpad(F.regexp_replace(a["qty"], r"\s.*\s", ""), SLOT_LEN, " "),
                    it["tail"],
                ).alias("text"),
            ),
        ),
    )
    return F.sort_array(F.flatten(each))


def malformed_allocations(docs: DataFrame, col: str = "text") -> DataFrame:
    """Allocation lines too short to name a ship-to; the split files them under ''."""
    lines = docs.select(F.explode(F.split(F.col(col), "\n")).alias("line"))
    return lines.where(F.col("line").startswith(ALLOCATION) & (F.length("line") <= SHIP_START))


def _item(blocks: Column) -> Column:
    """First line, rest, and allocation lines of an item."""
    own = F.filter(blocks, lambda b: b.startswith(ALLOCATION))
    return F.struct(
        F.split(F.get(blocks, F.lit(0)), "\n", 2).alias("text"),
        F.flatten(F.transform(own, lambda b: F.split(b, "\n"))).alias("lines"),
    )


def _slotted(item: Column) -> Column:
    """The item's text around its quantity slot, and its allocations in order."""
    first = F.get(item["text"], F.lit(0))
    rest = F.get(item["text"], F.lit(1))
    return F.struct(
        F.substring(first, 1, SLOT_START).alias("head"),
        F.concat_ws("\n", F.substring(first, F.lit(SLOT_END + 1), F.length(first)), rest).alias(
            "tail"
        ),
        F.transform(
            item["lines"],
            lambda line: F.struct(
                F.substring(line, SHIP_START + 1, SHIP_LEN).alias("ship"),
                F.substring(line, QTY_START + 1, QTY_LEN).alias("qty"),
            ),
        ).alias("alloc"),
    )


def _number(ship: Column) -> Column:
    return F.coalesce(F.trim(ship).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def _header_line(line: Column, ship: Column) -> Column:
    cut = F.substring(line, 1, PARTY_CUT)
    return F.when(
        line.contains(PARTY_MARK), F.concat(F.rpad(cut, PARTY_PAD, " "), ship)
    ).otherwise(line)
