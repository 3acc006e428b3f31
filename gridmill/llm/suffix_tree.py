"""LM scoring with a probabilistic suffix tree over words.

Root: every word's smoothed frequency. Contexts: sequences of up to DEPTH words, and their
continuations, that stand LEAST times or more in the training texts, at any size: the
tree grows with the corpus. A context is retained if its continuations differ enough from
those after its suffix: count times divergence, in nats, of at least CUTOFF. A word is
scored by the longest retained suffix of what stands before it, smoothed with the shorter
ones.

Texts are written once, in blocks: words as numbers into the block's own list of words. The
tree is never gathered or broadcast, nor written as a table: sequences are keyed by hashes,
and in each round the blocks ask about theirs. What is asked is dealt out by ranges of
hashes, each range adds up what all blocks tell of a sequence, and the answers go back in
the order of the block's own list, so they need no keys. A sequence is asked about only if
its first and its last words but one are known to stand often enough themselves.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.bpe import slices
from gridmill.session import cut_lineage

DEPTH = 3
LEAST = 2
CUTOFF = 6.0
# Bytes of text in a block: what a task holds of texts, words and places at once.
BLOCK = 6 << 20
# Tokens for each range of hashes: what a task holds of sequences at once.
RANGE = 2 << 20
# Taken off each seen continuation, and the weight of the shorter context's view.
DISCOUNT, MU = 0.75, 2.0
_SQUEEZE, _OPEN = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
# Holds a blank, so no word equals it. It also stands before the first word.
_END = xxhash.xxh64_intdigest(b" end")
_TEXTS = "block long, ids array<long>, sizes binary, held binary, codes binary, words binary, counts binary"
_ASKED = "step string, part long, block long, keys binary, tells array<binary>"
_TOLD = "block long, step string, part long, told array<binary>, types long"
# What is asked in each round: n, counts of sequences of so many words; s, counts and number
# of the continuations of contexts, and whether they differ enough from those after the
# suffix; c, whether contexts that do not are suffixes of ones that do.
_ROUNDS = [
    ["n1"],
    *[[f"n{k}", *([f"s{k - 2}"] if k > 2 else [])] for k in range(2, DEPTH + 2)],
    [f"s{DEPTH}"],
    [f"c{k}" for k in range(DEPTH - 1, 0, -1)],
]
_KINDS = {"n": ["<u8"], "s": ["<u8", "<u8", "<u8", "<f8"], "c": ["?"]}
_ANSWERS = {"n": ["<u8"], "s": ["<u8", "<u8", "?"], "c": ["?"]}


def _held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _pack(x: np.ndarray) -> bytes:
    """Number of values, then their first bytes, second bytes, and so on, each squeezed by
    itself, if that makes them fewer, up to the last that is not zero in all of them.
    """
    width = x.itemsize
    if x.dtype.kind == "u" and width > 1:
        width = -(-int(x.max(initial=0)).bit_length() // 8)
    planes = []
    for i in range(width):
        plane = np.ascontiguousarray(x).view(np.uint8)[i :: x.itemsize].tobytes()
        squeezed = _SQUEEZE(plane)
        planes.append(squeezed if len(squeezed) < len(plane) else plane)
    return struct.pack(f"<{width + 2}I", len(x), width, *map(len, planes)) + b"".join(planes)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    n, width = struct.unpack_from("<2I", x)
    at, out = 4 * (width + 2), np.zeros(n, kind)
    bytes_ = out.view(np.uint8)
    for i, size in enumerate(struct.unpack_from(f"<{width}I", x, 8)):
        plane = x[at : at + size]
        bytes_[i :: out.itemsize] = np.frombuffer(plane if size == n else _OPEN(plane), np.uint8)
        at += size
    return out


def coded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of texts, written to the shared folder.

    words: hash of each different word of the block, the commonest first and those of one
    count by hash, less that of the word before; the end last. counts: how often each
    stands in its training texts.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts, at = batch.column(0), pc.fill_null(batch.column(1).cast(pa.large_string()), ""), 0
            for part in slices(texts, BLOCK):
                own = ids.slice(at, len(part)).to_pylist()
                at += len(part)
                lists = pc.ascii_split_whitespace(pc.ascii_lower(part))
                flat = lists.flatten()
                word = pc.not_equal(flat, "")
                doc = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))[word.to_numpy(zero_copy_only=False)]
                terms = flat.filter(word).dictionary_encode()
                n = len(terms.dictionary)
                spelt = terms.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
                order, hashes = _sorted(np.fromiter(map(xxhash.xxh64_intdigest, spelt), np.uint64, n))
                common = np.argsort(-np.bincount(terms.indices.to_numpy(), minlength=n)[order], kind="stable")
                hashes, rank = np.append(hashes[common], np.uint64(_END)), np.empty(n, np.uint32)
                rank[order[common]] = np.arange(n, dtype=np.uint32)
                size = np.bincount(doc, minlength=len(part)) + 1
                ends = np.cumsum(size) - 1
                codes = np.full(int(size.sum()), n, np.uint32)
                inner = np.ones(len(codes), bool)
                inner[ends] = False
                codes[inner] = rank[terms.indices.to_numpy()]
                held = np.array([_held_out(i) for i in own], bool)
                counts = np.bincount(codes[~np.repeat(held, size)], minlength=n + 1).astype(np.uint32)
                row = [block, own, _pack(size.astype(np.uint32)), _pack(held), _pack(codes), _pack(np.diff(hashes, prepend=np.uint64(0))), _pack(counts)]
                kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
                yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds)], names=["block", "ids", "sizes", "held", "codes", "words", "counts"])
                block += 1

    return cut_lineage(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(code, _TEXTS))


def _each(blocks: DataFrame, columns: list[str], schema: str, fn: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """Rows that fn makes of the columns of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in fn(*(row[c] for c in columns)).items()})

    return blocks.select(*columns).mapInArrow(run, schema)


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and the keys in it.

    Their first bits and their places in one number sort several times faster than an
    argsort, and mostly tell all keys apart.
    """
    bits = np.uint64(len(keys).bit_length())
    both = keys >> bits
    both <<= bits
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    both &= (np.uint64(1) << bits) - np.uint64(1)
    order = both.view(np.int64)
    found = keys[order]
    if (found[1:] < found[:-1]).any():
        order = np.argsort(keys)
        found = keys[order]
    return order, found


def _left(total: np.ndarray, seen: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Weight of the shorter context's view."""
    return (total - seen.astype(float) + DISCOUNT * kinds + MU) / (total + MU)


def _own(n: np.ndarray, total: np.ndarray, left: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of continuations, by those after the shorter context."""
    return (n - DISCOUNT) / (total + MU) + left * shorter


class _Level:
    """What a block knows of its different sequences of k words, in the order of their hashes;
    once it is told their counts, only of those that stand often enough, but of all words.

    ends: tokens where one of them ends, None: all; place: its place in this list, for each of these.
    context, suffix: places in the list of the next shorter sequences. own: how often each
    stands in the block's training texts, until it is told how often in all.
    """

    n = lead = often = left = kinds = kept = p = own = context = suffix = None

    def __init__(self, keys: np.ndarray, ends: np.ndarray | None, place: np.ndarray):
        self.keys, self.ends, self.place = keys, ends, place

    def learn(self, k: int, told: dict[str, list[np.ndarray]], least: int) -> None:
        n = told[f"n{k}"][0]
        self.often = n >= np.uint64(2 * least)
        if k > 1:
            some = np.flatnonzero(self.often)
            to = np.full(len(n), -1, np.int32)
            to[some] = np.arange(len(some), dtype=np.int32)
            place = to[self.place]
            held = np.flatnonzero(place >= 0)
            self.ends, self.place = self.ends[held], place[held]
            self.keys, self.often, self.context, self.suffix, n = (x[some] for x in (self.keys, self.often, self.context, self.suffix, n))
        self.n, self.lead = (n >> np.uint64(1)).view(np.int64), (n & np.uint64(1)) > 0
        if f"s{k}" in told:
            seen, kinds, kept = told[f"s{k}"]
            self.kinds, self.left, self.kept = np.zeros(len(self.keys), np.int32), np.ones(len(self.keys)), np.zeros(len(self.keys), bool)
            self.kinds[self.often], self.kept[self.often] = kinds, kept
            self.left[self.often] = _left(self.n[self.often], seen, kinds)
        if f"c{k}" in told:
            self.kept[(self.kinds > 0) & ~self.kept] = told[f"c{k}"][0]

    def at(self, tokens: int) -> np.ndarray:
        """For each token, the place of the sequence that ends there, or -1."""
        out = np.full(tokens, -1, np.int32)
        out[self.ends] = self.place
        return out


def _levels(row: dict, told: dict[str, list[np.ndarray]], least: int, scale: int, most: int = DEPTH + 1, rated: bool = True) -> list[_Level]:
    """Levels 1, 2, ... of a block up to most, as far as counts of the shorter sequences are
    told; rated: with probabilities.

    Token 0 is an end put before the block, so that one stands before every text.
    """
    words, codes = np.cumsum(_unpack(row["words"], "<u8"), dtype=np.uint64), _unpack(row["codes"], "<u4")
    order, own = _sorted(words)
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words), dtype=np.int32)
    root = _Level(own, None, np.append(rank[-1], rank[codes]))
    if "n1" not in told:
        root.own = _unpack(row["counts"], "<u4")[order].astype(np.int64)
    levels = [root]
    for k in range(1, most + 1):
        here = levels[-1]
        if f"n{k}" not in told:
            break
        here.learn(k, told, least)
        if k == 1:
            here.p = (here.n + 1) / scale
        elif rated and levels[-2].left is not None:
            lower, c = levels[-2], here.context
            here.p = _own(here.n, lower.n[c], lower.left[c], lower.p[here.suffix])
        if k == most:
            break
        ends, place = here.ends, here.place
        if k == 1:
            ends = np.flatnonzero(here.often[place])
            place = place[ends]
            last = own[place]
        else:
            last = own[root.place[ends]]
        # Where the token before ends one too. Of longer sequences than two none ends at a text's first word.
        both = ends[1:] - ends[:-1] == 1
        if k == 2:
            both &= root.place[ends[1:] - 1] != rank[-1]
        at = np.flatnonzero(both)
        x = ((here.keys ^ (here.keys >> np.uint64(32))) * _MIX[0])[place[at]]
        at += 1
        x += last[at]
        ends, shorter = ends[at], place
        x ^= x >> np.uint64(29)
        x *= _MIX[1]
        x ^= x >> np.uint64(32)
        order, keys = _sorted(x)
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        place = np.empty(len(keys), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        level = _Level(keys[new], ends, place)
        if f"n{k + 1}" in told:
            one = at[order[new]]
            level.context, level.suffix = shorter[one - 1], shorter[one]
        else:
            train = np.append(False, ~np.repeat(_unpack(row["held"], "?"), _unpack(row["sizes"], "<u4")))
            level.own = np.bincount(place[train[ends]], minlength=len(level.keys))
        levels.append(level)
    return levels


def _under(levels: list[_Level], k: int) -> np.ndarray:
    """Whether contexts of k words are suffixes of ones that the block knows to be retained."""
    longer = levels[k]
    out = np.zeros(len(levels[k - 1].keys), bool)
    out[longer.suffix[longer.kept if k + 1 == DEPTH else longer.kept | _under(levels, k + 1)]] = True
    return out


def _tells(step: str, levels: list[_Level]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sequences that a block asks about, by place, and what it tells of them."""
    k = int(step[1:])
    here = levels[k - 1]
    if step[0] == "n":
        return np.arange(len(here.keys)), [here.own.astype(np.uint64)]
    if step[0] == "c":
        asked = np.flatnonzero((here.kinds > 0) & ~here.kept)
        return asked, [_under(levels, k)[asked]]
    # Each continuation is told of by the first block that has it, with its probability after the suffix.
    longer = levels[k]
    lead = np.flatnonzero(longer.lead & longer.often)
    lead = lead[np.argsort(longer.context[lead], kind="stable")]
    kinds = np.bincount(longer.context[lead], minlength=len(here.keys))
    asked, some = np.flatnonzero(here.often), np.flatnonzero(kinds)
    return asked, [*(x.astype(np.uint64) for x in (kinds[asked], here.n[some], longer.n[lead])), here.p[longer.suffix[lead]]]


def _differs(total: np.ndarray, each: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether contexts are retained for themselves, by sums over their continuations."""
    rest, rest_other = 1 - own, 1 - other
    more = (rest > 0) & (rest_other > 0)
    each = each.astype(float)
    each[more] += rest[more] * np.log(rest[more] / rest_other[more])
    return total * each >= CUTOFF


def _answer(texts: pa.Table) -> pa.Table:
    """What is known of one range of hashes, for each block that asks."""
    rows = sorted(texts.to_pylist(), key=lambda r: r["block"])
    step = rows[0]["step"]
    lists = [np.cumsum(_unpack(r["keys"], "<u8"), dtype=np.uint64) for r in rows]
    tells = [np.concatenate(x) for x in zip(*[[_unpack(t, k) for t, k in zip(r["tells"], _KINDS[step[0]])] for r in rows])]
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    keys = np.concatenate(lists)
    # Stable: what the blocks tell is added up in their order, at every run.
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = np.diff(keys[order]) != 0
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    types = 0
    if step[0] == "n":
        n = np.add.reduceat(tells[0][order], starts)
        types = int((n > 0).sum())
        lead = np.zeros(len(keys), np.uint64)
        lead[order[starts]] = 1
        out = [n[place] << np.uint64(1) | lead]
    elif step[0] == "s":
        each, total, n, other = tells
        context, has = np.repeat(place, each.view(np.int64)), place[each > 0]
        sums = lambda x=None: np.bincount(context, x, len(starts))
        totals = np.zeros(len(starts))
        totals[has] = total
        seen, kinds = sums(n), sums()
        own = _own(n, totals[context], _left(totals, seen, kinds)[context], other)
        kept = _differs(totals, sums(own * np.log(own / other)), sums(own), sums(other))
        out = [x[place] for x in (seen.astype(np.uint64), kinds.astype(np.uint64), kept)]
    else:
        out = [np.logical_or.reduceat(tells[0][order], starts)[place]]
    parts = zip(*[np.split(x, cuts) for x in out])
    return pa.Table.from_pylist(
        [{"block": r["block"], "step": step, "part": r["part"], "told": [_pack(x) for x in p], "types": types if i == 0 else 0} for i, (r, p) in enumerate(zip(rows, parts))],
        pa.schema([("block", pa.int64()), ("step", pa.string()), ("part", pa.int64()), ("told", pa.list_(pa.binary())), ("types", pa.int64())]),
    )


def _told(answers: pa.Table, steps: list[str]) -> dict[str, list[np.ndarray]]:
    """The answers to a block, by step; one that asked nothing in a step has empty ones."""
    out = {step: [[np.empty(0, k) for k in _ANSWERS[step[0]]]] for step in steps}
    for row in sorted(answers.to_pylist(), key=lambda r: r["part"]):
        out[row["step"]].append([_unpack(x, k) for x, k in zip(row["told"], _ANSWERS[row["step"][0]])])
    return {step: [np.concatenate(x) for x in zip(*parts)] for step, parts in out.items()}


def _ask(blocks: DataFrame, told: DataFrame, done: list[str], steps: list[str], parts: int, least: int, scale: int) -> DataFrame:
    """One round: answers to the steps after those done, written to the shared folder."""
    most = max(int(step[1:]) + (step[0] != "n") for step in steps)
    needed = [x for x in done if int(x[1:]) <= most]
    edges = np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)
    schema = pa.schema([("step", pa.string()), ("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("tells", pa.list_(pa.binary()))])

    def ask(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known, out = _told(answers, needed), []
        for row in texts.to_pylist():
            levels = _levels(row, known, least, scale, most, steps[-1][0] == "s")
            for step in steps:
                asked, tells = _tells(step, levels)
                keys = levels[int(step[1:]) - 1].keys[asked]
                cuts = np.searchsorted(keys, edges)
                of = [cuts] * len(tells)
                if step[0] == "s":
                    before = lambda x: np.append(0, np.cumsum(x, dtype=np.int64))[cuts]  # noqa: E731, B023
                    of[1:] = before(tells[0] > 0), before(tells[0]), before(tells[0])
                split = [np.split(x, c) for x, c in zip(tells, of)]
                for part, own in enumerate(np.split(keys, cuts)):
                    if len(own):
                        out.append({"step": step, "part": part, "block": row["block"], "keys": _pack(np.diff(own, prepend=np.uint64(0))), "tells": [_pack(x[part]) for x in split]})
        return pa.Table.from_pylist(out, schema)

    rows = blocks.groupBy("block").cogroup(told.where(F.col("step").isin(needed)).groupBy("block")).applyInArrow(ask, _ASKED)
    return cut_lineage(rows.groupBy("step", "part").applyInArrow(_answer, _TOLD))


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Each round is written before the next; what it shuffled goes when it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, held)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.0) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row.

    Learns from rows whose crc32 of the id as text leaves another remainder than 2 by 7;
    a null id counts as empty text. Words lie between ASCII white space, A-Z in lower
    case; each text ends with one more token, so a null or empty text has one. score is
    the log10 probability of the text. Repeated rows are texts of their own. share: least
    share of the training tokens that a sequence must hold besides standing LEAST times.
    """
    spark = docs.sparkSession
    with _tidy(spark):
        blocks = coded(docs, id_col, text_col)

        def totals(counts: bytes, sizes: bytes) -> dict[str, np.ndarray]:
            own = [_unpack(x, "<u4").sum(dtype=np.int64, keepdims=True) for x in (counts, sizes)]
            return {"tokens": own[0], "every": own[1]}

        own = _each(blocks, ["counts", "sizes"], "tokens long, every long", totals).agg(F.sum("tokens").alias("tokens"), F.sum("every").alias("every")).first()
        tokens, parts = own["tokens"] or 0, max(1, -(-(own["every"] or 0) // RANGE))
        least = max(LEAST, math.ceil(share * tokens))
        answers, done, scale = [spark.createDataFrame([], _TOLD)], [], 0
        for steps in _ROUNDS:
            answers.append(_ask(blocks, reduce(DataFrame.unionByName, answers), done, steps, parts, least, scale))
            done = done + steps
            if steps == ["n1"]:
                scale = tokens + (answers[-1].agg(F.sum("types")).first()[0] or 0) + 1

    def scored(texts: pa.Table, told: pa.Table) -> pa.Table:
        known, out = _told(told, done), []
        for row in texts.to_pylist():
            size = _unpack(row["sizes"], "<u4").astype(np.int64)
            levels = _levels(row, known, least, scale)
            root, first = levels[0], np.cumsum(size) - size
            each = root.place[1:]
            p = root.p[each]
            under, before = np.arange(len(each)), root.place
            for k, (shorter, level) in enumerate(zip(levels, levels[1:])):
                # A longer retained context ends where its suffix does; a text's first word stands after the end only.
                context = before[under]
                kept = np.append(shorter.kept, False)[context]
                if k:
                    kept &= root.place[under] != root.place[0]
                under, context = under[kept], context[kept]
                p[under] *= shorter.left[context]
                before = level.at(len(each) + 1)
                here = before[under + 1]
                listed = here >= 0
                p[under[listed]] = level.p[here[listed]]
            sums = lambda x: np.add.reduceat(x, first)
            out.append(
                pa.table(
                    {
                        "id": pa.array(row["ids"], pa.int64()), "held_out": _unpack(row["held"], "?"), "n_tokens": size, "n_known": sums((root.n > 0).astype(np.int64)[each]),
                        "train_tokens": np.full(len(size), tokens), "base_score": sums(np.log10(root.n + 1.0)[each]) - size * math.log10(scale), "score": sums(np.log10(p)),
                    }
                )
            )
        return pa.concat_tables(out)

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(reduce(DataFrame.unionByName, answers).groupBy("block")).applyInArrow(scored, schema)
