"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges are taken from an agenda, best first; each candidate that comes up is skipped if a
keyed hash of it says so. The key is the seed, the document and the chunk's number in it,
with the candidate's place: every occurrence of a word is cut by its own draws, and a rerun
cuts it the same. A chunk is a run of blanks and what follows it: no piece reaches over its
start. Each different chunk of a batch is cut once without dropout, and occurrences follow
the candidates of that cut with their own draws. Those that skip the same candidate first
share one cut without it, which they follow on from there, until none skips another: equal
decisions are worked out once. Cuts are made side by side: a round takes the best
candidate of every chunk.
With dropout 0 the ids are the library's, but for the character that the model uses for
blanks: it is written as bytes, as no text could be read back otherwise.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm.bpe import slices

_BLANK = "▁"
_CHUNK = re.compile(f"[\n{_BLANK}]| *[^ \n{_BLANK}]+| +")
_BYTES = 2 << 20
# Chunks of more characters would take as many rounds, and are cut one by one.
_LONG = 96
# Occurrences that are drawn, and chunks that are cut, side by side.
_AT_ONCE = 65_536
_SIDE = 16_384
_NONE = np.iinfo(np.int64).max
_MASK = np.uint64(0xFFFFFFFF)


class Pieces:
    """A model of merged pieces whose texts are not normalised."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model = SentencePieceProcessor(model_file=path)
        proto = ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a merge-type model that keeps texts as they are is needed")
        n = model.get_piece_size()
        named = [(i, model.id_to_piece(i)) for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {p: i for i, p in named}
        if any("\n" in p or _BLANK in p.lstrip(_BLANK) for p in self.ids):
            raise ValueError("pieces that reach over a blank or a line break cannot be cut at them")
        score = {s: r for r, s in enumerate(sorted({model.get_score(i) for i, _ in named}, reverse=True))}
        self.rank = {p: score[model.get_score(i)] for i, p in named}
        self.byte = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(model.id_to_piece(i)[3:5], 16)] = i
        self.text = [b""] * n
        for i, p in named:
            self.text[i] = p.replace(_BLANK, " ").encode()
        for b in range(256):
            self.text[self.byte[b]] = bytes([b])
        self.text_array = pa.array(self.text, pa.large_binary())
        # Symbols: the ids of pieces, then characters that only stand inside pieces.
        chars = sorted({c for p in self.ids for c in p} - set(self.ids))
        self.symbols = n + len(chars)
        place = {**self.ids, **{c: n + i for i, c in enumerate(chars)}}
        self.point_symbol = np.full(0x110000, -1, np.int32)
        for p, i in place.items():
            if len(p) == 1:
                self.point_symbol[ord(p)] = i
        pairs = sorted(
            (place[p[:i]] * self.symbols + place[p[i:]], self.ids[p], self.rank[p])
            for p in self.ids for i in range(1, len(p)) if p[:i] in place and p[i:] in place
        )
        self.pair, self.merged, self.pair_rank = (np.array(x, np.int64) for x in zip(*pairs))
        # Places of the pairs, addressed by hash; a slot that is taken sends on to the next.
        self._bits = len(pairs).bit_length() + 1
        self.slots = np.full((1 << self._bits) + len(pairs), -1, np.int32)
        left, slot = np.arange(len(pairs)), self._slot(self.pair)
        while len(left):
            free = np.flatnonzero(self.slots[slot] < 0)
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.slots[slot[put]] = left[put]
            left, slot = np.delete(left, put), np.delete(slot, put) + 1
        self.size = np.ones(self.symbols, np.int64)
        for p, i in place.items():
            self.size[i] = len(p)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _find(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs, and which of them are known."""
        slot = self._slot(pair)
        place = self.slots[slot]
        known = self.pair[place] == pair
        on = np.flatnonzero(~known & (place >= 0))
        while len(on):
            slot[on] += 1
            place[on] = at = self.slots[slot[on]]
            known[on] = same = self.pair[at] == pair[on]
            on = on[~same & (at >= 0)]
        return place, known & (place >= 0)

    def cut(self, chunks: list[str], keys: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of the chunks, in turn, each with its key; see cut_long for skip."""
        coded = pa.array(chunks, pa.large_string()).dictionary_encode()
        different, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        short = np.array([len(c) <= _LONG for c in different], bool)
        place, own = np.cumsum(short) - 1, short[code]
        lengths, at = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        lengths[own], at[own], flat = self._cut_shared([c for c, s in zip(different, short.tolist()) if s], place[code[own]], keys[own], skip)
        long = [self.cut_long(chunks[i], int(keys[i]), skip) for i in np.flatnonzero(~own).tolist()]
        lengths[~own] = [len(x) for x in long]
        at[~own] = len(flat) + np.cumsum(lengths[~own]) - lengths[~own]
        flat = np.concatenate([flat, *long])
        return lengths, flat[np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]

    def _first_skipped(self, keys: np.ndarray, cut: np.ndarray, taken: np.ndarray, steps: np.ndarray, skip: int) -> np.ndarray:
        """Of the candidates of its cut, the first that each occurrence skips; -1 for none."""
        begin, out = np.cumsum(taken) - taken, np.full(len(cut), -1)
        for at in range(0, len(cut), _AT_ONCE):
            part = cut[at : at + _AT_ONCE]
            n = taken[part]
            ends = np.cumsum(n)
            step = np.repeat(begin[part] - (ends - n), n) + np.arange(int(n.sum()))
            hits = np.flatnonzero(self._hash(np.repeat(keys[at : at + _AT_ONCE], n), *steps[:, step]) < skip)
            who = np.searchsorted(ends, hits, "right")
            who, one = np.unique(who, return_index=True)
            out[at + who] = hits[one] - (ends - n)[who]
        return out

    def _cut_shared(self, chunks: list[str], code: np.ndarray, keys: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lengths, places, ids) of the occurrences code of short chunks, each under its key."""
        lengths, places = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        found, total = [np.zeros(0, np.int32)], 0
        open_, cut, of = np.arange(len(code)), code, np.arange(len(chunks))
        drops = np.zeros((len(chunks), 0), np.int64)
        while len(open_):
            parts = [self.cut_short([chunks[c] for c in of[i : i + _SIDE].tolist()], drops[i : i + _SIDE]) for i in range(0, len(of), _SIDE)]
            size, ids, taken, steps = (np.concatenate(x, axis=-1) for x in zip(*parts))
            lengths[open_], places[open_] = size[cut], (total + np.cumsum(size) - size)[cut]
            found.append(ids)
            total += len(ids)
            if not skip:
                break
            at = self._first_skipped(keys[open_], cut, taken, steps, skip)
            hit = at >= 0
            open_, cut = open_[hit], cut[hit]
            # Numbers of candidates go on after the last one skipped.
            number = at[hit] + (drops[cut, -1] + 1 if drops.shape[1] else 0)
            width = int(number.max(initial=0)) + 1
            told, cut = np.unique(cut * width + number, return_inverse=True)
            drops = np.column_stack([drops[told // width], told % width])
            of = of[told // width]
        return lengths, places, np.concatenate(found)

    def cut_long(self, chunk: str, key: int, skip: int) -> np.ndarray:
        """Ids of one chunk of any length, with a heap for its agenda.

        A chunk's agenda is its neighbouring pairs that make a piece; of equal rank the
        first comes first. A candidate is skipped if its 32-bit hash under the key is below
        skip; it comes back only if one of its sides has changed.
        """
        part = list(chunk.replace(" ", _BLANK))
        n, rank = len(part), self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(r, i, i + 1, part[i] + part[i + 1]) for i in range(n - 1) if (r := rank.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if after[i] != j or part[i] + part[j] != piece:
                continue
            if skip and self._hash(*(np.array([x], np.int64) for x in (key, i, j, len(piece))))[0] < skip:
                continue
            part[i] = piece
            k = after[i] = after[j]
            part[j], after[j] = "", -2
            if k >= 0:
                before[k] = i
            for h, left, right in ((before[i], before[i], i), (k, i, k)):
                r = rank.get(part[left] + part[right]) if h >= 0 else None
                if r is not None:
                    heapq.heappush(agenda, (r, left, right, part[left] + part[right]))
        out: list[int] = []
        for p in part:
            out.extend([self.ids[p]] if p in self.ids else self.byte[list(p.encode())].tolist())
        return np.array(out, np.int32)

    def cut_short(self, chunks: list[str], drops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk, in turn: number of ids, ids, number of candidates, candidates.

        drops: a row for each chunk, the numbers of the candidates to skip, rising, counted
        from 0 as they come off its agenda (see cut_long). Told are the candidates after
        the last of these, as rows for _hash.
        """
        lengths = np.array([len(c) for c in chunks], np.int64)
        point = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4").astype(np.int64)
        literal = point == ord(_BLANK)
        point[point == ord(" ")] = ord(_BLANK)
        symbol = np.where(literal, -1, self.point_symbol[point]).astype(np.int64)

        n, first = len(point), np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(chunks)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[first + lengths - 1] = -1
        before[first] = -1
        best, made = np.full(n, _NONE), np.zeros(n, np.int64)

        def look(left: np.ndarray) -> None:
            """Put the pairs that begin at these places on the agenda, or take them off."""
            right = after[left]
            pair = symbol[left] * self.symbols + symbol[right]
            spot, known = self._find(pair)
            good = (right >= 0) & (symbol[left] >= 0) & (symbol[right] >= 0) & known
            best[left] = np.where(good, (self.pair_rank[spot] << 32) | left, _NONE)
            made[left] = self.merged[spot]

        look(np.arange(n))
        skipped = np.zeros(len(chunks), bool)
        told = drops[:, -1] if drops.shape[1] else np.full(len(chunks), -1)
        steps: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros((3, 0), np.int32))]
        number = 0
        alive = np.ones(n, bool)
        active = np.arange(len(chunks))
        begin = first
        pool = best
        places = np.arange(n)
        while len(active):
            top = np.minimum.reduceat(pool, begin)
            open_ = top != _NONE
            i = top[open_] & 0xFFFFFFFF
            if not len(i):
                break
            skipped[:] = False
            skipped[np.flatnonzero(drops == number) // max(drops.shape[1], 1)] = True
            gone = skipped[owner[i]]
            best[i[gone]] = _NONE
            i = i[~gone]
            j = after[i]
            new = told[owner[i]] < number
            at = first[owner[i]]
            steps.append((owner[i][new], np.stack([i - at, j - at, self.size[made[i]]])[:, new].astype(np.int32)))
            number += 1
            k = after[j]
            symbol[i], after[i], alive[j], best[j] = made[i], k, False, _NONE
            before[k[k >= 0]] = i[k >= 0]
            look(i)
            h = before[i]
            look(h[h >= 0])
            # Go on with the chunks that have candidates, and their symbols that are left.
            keep = np.zeros(len(chunks), bool)
            keep[active[open_]] = True
            places = places[alive[places] & keep[owner[places]]]
            active = active[open_]
            pool = best[places]
            begin = np.flatnonzero(np.diff(owner[places], prepend=-1))
        symbol, point, owner, literal = symbol[alive], point[alive], owner[alive], literal[alive]
        whole = (symbol >= 0) & (symbol < len(self.text))
        raw = [b"" if w else chr(c).encode() for w, c in zip(whole.tolist(), point.tolist())] if not whole.all() else []
        width = np.array([len(r) or 1 for r in raw], np.int64) if raw else np.ones(len(symbol), np.int64)
        ids = np.repeat(symbol, width)
        if raw:
            ids[np.repeat(~whole, width)] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        by = np.concatenate([o for o, _ in steps])
        taken = np.concatenate([r for _, r in steps], axis=1)[:, np.argsort(by, kind="stable")]
        sizes = np.bincount(owner, width, minlength=len(chunks)).astype(np.int64)
        return sizes, ids.astype(np.int32), np.bincount(by, minlength=len(chunks)), taken

    @staticmethod
    def _hash(key: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """32 keyed bits of a candidate: its places in the chunk and its length."""
        part = [x.astype(np.uint64) * np.uint64(m) for x, m in ((i, 0x9E3779B1), (j, 0x85EBCA77), (size, 0xC2B2AE3D))]
        x = (key.astype(np.uint64) + part[0] + part[1] + part[2]) & _MASK
        x = ((x ^ (x >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) & _MASK
        x = ((x ^ (x >> np.uint64(12))) * np.uint64(0x297A2D39)) & _MASK
        return (x ^ (x >> np.uint64(15))).astype(np.int64)

    def decode(self, ids: list[int] | pa.Array) -> str:
        ids = ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int32())
        # The joined pieces are what a taken array holds; the first blank was added.
        taken = self.text_array.take(ids)
        return taken.buffers()[2].to_pybytes()[1:].decode("utf-8") if len(taken) else ""


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(path)


def _keys(docs: list[str], count: np.ndarray, seed: int) -> np.ndarray:
    """32 bits for each chunk: a hash of the seed, the document and the chunk's number."""
    start = np.array([xxhash.xxh64_intdigest(f"{seed} {d}") for d in docs], np.uint64)
    number = np.arange(int(count.sum()), dtype=np.uint64) - np.repeat(np.cumsum(count) - count, count).astype(np.uint64)
    x = np.repeat(start, count) + number * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.int64)


def encode_texts(model: Pieces, texts: list[str | None], docs: list[str], dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ids) of whole texts; docs name their documents."""
    chunks: list[str] = []
    ends = [len(chunks)]
    for t in texts:
        chunks += _CHUNK.findall(" " + t) if t else []
        ends.append(len(chunks))
    count = np.diff(np.array(ends, np.int64))
    sizes, ids = model.cut(chunks, _keys(docs, count, seed), int(dropout * (1 << 32)))
    doc = np.repeat(np.arange(len(texts)), count)
    return np.bincount(doc, sizes, minlength=len(texts)).astype(np.int64), ids


def encode(text: Column, doc: Column, model: str, dropout: float = 0.1, seed: int = 0) -> Column:
    """Ids of each whole text, as an array; none for null and empty texts.

    doc names the document, and with the seed decides its draws; documents of one name
    and text are cut alike. A null name is one of its own.
    """

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array, docs: pa.Array) -> pa.Array:
        sizes, ids, at = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], 0
        for part in slices(pc.fill_null(texts.cast(pa.large_string()), ""), _BYTES):
            names = [repr(d) for d in docs.slice(at, len(part)).to_pylist()]
            at += len(part)
            found = encode_texts(pieces(model), part.to_pylist(), names, dropout, seed)
            sizes.append(found[0])
            ids.append(found[1])
        pa.default_memory_pool().release_unused()
        ends = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))

    return ids_of(text, doc.cast("string"))


def decode(ids: Column, model: str) -> Column:
    """The text of an array of ids; of none or null the empty text."""

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        return pa.array([pieces(model).decode(flat.slice(e - n, n)) for n, e in zip(size.tolist(), np.cumsum(size).tolist())], pa.string())

    return text_of(ids)


def encoded(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 0
) -> DataFrame:
    """docs with ids (a column of that name is replaced). Repeated rows stay."""
    # As generated rows the ids are made once, whatever asks for them.
    return docs.withColumn("ids", F.explode(F.array(encode(F.col(text_col), F.col(id_col), model, dropout, seed))))
