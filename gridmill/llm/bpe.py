"""Token ids of many texts at once, with each different chunk of text encoded once.

For a byte-level tokenizer without normalizer, no token and no special string crosses the
place before a single blank, or either side of a single line break, between other
characters. So a text is cut there and its ids are those of its chunks in turn. The
library encodes each different chunk of a batch; the rest is gathering. Texts with
white space in other forms, and other kinds of tokenizers, are encoded whole. A worker
remembers the ids of the short chunks it met last, a bounded table of them, so a common
word is encoded once and not with every batch.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MARK = "\x01"
# A blank or break beside another white space character must not be cut at, nor a blank at
# an end. The class holds all that the tokenizers' patterns count as white space.
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
_UNSAFE = rf"^ | $|[ \n]{_SPACE}|{_SPACE}[ \n]|{_MARK}"
_BATCH = 20_000
# Chunks that a worker remembers, and the longest of them in bytes: 50 MB at most.
_KEEP = 400_000
_SHORT = 48
# One token pattern by itself: letters with at most a blank before them.
_TAILS = ",.!?;:#$%&*"
_WORD = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"


class Encoder:
    """Ids of texts, as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        # A special string that strips, or holds a blank, could reach over a cut.
        plain = all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
        self._cuts = plain and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        # Marks that come off a word: no special string holds them, and none begins a contraction.
        self._tails = "".join(c for c in _TAILS if not any(c in t["content"] for t in spec["added_tokens"]))
        # A special string stands between chunks that are encoded in one go.
        self._mark = next(((t["content"], t["id"]) for t in spec["added_tokens"] if t["special"]), None)

        # Different chunks, how many ids each has, the ids in turn, and when each was met last.
        self._known = pa.array([], pa.large_string())
        self._size, self._flat, self._met = np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self._now = 0

        # For chunks that are one word the pattern that looks for words is left out.
        self._bare = Tokenizer.from_file(path)
        self._bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)

    def _encode(self, texts: list[str], bare: bool = False) -> list[np.ndarray]:
        tokenizer = self._bare if bare else self._tokenizer
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str], bare: bool) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of the chunks in turn."""
        if self._mark is None or any(self._mark[0] in c for c in chunks):
            parts = self._encode(chunks, bare)
            return np.array([len(p) for p in parts], np.int64), np.concatenate([*parts, np.zeros(0, "<u4")])
        text, mark = self._mark
        groups = self._encode([text.join(chunks[i : i + _BATCH]) + text for i in range(0, len(chunks), _BATCH)], bare)
        ids = np.concatenate([*groups, np.zeros(0, "<u4")])
        return np.diff(np.flatnonzero(ids == mark), prepend=-1) - 1, ids[ids != mark]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As _joined; marks behind a word are taken off first, as they are tokens of their own."""
        stem = pc.utf8_rtrim(chunks, characters=self._tails) if self._tails else chunks
        word = pc.match_substring_regex(stem, _WORD)
        stem = pc.if_else(word, stem, chunks)
        cut = pc.not_equal(stem, chunks)
        coded = stem.dictionary_encode()
        place = self._places(coded.dictionary)
        lengths, ids = _gather(self._size, self._flat, place[coded.indices.to_numpy()])
        self._forget()
        own = cut.to_numpy(zero_copy_only=False)
        if own.any():
            # Marks are one byte each, and a word ends in a letter.
            tails = pc.replace_substring_regex(chunks.filter(cut), "^ ?[^ -@]*[A-Za-zÀ-ÖØ-öø-ÿ]", "").dictionary_encode()
            made = self._encode(tails.dictionary.to_pylist())
            n, flat = _gather(np.array([len(m) for m in made], np.int64), np.concatenate(made), tails.indices.to_numpy())
            ids = np.insert(ids, np.repeat(np.cumsum(lengths)[own], n), flat)
            lengths = lengths.copy()
            lengths[own] += n
        return lengths, ids

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Where different chunks stand among the known ones; new ones are encoded and added."""
        found = pc.index_in(chunks, value_set=self._known)
        new = chunks.filter(found.is_null())
        words = pc.match_substring_regex(new, _WORD)
        added = [(new.filter(words), True), (new.filter(pc.invert(words)), False)]
        encoded = [self._joined(part.to_pylist(), bare) for part, bare in added]
        first = len(self._known)
        kind = words.to_numpy(zero_copy_only=False)
        places = np.empty(len(new), np.int64)
        places[np.concatenate([np.flatnonzero(kind), np.flatnonzero(~kind)])] = first + np.arange(len(new))
        self._known = pa.concat_arrays([self._known, *(part for part, _ in added)])
        self._size = np.concatenate([self._size, *(n for n, _ in encoded)])
        self._flat = np.concatenate([self._flat, *(ids for _, ids in encoded)])
        out = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        out[found.is_null().to_numpy(zero_copy_only=False)] = places
        self._now += 1
        self._met = np.concatenate([self._met, np.zeros(len(new), np.int64)])
        self._met[out] = self._now
        return out

    def _forget(self) -> None:
        """Long chunks go, and those not met for longest where there are too many."""
        keep = pc.less_equal(pc.binary_length(self._known), _SHORT).to_numpy(zero_copy_only=False)
        if len(keep) > _KEEP:
            last = len(keep) - 1 - _KEEP // 2
            keep &= self._met > np.partition(self._met, last)[last]
        if not keep.all():
            flat = self._flat[np.repeat(keep, self._size)]
            self._known, self._size, self._met, self._flat = self._known.filter(pa.array(keep)), self._size[keep], self._met[keep], flat

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids): ids of all texts in turn, and how many each has; null is empty."""
        found = [self._some(part) for part in slices(pc.fill_null(texts.cast(pa.large_string()), ""))]
        pa.default_memory_pool().release_unused()
        return np.concatenate([np.zeros(0, np.int64), *(x for x, _ in found)]), np.concatenate([np.zeros(0, "<u4"), *(x for _, x in found)])

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self._cuts:
            whole = self._encode(texts.to_pylist())
            return np.array([len(x) for x in whole], np.int64), np.concatenate([*whole, np.zeros(0, "<u4")])
        unsafe = pc.match_substring_regex(texts, _UNSAFE)
        odd = unsafe.to_numpy(zero_copy_only=False)
        marked = pc.if_else(unsafe, "", pc.replace_substring(pc.replace_substring(texts, " ", _MARK + " "), "\n", f"{_MARK}\n{_MARK}"))
        lists = pc.split_pattern(marked, _MARK)
        coded = lists.flatten().dictionary_encode()
        lengths, ids = _gather(*self._chunks(coded.dictionary), coded.indices.to_numpy())
        doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        sizes = np.bincount(doc, lengths, minlength=len(texts)).astype(np.int64)
        if odd.any():
            split = np.split(ids, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(odd).tolist():
                split[i] = self._encode([texts[i].as_py()])[0]
                sizes[i] = len(split[i])
            ids = np.concatenate(split)
        return sizes, ids


def _gather(size: np.ndarray, flat: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ids) of the coded chunks in turn; flat has each chunk's ids once."""
    lengths, start = size[code], (np.cumsum(size) - size)[code]
    return lengths, flat[np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]


def slices(texts: pa.Array, size: int = 4 << 20) -> list[pa.Array]:
    """The texts in parts of about `size` bytes, none of them short, or one text where that is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    whole = int(ends[-1]) if len(ends) else 0
    part = ends // (whole // max(1, round(whole / size)) + 1)
    first = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return [texts.slice(a, b - a) for a, b in zip(first, [*first[1:], len(texts)])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


@lru_cache(maxsize=8)
def version_of(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return sha256(f.read()).hexdigest()
