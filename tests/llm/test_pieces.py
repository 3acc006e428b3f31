from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from gridmill.llm import pieces as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(2)
    parts = [" ", "  ", "     ", "\n", "\t", "the", "ing", "é", "日本", "<s>", "<0x41>", "1234", "\x01", "word", "🙂", ".", "A", "\x85"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    return ["", " ", "\n", "a", "the threshold of whhaing", *made]


def encode(some, dropout, seed=3):
    sizes, ids = P.encode_texts(P.pieces(MODEL), some, [str(i) for i in range(len(some))], dropout, seed)
    ends = sizes.cumsum().tolist()
    return [ids[e - n : e].tolist() for n, e in zip(sizes.tolist(), ends)]


def test_without_dropout_the_ids_are_the_librarys():
    for some in (texts(), texts()[:1], ["a"]):
        assert encode(some, 0.0) == [LIBRARY.encode(t) for t in some]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_every_segmentation_decodes(dropout):
    some = [*texts(), "a▁b ▁", "▁"]
    for t, ids in zip(some, encode(some, dropout)):
        assert P.pieces(MODEL).decode(ids) == t
        if "▁" not in t:
            assert LIBRARY.decode(ids) == t


def plain_cut(word, key, skip, model):
    """Best pair by pair over the whole word; a skipped candidate stays skipped while it is there."""
    part, at = list(word), list(range(len(word)))
    skipped = set()
    while True:
        best = min(
            ((model.rank[part[i] + part[i + 1]], at[i], i) for i in range(len(part) - 1) if part[i] + part[i + 1] in model.rank and (at[i], at[i + 1], part[i] + part[i + 1]) not in skipped),
            default=None,
        )
        if best is None:
            return part
        i = best[2]
        piece = part[i] + part[i + 1]
        x = (key + at[i] * 0x9E3779B1 + at[i + 1] * 0x85EBCA77 + len(piece) * 0xC2B2AE3D) & 0xFFFFFFFF
        x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        x = ((x ^ (x >> 12)) * 0x297A2D39) & 0xFFFFFFFF
        if x ^ (x >> 15) < skip:
            skipped.add((at[i], at[i + 1], piece))
        else:
            part[i : i + 2], at[i + 1 : i + 2] = [piece], []


def test_agenda_matches_a_plain_search():
    model, rng = P.pieces(MODEL), random.Random(9)
    words = [" " + "".join(rng.choice(["the", "ing", "tion", "a", "e", "s", "éa", " "]) for _ in range(rng.choice([rng.randint(1, 9), 60]))) for _ in range(200)]
    keys = np.array([rng.getrandbits(32) for _ in words])
    for skip in (0, 1 << 29, 1 << 31, (1 << 32) + 1):
        sizes, ids = model.cut(words, keys, skip)
        ends = sizes.cumsum()
        for w, k, n, e in zip(words, keys.tolist(), sizes, ends):
            assert ids[e - n : e].tolist() == [model.ids[p] for p in plain_cut(w.replace(" ", "▁"), k, skip, model)]


def test_segmentations_vary_and_repeat(spark):
    rows = [(i, "the threshold of whhaing nations " * 20, "old") for i in range(20)] + [(None, None, "old"), (None, "", "old"), (3, "x" * 70_000, "old")]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, ids string")
    out = P.encoded(docs, MODEL)
    first, again = out.collect(), P.encoded(docs.repartition(3), MODEL).collect()
    assert sorted(first, key=str) == sorted(again, key=str)
    assert len({tuple(r.ids) for r in first}) >= 20
    other = P.encoded(docs, MODEL, seed=1).collect()
    assert sum(a.ids == b.ids for a, b in zip(first, other)) < 6
    back = out.select("text", P.decode(F.col("ids"), MODEL).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)
    assert P.encoded(docs.limit(0), MODEL).count() == 0


def test_every_occurrence_has_draws_of_its_own():
    n, model = 20_000, P.pieces(MODEL)
    one = {seed: P.encode_texts(model, ["a " * n], ["1"], 0.1, seed)[1].tolist() for seed in (0, 1)}
    varied = {}
    for seed, ids in one.items():  # a skipped merge leaves the blank and the letter
        texts, varied[seed], number = [model.text[i] for i in ids], set(), 0
        for t in texts:
            varied[seed] |= {number} if t == b" " else set()
            number += t.endswith(b"a")
        assert 0.09 * n < len(varied[seed]) < 0.11 * n
    assert len(varied[0] & varied[1]) < 0.015 * n
    whole = model.decode(encode(["abstraction " * 2000], 0.3)[0])
    assert whole == "abstraction " * 2000
    sizes, ids = P.encode_texts(model, ["abstraction"] * 2000, [str(i) for i in range(2000)], 0.3, 0)
    assert len({tuple(x) for x in np.split(ids, sizes.cumsum()[:-1])}) > 20


def test_shared_merges_match_cutting_each_occurrence():
    model, some = P.pieces(MODEL), [*texts(), "the nation of the " * 50, "x" * 300]
    names = [str(i) for i in range(len(some))]
    sizes, ids = P.encode_texts(model, some, names, 0.2, 5)
    chunks = [P._CHUNK.findall(" " + t) if t else [] for t in some]
    keys = P._keys(names, np.array([len(c) for c in chunks]), 5)
    assert ids.tolist() == model.cut([c for x in chunks for c in x], keys, int(0.2 * (1 << 32)))[1].tolist()


def test_shared_cuts_match_a_heap_for_each_occurrence():
    model, rng = P.pieces(MODEL), random.Random(4)
    parts = ["the", "ing", "tion", "a", "é", "日", "\n"]
    words = [" " + "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    chunks = [rng.choice(words) for _ in range(4000)] + [" " + "the" * 40]
    keys = np.array([rng.getrandbits(32) for _ in chunks])
    for skip in (0, 1 << 28, 1 << 31):
        sizes, ids = model.cut(chunks, keys, skip)
        for c, k, got in zip(chunks, keys.tolist(), np.split(ids, sizes.cumsum()[:-1])):
            assert got.tolist() == model.cut_long(c, k, skip).tolist()
    sizes, ids = model.cut([], keys[:0], 1 << 28)
    assert len(sizes) == len(ids) == 0
