from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from gridmill.llm import bpe, huffman, token_cache
from gridmill.llm.bpe import Encoder
from gridmill.session import work_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(BPE)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def odd_texts(n=400):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "'s", "it's", "a", "é", "1", ".", "<|endoftext|>", "\x01", "\x1c", "\x85", "\xa0", "　", "日本", "\r", "foo", "​"]
    return [None, "", " ", "\n", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_what_the_library_gives(name):
    path = public_tokenizers.path(name)
    sizes, ids = Encoder(path)(pa.array(odd_texts()))
    library = tokenizers.Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in odd_texts()]
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("keep, short", [(0, 48), (6, 48), (1000, 3)])
def test_chunks_remembered_and_forgotten_change_nothing(monkeypatch, keep, short):
    monkeypatch.setattr(bpe, "_KEEP", keep)
    monkeypatch.setattr(bpe, "_SHORT", short)
    encode, rng = Encoder(BPE), random.Random(2)
    words = ["the", "of.", "and,", "Ünder", "x" * 60, "日本", "it's", "a1", "<|endoftext|>", "\n"]
    for _ in range(8):
        batch = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        sizes, ids = encode(pa.array(batch))
        assert ids.tolist() == [i for t in batch for i in plain(t)]
        assert sizes.tolist() == [len(plain(t)) for t in batch]
        assert len(encode._known) == len(encode._size) == len(encode._met) <= keep
        assert len(encode._flat) == encode._size.sum()


def test_marks_behind_a_word_share_the_word():
    encode, rng = Encoder(BPE), random.Random(5)
    tails = ["", ",", ".", "!!", "$$$", "%%%,", ".###", "***", ":;?", "&'s", "'", "|>", "...", "-!"]
    words = ["ofereal", "QUEAUXÈ", "Über", "ñandu", "É", "a1", "日本", "don't", "<|endoftext|>", "x_"]
    batch = [" ".join(rng.choice(words) + rng.choice(tails) for _ in range(40)) for _ in range(200)]
    sizes, ids = encode(pa.array(batch))
    assert ids.tolist() == [i for t in batch for i in plain(t)]
    assert sizes.tolist() == [len(plain(t)) for t in batch]
    known = set(encode._known.to_pylist())
    assert " ofereal" in known and not {" ofereal" + t for t in ("!!", "$$$", "%%%,", ".###")} & known


def test_slices_are_even():
    texts = pa.array(["x" * 100] * 1001)
    assert [len(p) for p in bpe.slices(texts, 50_000)] == [500, 501]
    assert sum(len(p) for p in bpe.slices(pa.array(["a", "b" * 1000, None]), 10)) == 3
    assert bpe.slices(pa.array([], pa.string())) == []


@pytest.mark.parametrize("n, total", [(1, 10), (2, 50), (300, 1000), (5000, 200_000)])
def test_codes_round_trip(n, total):
    rng = np.random.default_rng(n)
    ids = np.minimum((rng.pareto(0.6, total) * 3).astype(np.int64), n - 1)
    counts = np.bincount(ids, minlength=n)
    lengths = huffman.code_lengths(counts)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= huffman.LIMIT and (len(used) == 1 or (2.0**-used).sum() == 1)
    codes = huffman.Codes(lengths)
    part = ids[: huffman.BLOCK]
    (payload, raw), = codes.encode(part, np.array([len(part)]))
    offsets = np.frombuffer(raw, "<u4")
    assert huffman.decode(payload, offsets, np.array([len(part)]), codes.bits, codes.table()).tolist() == part.tolist()


def test_limit_holds_where_plain_codes_would_be_longer():
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lengths = huffman.code_lengths(np.array(fibonacci), 8)
    assert lengths.max() == 8 and (2.0 ** -lengths.astype(float)).sum() == 1


def test_ids_written_and_read(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), t, "x") for t in odd_texts(60)]
    rows += [(7, "same same", "x")] * 3 + [*[(99, "long words here " * 30_000, "x")] * 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    path = work_path(spark, "test")
    monkeypatch.setattr(huffman, "PART", 40_000)
    huffman.huffman_ids(docs, BPE, path)
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 2
    got = huffman.read_ids(spark, path).orderBy("start").collect()
    assert [r.id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    want = sorted([(str(i), crc([*plain(t), 0])) for i, t, _ in rows])
    assert sorted((str(r.id), zlib.crc32(r.ids)) for r in got) == want


def test_ids_of_an_empty_table(spark):
    path = work_path(spark, "test")
    huffman.huffman_ids(spark.createDataFrame([], "doc_id long, text string"), BPE, path)
    assert huffman.read_ids(spark, path).count() == 0


def test_cache_encodes_only_misses(spark):
    cache = work_path(spark, "cache")
    rows = [(i, t, 5) for i, t in enumerate(odd_texts(40))] + [(None, "a b", 1), (3, "a b", 1), (3, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = sorted((str(i), len((t or "").encode()), len(plain(t))) for i, t, _ in rows)
    for _ in range(2):
        got = token_cache.token_counts(docs, BPE, cache).collect()
        assert sorted((str(r.id), r.n_bytes, r.n_tokens) for r in got) == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in rows})
    more = spark.createDataFrame([(1, "never seen"), (2, "a b")], "doc_id long, text string")
    assert token_cache.token_counts(more, BPE, cache).count() == 2
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in rows}) + 1
    model = public_tokenizers.path("piece_bpe_32k.model")
    token_cache.token_counts(more, model, cache)
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_counts_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_cache.token_counts(docs, BPE, work_path(spark, "cache")).count() == 0
