from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridmill.llm import mixing as M


def plain_targets(sizes):
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, rest = {}, 1.5 * sum(sizes.values())
    while True:
        left = [n for n in names if n not in target]
        shares = {n: rest * weight[n] / sum(weight[x] for x in left) for n in left}
        full = [n for n in left if shares[n] > 2 * sizes[n]]
        if not full:
            return target | shares
        target |= {n: 2 * sizes[n] for n in full}
        rest -= sum(target[n] for n in full)


def table(spark, seed=1, n=400):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "日本", "z"]
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 40, 200, 900])
        text = "".join(rng.choice([" ", "\n", "  ", "\t"]) + f"w{i}_{j}" for j in range(size)) + rng.choice(["", "\n"])
        rows.append((i // 2 if i % 9 == 0 else i, rng.choice([text, text, None]) if i % 5 == 0 else text, "a" if i % 3 else rng.choice(names), "own"))
    return rows + rows[:6]


@pytest.mark.parametrize("sizes", [{}, {"a": 0}, {None: 5}, {"a": 10, "b": 10_000, None: 1, "c": 0}, {f"s{i}": i * i for i in range(40)}])
def test_targets(sizes):
    got = {s.name: s.target for s in M.plan_sources(list(sizes.items()))}
    assert got == pytest.approx(plain_targets(sizes) if sizes else {})


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 17, 1000):
        out = spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in out) == list(range(n))


def test_mix_keeps_targets_and_bounds(spark):
    rows = table(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    out = M.taken_words(docs).collect()
    sizes = defaultdict(int)
    for i, t, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, taken = plain_targets(sizes), Counter()
    assert Counter((r.key, r["size"]) for r in out) == Counter((i, len((t or "").split())) for i, t, s, _ in rows)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1.5 * M.BLOCK
    again = M.taken_words(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_blocks_and_documents_hold_the_taken_words(spark):
    rows = table(spark, 2, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block int".replace("block int", "own string"))
    taken = Counter()
    for r in M.taken_words(docs).collect():
        taken[r.key] += r.taken
    blocks = M.mixed_blocks(docs).collect()
    assert len({(r.shard, r.slot) for r in blocks}) == len(blocks) and max(len(r.words) for r in blocks) == M.BLOCK
    of = defaultdict(set)
    for i, t, s, _ in rows:
        for w in (t or "").split():
            of[w].add(i)
    for words in ([w for r in blocks for w in r.words], [w for r in M.mix_documents(docs).collect() for w in r.text.split()]):
        total = Counter(min(of[w]) for w in words)
        assert sum(total.values()) == sum(taken.values())
        assert all(total[i] == taken[i] for i in total if all(len(of[w]) == 1 for t in [t for j, t, *_ in rows if j == i] for w in (t or "").split()))
    passes = defaultdict(Counter)
    for r in blocks:
        passes[r.source][r.block] += 1
    assert all(max(c.values()) - min(c.values()) <= 1 or max(c.values()) == 1 for c in passes.values())


def test_documents_keep_columns_and_whole_texts(spark):
    rows = [(i, f"  some words\nof document {i} \t", "x", 3) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, s int")
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    assert sum(r.text == rows[r.doc_id][1] for r in out.collect()) > 60


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.taken_words(docs).count() == 0 and M.mix_documents(docs).count() == 0 and M.mixed_blocks(docs).count() == 0


def test_clashing_names_and_tables_from_files(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i % 150)), "ab"[i % 2], "own", 7, "k", 3, [1]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string, _row int, row string, pass int, c array<int>")
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    for frame in (docs, stored, stored.where("doc_id >= 0").groupBy(*stored.columns).count().drop("count")):
        out = M.mix_documents(frame)
        assert out.columns == docs.columns
        words = Counter()
        for r in out.collect():
            assert (r.key, r["_row"], r.row, r["pass"], r.c) == ("own", 7, "k", 3, [1])
            words[r.doc_id] += len(r.text.split())
        assert words == Counter({r.key: r.taken for r in M.taken_words(frame).collect() if r.taken})
        blocks = Counter()
        for r in M.mixed_blocks(frame).collect():
            blocks.update(int(w[1:].split("_")[0]) for w in r.words)
            assert list(dict.fromkeys(int(w[1:].split("_")[0]) for w in r.words)) == r.ids
        assert blocks == words


def test_very_long_texts_take_time_in_proportion(spark):
    import time

    def took(n):
        docs = spark.createDataFrame([(i, " ".join(map(str, range(n))), "a") for i in range(2)], "doc_id long, text string, source string")
        begun = time.perf_counter()
        M.mix_documents(docs).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    took(1000)
    assert took(400_000) < 8 * max(took(100_000), 2)
