from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from gridmill.llm import simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g, 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(pairs):
    """id -> smallest id reachable, by comparing all pairs."""
    root = list(range(len(pairs)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (id_, _) in enumerate(pairs):
        if id_ is not None:
            least[find(i)] = min(least.get(find(i), id_), id_)
    return [least.get(find(i)) for i in range(len(pairs))]


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 5)))
    out = ["", None, "  \n\t ", "One", "one", "a b c", "A B C", "x\x85y z", "ÀB c d e f"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(1, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(base))
            base = base[:at] + [word()] + base[at + 1 :]
            out.append("\n".join(base))
    return out + out[5:20]


def test_groups_match_all_pairs(spark):
    rows = [(i * 7 % 101 if i % 13 else None, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash.near_groups(docs).collect()), key=str)
    prints = [(i, plain_print(t)) for i, t in rows]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = sorted([(i, signed(p), c) for (i, p), c in zip(prints, plain_groups(prints))], key=str)
    assert got == want


def test_links_join_up_what_all_pairs_join_up(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:12]:
        for _ in range(30):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.add(p)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = simhash.links(frame).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in links)
    root = {signed(p): signed(p) for p in prints}
    find = lambda x: x if root[x] == x else find(root[x])
    for r in links:
        root[find(r.a)] = find(r.b)
    want = plain_groups([(i, p) for i, p in enumerate(prints)])
    ours, seen = [], {}
    for i, p in enumerate(prints):
        ours.append(seen.setdefault(find(signed(p)), i))
    assert ours == want


def test_keep_one_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(5, long, 1), (3, long, 2), (3, long, 3), (None, long, 4), (9, "other words here now", 5), (None, "all alone by itself", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.component_id for r in kept.collect()} in ({2, 5, 6}, {3, 5, 6})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(docs).count() == 0
    assert simhash.keep_one(docs.withColumn("fp", F.lit(1))).count() == 0
