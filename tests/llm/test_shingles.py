from __future__ import annotations

import random

import corpus_pipeline as C
from gridmill.llm import shingles, simhash


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """Smallest id of each component of pairs with similarity 0.8 or more, by comparing all pairs."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return sorted({find(i): min(rows[k][0] for k in range(len(rows)) if find(k) == find(i)) for i in range(len(rows))}.values())


def test_stage_keeps_one_of_each_similar_group(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = ["", None, " \n", "One two", "one  TWO", "one two three"]
    for _ in range(40):
        base = [word() for _ in range(rng.choice([6, 60, 200, 500]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):  # each a step away from the one before
            base = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) // rng.choice([25, 50, 60, 70]))):
                base[at] = word()
            texts.append("\n".join(base))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in C.near_dedup(spark, docs, "").collect()) == plain_kept(rows)


def test_close_fingerprints_meet_without_a_common_band(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    # Steps of one word: the chain's ends are similar, and so are all between; the last text is not.
    texts = [" ".join([f"x{k}" if i in range(0, 900 * k, 900) else w for i, w in enumerate(base)]) for k in range(4)]
    texts.append(" ".join(reversed(base)))
    prints = [simhash.fingerprint_of(t.encode(), 5) for t in texts]
    assert all((a ^ b).bit_count() <= 4 for a, b in zip(prints[:4], prints[1:4]))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    # The last text is put beside the others: close fingerprints alone link nothing.
    rows = list(zip(range(5), [signed(p) for p in [*prints[:4], prints[0]]], texts))
    sets = spark.createDataFrame([(i, [], t) for i, _, t in rows], "set long, bands array<long>, text string")
    found = shingles.links(sets, spark.createDataFrame([r[:2] for r in rows], "set long, fp long")).collect()
    reach = {0}
    for _ in range(4):
        reach |= {x for a, b in found for x in (a, b) if {a, b} & reach}
    assert reach == {0, 1, 2, 3}
