from __future__ import annotations

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gridmill import session
from gridmill.llm import suffix_tree as S

END = " end"


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [END]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


class PlainTree:
    """The model over dictionaries, context by context."""

    def __init__(self, train, least):
        self.c = Counter(t for x in train for t in x)
        self.n, self.v, self.least = sum(self.c.values()), len(self.c), least
        self.grams = Counter()
        for x in train:
            padded = [END, *x]
            for k in range(2, S.DEPTH + 2):
                self.grams.update(tuple(padded[i : i + k]) for i in range(len(padded) - k + 1))
        self.grams = {g: n for g, n in self.grams.items() if n >= least}
        self.after = defaultdict(dict)
        for g, n in self.grams.items():
            self.after[g[:-1]][g[-1]] = n
        every = set(self.after)
        keep = {c for c in every if self.gain(c, every) >= S.CUTOFF}
        self.states = {c[i:] for c in keep for i in range(len(c))}

    def count(self, context):
        return self.c[context[0]] if len(context) == 1 else self.grams.get(context, 0)

    def p(self, context, s, states):
        if not context:
            return (self.c[s] + 1) / (self.n + self.v + 1)
        lower = self.p(context[1:], s, states)
        if context not in states:
            return lower
        seen, total = self.after[context], self.count(context)
        n = seen.get(s)
        left = (total - sum(seen.values()) + S.DISCOUNT * len(seen) + S.MU) / (total + S.MU)
        return (0 if n is None else (n - S.DISCOUNT) / (total + S.MU)) + left * lower

    def gain(self, context, states):
        own = {s: self.p(context, s, states) for s in self.after[context]}
        other = {s: self.p(context[1:], s, states) for s in own}
        rest, rest_other = 1 - sum(own.values()), 1 - sum(other.values())
        each = sum(p * math.log(p / other[s]) for s, p in own.items())
        more = rest * math.log(rest / rest_other) if rest > 0 and rest_other > 0 else 0
        return self.count(context) * (each + more)

    def score(self, x):
        padded, total = [END, *x], 0
        for i in range(1, len(padded)):
            context = tuple(padded[max(0, i - S.DEPTH) : i])
            while context and context not in self.states:
                context = context[1:]
            total += math.log10(self.p(context, padded[i], self.states))
        return total


def rows(seed, n=150):
    rng = random.Random(seed)
    phrases = ["the cat sat on the mat", "The dog sat", "é\x85x y", "a b c d e f", "one of the most"]
    out = [(None, None, 1), (5, "", 1), (6, " \n", 1)]
    for i in range(n):
        words = " ".join(rng.choice(phrases) if rng.random() < 0.6 else rng.choice("abcdefgh") for _ in range(rng.randint(0, 25)))
        out.append((rng.choice([i, i, None, i // 3]), words, 1))
    return out + out[-5:]


@pytest.mark.parametrize("share, parts", [(2e-6, 1), (0.01, 6)])
def test_matches_the_plain_model(spark, share, parts):
    data = rows(7)
    docs = spark.createDataFrame(data, "doc_id long, text string, score int").repartition(parts)
    got = S.score(docs, share=share).collect()
    train = [tokens(t) for i, t, _ in data if not held(i)]
    tree = PlainTree(train, max(2, math.ceil(share * sum(map(len, train)))))
    assert any(len(c) > 1 for c in tree.states) or share > 1e-3
    want = Counter()
    for i, t, _ in data:
        x = tokens(t)
        base = sum(math.log10((tree.c[s] + 1) / (tree.n + tree.v + 1)) for s in x)
        want[i, held(i), len(x), sum(s in tree.c for s in x), tree.n, round(base, 6), round(tree.score(x), 6)] += 1
    assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_probabilities_sum_to_one():
    train = [tokens(t) for _, t, _ in rows(3)]
    tree = PlainTree(train, 3)
    other = 1 / (tree.n + tree.v + 1)
    for context in list(tree.states)[:20]:
        left = math.prod((tree.count(c) - sum(tree.after[c].values()) + S.DISCOUNT * len(tree.after[c]) + S.MU) / (tree.count(c) + S.MU) for c in [context[i:] for i in range(len(context))])
        assert sum(tree.p(context, s, tree.states) for s in tree.c) + left * other == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    held_id = next(i for i in range(100) if held(i))
    docs = spark.createDataFrame([(held_id, "a b")], "doc_id long, text string")
    r = S.score(docs).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)
    assert S.score(docs.limit(0)).count() == 0


def test_rare_contexts_are_learned_from_many_tokens(spark):
    free = [i for i in range(100) if not held(i)]
    asked = next(i for i in range(100) if held(i))
    data = [(free[0], "x " * 2_500_000), (free[1], "rare pair"), (free[2], "rare pair"), (asked, "rare pair")]
    r = S.score(spark.createDataFrame(data, "doc_id long, text string")).where(f"id = {asked}").first()
    assert r.train_tokens > 2_500_000
    assert r.score > r.base_score + 4  # "pair" after "rare" is common, by itself it is not


def test_takes_little_disk(spark):
    """Sequences that all stand twice, every one of them told of and answered."""

    def used():
        shared = session.shared_folder(spark).removeprefix("file://")
        local = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
        return sum(os.path.getsize(os.path.join(d, f)) for top in (shared, *local) for d, _, names in os.walk(top) for f in names)

    rng = random.Random(2)
    texts = [" ".join(str(rng.randrange(20_000)) for _ in range(1_000)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts + texts)), "doc_id long, text string")
    before = used()
    assert S.score(docs).count() == 200
    assert used() - before < 4 * 2 * sum(map(len, texts))


def test_packs_no_bytes_that_are_all_zero():
    rng = random.Random(5)
    for kind, most in [("<u8", 3), ("<u8", 2**64 - 1), ("<u4", 300), ("u1", 3), ("?", 1)]:
        for size in (0, 1, 5_000):
            x = S.np.array([rng.randint(0, most) for _ in range(size)], kind)
            assert (S._unpack(S._pack(x), kind) == x).all()
    x = S.np.array([rng.random() for _ in range(100)])
    assert (S._unpack(S._pack(x), "<f8") == x).all()
    assert len(S._pack(S.np.zeros(1_000, "<u8"))) < 20


def test_goes_over_the_texts_seldom(spark, monkeypatch):
    asked, ask = [], S._ask
    monkeypatch.setattr(S, "_ask", lambda *a: asked.append(a[3]) or ask(*a))
    assert S.score(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")).count() == 2
    assert len(asked) == S.DEPTH + 3


def test_suffixes_of_contexts_that_other_blocks_retain(spark):
    data = rows(11, 500)
    train = [tokens(t) for i, t, _ in data if not held(i)]
    tree = PlainTree(train, 2)
    every = set(tree.after)
    assert any(tree.gain(c, every) < S.CUTOFF for c in tree.states)
    got = S.score(spark.createDataFrame(data, "doc_id long, text string, score int").repartition(40)).collect()
    want = Counter((i, round(tree.score(tokens(t)), 6)) for i, t, _ in data)
    assert Counter((r.id, round(r.score, 6)) for r in got) == want
