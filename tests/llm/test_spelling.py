from __future__ import annotations

import random

import pytest

from gridmill.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], counts.get(form[w]), root))
    return sorted(out, key=str)


def grouped(spark, counts, **more):
    frame = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string").repartition(3)
    return sorted(map(tuple, spelling.variants(frame, **more).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


@pytest.mark.parametrize("list_size", [1, 3, 16])
def test_matches_all_pairs(spark, list_size):
    rng = random.Random(list_size)
    counts = {}
    for _ in range(60):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
        n = rng.choice([2000, 50, 2])
        counts[w] = n
        for _ in range(6):
            i = rng.randrange(len(w) + 1)
            v = rng.choice([w[:i] + rng.choice("abéÿ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i + 1 :]])
            if v:
                counts.setdefault(v, rng.choice([200, 20, 2, 2]))
            w = v or w
    want = plain(counts)
    assert grouped(spark, counts, list_size=list_size) == want
    assert any(r[5] not in (r[0], r[3]) for r in want) and any(r[2] > 5 for r in want)


def test_runs_of_one_letter_long_words_and_one_hot_gram(spark):
    # A third of the words share all but their last letters; words of one letter repeated
    # can lose any of them; a very long word has a partner far into it.
    counts = {"a" * i: 10**i for i in range(1, 13)}
    counts |= {f"commonstem{x}{y}": 2 for x in "abcdefghij" for y in "klmnopqrst"}
    counts |= {"z" * 5000 + "y" + "z" * 3000: 30, "z" * 8001: 2, "z" * 8000: 300, "alone": 5}
    assert grouped(spark, counts, list_size=2) == plain(counts)


def test_ties_nulls_and_empty(spark):
    # Equal counts: the smallest form in code-point order; below the ratio: none.
    assert grouped(spark, {"cat": 2, "cut": 20, "cot": 20, "cät": 20}) == plain({"cat": 2, "cut": 20, "cot": 20, "cät": 20})
    assert grouped(spark, {"cat": 2, "cut": 19})[0][3] is None
    assert grouped(spark, {}) == []
    odd = spark.createDataFrame([(None, 3), ("cat", None), ("cut", 2)], "word string, n long")
    assert [r.word for r in spelling.variants(odd).collect()] == ["cut"]
    with pytest.raises(ValueError):
        spelling.variants(odd, ratio=1)


def test_words_are_whole_runs_of_letters(spark):
    texts = [(1, "Abcdefg hij ABCDEFGÀ×ÿ 1abcdefg_abcdefgh"), (2, None), (3, ""), (None, "ÉCOLEFRANÇAISE")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted(map(tuple, spelling.runs(docs).collect()), key=str)
    assert found == sorted([(1, "abcdefg"), (1, "abcdefgÀ×ÿ"), (1, "abcdefg"), (1, "abcdefgh"), (None, "ÉcolefranÇaise")], key=str)
    counted = spelling.word_counts(spelling.runs(docs).withColumnRenamed("run", "word"))
    assert [tuple(r) for r in counted.collect()] == [("abcdefg", 2)]
