from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, id string, slot int"


def plain(rows, positives=5, negatives=5):
    used = {}
    for i, label, v, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            entry = (label, [math.floor(256 * x) for x in v])
            used[i] = min(used.get(i, entry), entry)
    out = []
    for a in (i for i in used if i % 10 == 0):
        label, v = used[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in used.items() if i != a and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            window = [(-s, i) for s, i, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(a, pid, r, i, -p, s) for r, (s, i) in enumerate(window[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **sizes):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = hard_negatives.hard_negatives(frame, F.col("id") % 10 == 0, F.col("label"), **sizes)
    return sorted(map(tuple, found.collect()))


def made(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in np.round(rng.normal(size=dim) * spread) / 8], "x", 0) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"block": 32, "chunk": 256}])
def test_matches_all_pairs_with_ties_and_odd_rows(spark, sizes):
    rows = made(400, 8, 1, 2)
    # Copies of one vector, a third of the rows, under two labels.
    rows += [(1000 + i, i % 2, rows[7][2], "x", 0) for i in range(200)]
    rows += [(None, 1, [1.0] * 8, "x", 0), (2000, None, [1.0] * 8, "x", 0), (2010, 1, None, "x", 0), (2020, 1, [1.0] * 7 + [None], "x", 0)]
    rows += [(2030, 1, [float("nan")] * 8, "x", 0), (2040, 1, [float("inf")] * 8, "x", 0), (2050, 1, [0.0] * 8, "x", 0), (2060, 2, [0.0] * 8, "x", 0)]
    rows += [(2070, 1, [], "x", 0), (2080, 2, [], "x", 0), (2090, 1, [1.0, 2.0], "x", 0), (2100, 1, [2.0, 2.0], "x", 0), (2101, 2, [2.0, 2.0], "x", 0)]
    rows += [rows[10], (20, 2, rows[30][2], "x", 0)]
    want = plain(rows)
    assert mined(spark, rows, **sizes) == want
    assert len({r[:2] for r in want}) > 50 and any(r[2] == 5 for r in want)


def test_scores_beyond_doubles_stay_exact(spark):
    big = 2.0**20
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 3.0]), (2, 1, [big, 2.0]), (3, 2, [big, 2.5]), (4, 2, [big, 1.5]), (5, 2, [big, 3.5])]
    rows = [(i, label, [v * 8 for v in vec], "x", 0) for i, label, vec in rows]
    assert mined(spark, rows) == plain(rows) != []


def test_few_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0], "x", 0)]) == []
    # No negative below zero, none above the positive.
    assert mined(spark, [(0, 1, [1.0], "x", 0), (1, 1, [-1.0], "x", 0), (2, 2, [-1.0], "x", 0)]) == []
    assert mined(spark, [(0, 1, [1.0], "x", 0), (1, 1, [1.0], "x", 0), (2, 2, [1.0], "x", 0), (3, 2, [1.5], "x", 0)]) == [(0, 1, 1, 2, 65536, 65536)]
