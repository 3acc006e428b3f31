from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as C
from gridmill.llm import lines, mixing, pieces, quality, shingles
from gridmill.llm.registry import table


def kept_by_all_pairs(rows):
    """Smallest ids of the groups that five-word shingles of similarity 0.8 or more connect, by all pairs."""
    first = {}
    for i, text in rows:
        key = frozenset(shingles.shingles((text or "").encode(), 5).tolist())
        first[key] = min(first.get(key, i), i)
    keys, root = list(first), {k: k for k in first}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, x in enumerate(keys):
        for y in keys[:n]:
            small, large = sorted((len(x), len(y)))
            if small >= 0.8 * large and len(x & y) >= 0.8 * len(x | y):
                root[top(x)] = top(y)
    groups = {}
    for k in keys:
        groups[top(k)] = min(groups.get(top(k), first[k]), first[k])
    return sorted(groups.values())


def test_stages_follow_their_operators(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns, outs = docs.columns, []
    for i, (name, stage) in enumerate(C.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        outs.append((before, docs))
        if i < len(C.STAGES) - 1:
            assert docs.columns == columns
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    keep = lambda df: sorted(r[0] for r in df.collect())
    (a, b), (_, c), (_, d), (_, e), (_, f) = outs
    assert keep(b.select("doc_id")) == keep(quality.quality(a).where("kept").select("id"))
    assert Counter(map(tuple, c.select("doc_id", "text").collect())) == Counter(map(tuple, lines.line_dedup(b).select("doc_id", "text").collect()))
    assert keep(d.select("doc_id")) == kept_by_all_pairs(c.select("doc_id", "text").collect())
    taken = Counter({r.key: r.taken for r in mixing.taken_words(d).collect() if r.taken})
    words = Counter()
    for r in e.collect():
        words[r.doc_id] += len(r.text.encode().split())
    assert words == taken
    back = f.select("doc_id", pieces.decode(F.col("ids"), C.PIECES).alias("text"))
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, e.select("doc_id", "text").collect()))
    assert f.count() > 0


def test_odd_rows_go_through(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "word " * 40, None, None, 3), (2, "\n\n", "en", "a", 2)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.columns[0] == "doc_id"


def test_stages_bound_the_bytes_of_a_batch(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = [(i, "word " * 20_000, "en", "a", 100_000) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    spark.conf.unset(key)
    C.STAGES[0][1](spark, docs, "")
    sizes = docs.select("text").mapInArrow(lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) < 8e6
