from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from gridmill.llm import lines as L


def words(line):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", line))


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, order):
    """{(id, text): (text left, n_removed, n_near)} by comparing all pairs of lines."""
    docs = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, order[d[1]]))
    seen, out = [], {}
    for id_, text in docs:
        if text is None:
            out[id_, text] = (None, 0, 0)
            continue
        kept, near = [], 0
        for line in text.split("\n"):
            w = words(line)
            exact = len(w) >= 5 and any(w == s for s in seen)
            close = len(w) >= 8 and any(len(s) >= 8 and within_one(w, s) for s in seen)
            if not exact and not close:
                kept.append(line)
            near += close and not exact
            if len(w) >= 5:
                seen.append(w)
        out[id_, text] = ("\n".join(kept), len(text.split("\n")) - len(kept), near)
    return out


def random_docs(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "é", "the", "of.", "x\x85", "日本"])
    pool = [[word() for _ in range(rng.choice([0, 1, 4, 5, 6, 7, 8, 9, 12, 30]))] for _ in range(30)]
    docs = []
    for i in range(45):
        made = []
        for _ in range(rng.randint(1, 9)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, kind = rng.randint(0, len(w)), rng.randint(0, 2)
                w = w[:at] + [word()] * (kind < 2) + w[at + (kind > 0) :]
            made.append(rng.choice(["", " "]) + rng.choice([" ", "  ", "\t"]).join(w))
        docs.append((rng.choice([None, i, i, i // 2]), "\n".join(made)))
    return docs + [(3, None), (None, None), (7, ""), (8, "\n\n")] + docs[:5]


def test_matches_all_pairs(spark):
    for seed in (1, 2):
        docs = random_docs(seed)
        frame = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, near string").repartition(3)
        order = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
        out = L.line_dedup(frame.withColumn("key", F.col("text")))
        want = plain(docs, order)
        got = out.collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r.text, r.n_removed, r.n_near) == want[r.doc_id, r.key]
            assert r.near == "z" and r.n_lines == (0 if r.key is None else r.key.count("\n") + 1)


def test_one_template_many_lines(spark):
    body = "this line has one changing word number {} and then goes on"
    docs = spark.createDataFrame([(i, body.format(i)) for i in range(3000)], "doc_id long, text string")
    left = L.line_dedup(docs).where("text != ''").collect()
    assert [r.doc_id for r in left] == [0]


def test_empty_table(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_take_part(spark, tmp_path):
    from gridmill.llm.queries import op9_line_dedup

    rows = [(1, "one\na b c d\nthe cat sat down here\nq w e r t y u"), (2, "one\n\nA b c d\na b c d\nthe dog sat down here\nq w e r t y u i\nx b c d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_near, r.n_chars_left) for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    # Lines of under 5 words go as exact copies only; empty lines stay.
    assert got == {1: (4, 0, 0, len(rows[0][1])), 2: (7, 4, 2, len("\nA b c d\nx b c d"))}


def test_clashing_names_stay(spark):
    text = "one line of more than eight words in all of it\nanother line that has no copy anywhere else at all"
    rows = [(1, text, 1, "h", "t", 2, "n", "g", "i"), (2, text, 3, "h", "t", 4, "n", "g", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _near int, _h string, _th string, _id int, near string, gone string, h string")
    got = {r.doc_id: r for r in L.line_dedup(docs).collect()}
    assert got[1].text == text and got[2].text == "" and got[2].n_removed == 2
    assert [got[2][c] for c in docs.columns[2:]] == list(rows[1][2:])
