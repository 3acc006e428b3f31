from __future__ import annotations

import random

from gridmill.llm import urls

LISTED = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "", "allow"), ("a.net", "/e", "block")]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_matches_a_plain_search(spark):
    rng = random.Random(4)
    piece = lambda: rng.choice(["com", "net", "example", "www", "a", "É", "EXAMPLE", "", "x:80", "u@v"])
    made = [None, "", "no scheme/en/", "://", "http://net", "HTTP://Example.COM/en/x#://net/es/"]
    for _ in range(300):
        host = ".".join(piece() for _ in range(rng.randint(1, 4)))
        made.append("http://" + host + rng.choice(["", "/", "/en/", "/en", "/es/1?q=/", "/fr/#a", "?/es/", "//en/", "/e\n/"]) * rng.randint(0, 2))
    rows = [(rng.choice([None, *range(50)]), u, "own") for u in made + made[:20]]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    listed = spark.createDataFrame(LISTED + LISTED[:2], "host string, path string, verdict string")
    got = urls.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *plain(u)) for i, u, _ in rows), key=str)


def test_filter_passes_every_entry_and_few_others(spark):
    listed = spark.range(20_000).selectExpr("concat('h', id) AS host", "'/' AS path")
    bloom = urls.BlockedBloom(listed)
    asked = spark.range(40_000).selectExpr("id", "concat('h', id) AS host", "'/' AS path")
    passed = {r.id for r in asked.where(bloom.may_hold(asked.host, asked.path)).select("id").collect()}
    assert passed >= set(range(20_000)) and len(passed) < 20_000 + 600


def test_empty_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(pages, none).collect()] == ["allow"]
    listed = spark.createDataFrame(LISTED, "host string, path string, verdict string")
    assert urls.judge(pages.limit(0), listed).count() == 0


def test_clashing_names_and_long_hosts(spark):
    listed = spark.createDataFrame(LISTED, "host string, path string, verdict string")
    long_host = ".".join(["a"] * 20_000) + ".example.com"
    pages = spark.createDataFrame([(1, f"http://{long_host}/en/x", 5, "h"), (2, "http://x.net/es/", 6, "p")], "page_id long, url string, best int, r_host string")
    got = {r.page_id: r for r in urls.judge(pages, listed).collect()}
    assert (got[1].rule, got[1].verdict, got[1].best, got[1].r_host) == ("example.com/en/", "block", 5, "h")
    assert (got[2].rule, got[2].verdict, got[2].best) == ("net/es/", "block", 6)
