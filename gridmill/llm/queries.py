"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import (
    ann, hard_negatives, huffman, lines, mixing, pieces, quality, simhash, spelling, suffix_tree,
    token_cache, urls, warc,
)
from gridmill.llm.registry import query, table
from gridmill.session import cut_lineage, work_path

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@query("op1_huffman_ids")
def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as Huffman blocks and read back from them."""
    path = work_path(spark, "ids")
    huffman.huffman_ids(table(spark, sf_dir, "documents"), BYTE_BPE, path)
    return huffman.read_ids(spark, path).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op4_token_cache")
def op4_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document by way of a cache that starts out empty."""
    docs = table(spark, sf_dir, "documents")
    counts = token_cache.token_counts(docs, BYTE_BPE, work_path(spark, "token_cache"))
    return counts.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit")
    )


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_groups(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


# Host, path and verdict of the listed entries.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    "op6_url_filter",
    """
    WITH rests AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
      FROM pages),
    parts AS (
      SELECT page_id,
        translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM rests),
    rules(r_host, r_path, r_verdict) AS (VALUES
      ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    urls AS (SELECT DISTINCT host, path FROM parts),
    best AS (
      SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
             arg_max(r_verdict, length(r_host || r_path)) AS verdict
      FROM urls JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
      GROUP BY 1, 2)
    SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
    """,
)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url by a list of hosts and paths."""
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, perplexity and verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "perplexity",
    )


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document loses, and a digest of what is left of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.line_dedup(docs, min_words=1, near=5).select(
        "doc_id", "n_lines", "n_removed", "n_near", F.length("text").cast("long").alias("n_chars_left"), F.crc32("text").alias("text_crc32")
    )


@query("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and its source's target."""
    return mixing.taken_words(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", "taken"
    )


@query("op8_posting_lists")
def op8_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    found = ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op2_suffix_tree")
def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a suffix tree learned from six of seven."""
    return suffix_tree.score(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op3_merge_dropout")
def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under merge-dropout, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encoded(docs, PIECE_BPE).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        (pieces.decode(F.col("ids"), PIECE_BPE) == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


@query(
    "op13_hard_negatives",
    """
    WITH used AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
             CAST(list_inner_product(a.vec, r.vec) AS BIGINT) AS score
      FROM used a JOIN used r ON a.vec_id <> r.vec_id
      WHERE a.vec_id % 100 = 0),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scored s
      ON s.anchor_id = p.anchor_id AND NOT same
     AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


@query(
    "op11_warc",
    """
    WITH known AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    sized AS (SELECT page_id, html, strlen(html) AS payload_bytes,
                     CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS head
              FROM known)
    SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> head THEN head END AS refers_to
    FROM sized
    """,
)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of every page, once they are read back and assembled."""
    path = work_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    read = warc.read_warc(spark, path).withColumns({"n_bytes": F.octet_length("payload").cast("long"), "sha": F.sha1("payload")})
    captures = warc.assemble(cut_lineage(read.drop("payload", "date", "content_type")))
    whole_length = F.regexp_extract("http", r"(?i)\nContent-Length: (\d+)", 1).cast("long")
    page = lambda metadata: F.get_json_object(F.get(metadata, F.lit(0))["content"], "$.id").cast("long")
    rows = captures.select(
        page(F.col("metadata")).alias("page_id"),
        F.coalesce("n_bytes", whole_length).alias("payload_bytes"),
        F.coalesce("sha", "payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        page(F.col("refers.metadata")).alias("refers_to"),
        "copies",
    )
    return warc.repeated(rows)


@query(
    "op12_spelling",
    r"""
    WITH RECURSIVE tab AS (
      SELECT list_transform(range(256), lambda i: list_reduce(range(8),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
    runs AS (
      SELECT coalesce(doc_id::VARCHAR, '') AS id,
             translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
      FROM documents),
    hashed AS (
      SELECT run, xor(4294967295, list_reduce(
               list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h
      FROM runs, tab),
    words AS (
      SELECT word, count(*) AS n
      FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
            FROM hashed)
      WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
    cut AS (
      SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
      FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    shorter AS (SELECT DISTINCT c.word, c.n, w.word AS other, w.n AS other_n FROM cut c JOIN words w ON c.rest = w.word),
    near AS (
      SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION ALL SELECT word, other, other_n FROM shorter
      UNION ALL SELECT other, word, n FROM shorter),
    best AS (
      SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
      QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
    told AS (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
      FROM words w LEFT JOIN best b ON b.word = w.word),
    way AS (
      SELECT word, word AS root, 0 AS steps FROM told
      UNION ALL SELECT way.word, told.form, steps + 1 FROM way JOIN told ON told.word = way.root WHERE told.form IS NOT NULL)
    SELECT t.word, form, (SELECT arg_max(root, steps) FROM way WHERE way.word = t.word) AS root, n, n_near, form_n FROM told t
    """,
)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    found = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    run, length = F.col("run"), F.length("run")
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), run).cast("binary"))
    at = (h % length).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, length))
    words = found.select(F.when(h % 31 == 0, cut).otherwise(run).alias("word"))
    return spelling.variants(spelling.word_counts(words)).select("word", "form", "root", "n", "n_near", "form_n")
