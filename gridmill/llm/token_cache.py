"""Token counts kept in a cache by the digest of the content and of the tokenizer.

Content is the text as the tokenizer sees it: null as the empty text, and otherwise
unchanged, as anything that changes a text may change its count.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.bpe import encoder, version_of

_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of each text as the tokenizer's library gives them, none added or cut off.

    tokenizer: path of a .json file (tokenizers) or .model file (sentencepiece).
    """

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        if tokenizer.endswith(".model"):
            pieces = _pieces(tokenizer)
            return pa.array([len(pieces.encode(t.as_py() or "")) for t in texts], pa.int64())
        return pa.array(encoder(tokenizer)(texts)[0], pa.int64())

    return count(text)


_MODELS: dict[str, object] = {}


def _pieces(path: str):
    if path not in _MODELS:
        from sentencepiece import SentencePieceProcessor

        _MODELS[path] = SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for one tokenizer version, each digest once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _SCHEMA).select("digest", "n_tokens")
    rows = spark.read.schema(_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    # Two writers at once may both have stored a digest.
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens), one row per row of docs; new counts are added to the cache.

    Only contents that the cache lacks are encoded, each once however many rows have it;
    their counts are appended before the result is joined up. Null text counts as empty.
    Repeated ids stay as they are.
    """
    spark, version = docs.sparkSession, version_of(tokenizer)
    text = F.coalesce(text_col, F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    missing = (
        keyed.join(stored_counts(spark, cache, version), "digest", "left_anti")
        .groupBy("digest")
        .agg(F.any_value("text").alias("text"))
    )
    (
        missing.select("digest", count_tokens(F.col("text"), tokenizer).alias("n_tokens"), F.lit(version).alias("tokenizer"))
        .write.mode("append")
        .partitionBy("tokenizer")
        .parquet(cache)
    )
    counts = stored_counts(spark, cache, version)
    return keyed.drop("text").join(counts, "digest", "left").select("id", "n_bytes", "n_tokens")
