"""Corpus preparation, stage by stage, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import lines, mixing, pieces, quality, shingles
from gridmill.llm.registry import table
from gridmill.session import prepare, work_path

# Workers of one stage serve the next, so what a batch of long texts takes adds up: batches
# are bounded by bytes, not by rows alone.
BATCH_BYTES = 4 << 20

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail on their counts or their perplexity go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand, but for one word at most, in an earlier document or line go."""
    return _counted(lines.line_dedup(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Near copies: five-word shingles of similarity 0.8 or more, found by fingerprints
    that differ in a few bits, and by MinHash bands where more bits differ.
    """
    return shingles.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, once for each pass over its source."""
    return _counted(mixing.mix_documents(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts under merge-dropout."""
    ids = pieces.encoded(docs, PIECES).withColumn("n_tokens", F.size("ids").cast("long"))
    return ids.select("doc_id", "lang", "source", "n_tokens", "ids")


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*like.columns)


def _prepared(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


# Each may be run by itself, with the settings that the operators rely on.
STAGES = [(stage.__name__, _prepared(stage)) for stage in (quality_rules, line_dedup, near_dedup, mix_sources, encode)]

# The model, the fingerprints and the ids have no SQL form; tests/llm checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
