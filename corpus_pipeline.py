"""From raw documents to token ids: five stages, each on all that the one before it kept.

Every stage's result is written to the shared folder as Parquet and read again, so a lost
executor never sets off an earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.bpe import bpe_round_trip
from orderloom.llm.components import scratch, small_batches, stored
from orderloom.llm.decontaminate import clean_documents
from orderloom.llm.line_dedup import dedup_lines
from orderloom.llm.ngram_join import one_per_component
from orderloom.llm.quality_rules import keep_good, learn_rules

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the list learned from the labels keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, learn_rules(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those left without any text go."""
    deduped = dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = deduped.where(~F.coalesce(emptied, F.lit(False)))
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return one_per_component(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the text that they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_round_trip(docs, vocabulary, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe),
]

# Rules are learned, lines and documents are linked by chains, tokens are merged: none of it is SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark), small_batches(spark):
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), lasting=True)
    return docs
