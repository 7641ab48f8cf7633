"""One query per operator, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.bpe import bpe_round_trip
from orderloom.llm.collocations import collocations
from orderloom.llm.decontaminate import contaminated_pairs
from orderloom.llm.html_text import extract_text
from orderloom.llm.line_dedup import dedup_lines
from orderloom.llm.merkle import merkle_manifest
from orderloom.llm.ngram_join import ngram_components
from orderloom.llm.quality_rules import STATISTICS, learn_rules, score_quality
from orderloom.llm.rank_bpe import rank_round_trip
from orderloom.llm.sharding import proportional_shards
from orderloom.llm.toxicity import fit_toxicity, held_out, score_toxicity
from orderloom.llm.url_filter import filter_urls, mine_rules
from orderloom.llm.warc import archive_pages
from orderloom.session import staging_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    placed = ngram_components(table(spark, folder, "documents"), n=3, percent=90)
    return placed.select("doc_id", "n_shingles", "component_id")


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    archived = archive_pages(table(spark, folder, "pages"), staging_path(spark, "archives"))
    return archived.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_round_trip(table(spark, folder, "documents"), vocabulary)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_toxicity(docs, table(spark, folder, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "toxic",
    )


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = learn_rules(docs, table(spark, folder, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), rules)
    return scored.select("doc_id", *STATISTICS, "base_failed", "kept", "reason")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = proportional_shards(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated_pairs(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return filter_urls(pages, mine_rules(pages, table(spark, folder, "labels")))


def op11_rank_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return rank_round_trip(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents")).drop("words")


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    without_breaks = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = merkle_manifest(table(spark, folder, "documents"), claims={"text": without_breaks})
    return manifest.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_sharding": op7_sharding,
    "op8_html_text": op8_html_text,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filter": op10_url_filter,
    "op11_rank_bpe": op11_rank_bpe,
    "op12_collocations": op12_collocations,
    "op13_merkle": op13_merkle,
}
