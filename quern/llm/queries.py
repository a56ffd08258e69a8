"""The queries op1 to op10 and their SQL; each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import decontam, html_extract, jaccard_join, lm_scoring, mixing, oracles, sharding, substring_dedup, token_counts, topk, toxicity
from .shared import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections: the lines of each document; a token belongs to the line of its first byte."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), rule="start", carry=["doc_id"])
    return counted.select("doc_id", "n_tokens", "n_sections", "n_crossing", F.transform("section_tokens", lambda x: x.cast("long")).alias("section_tokens"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return placed.select("doc_id", "size", F.coalesce("text_crc32", F.lit(0)).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled rows that aren't held out, within toxicity.Bounds."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.score_documents(documents, model, carry=["doc_id"]).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, threshold=75)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), k=20)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), cap=3).select("doc_id", "size", "source_size", "target", "taken")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages), carry=["page_id", "url"])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=10, carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats_digest(table(spark, sf_dir, "documents"), length=35)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the turns of all conversations; background: all documents."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text")
    scored = lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), turns)
    return scored.select("doc_id", "n_words", "n_unknown", *(F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_toxicity, op4_ngram_jaccard, op5_exact_top_k, op6_mixing, op7_html_extraction, op8_decontamination, op9_substring_dedup, op10_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that it can express; the others are tested against brute force or held-out rows."""
    return {name: oracles.SQL[n] for name in queries() if (n := int(name[2:].split("_")[0])) in oracles.SQL}
