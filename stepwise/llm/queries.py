"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversations, fingerprints, hilbert_shards, html_text, jaccard_join, packing, pieces, quality_rules, repeats, spelling,
               token_counts, toxicity, url_filter)
from .common import ship_package, stored, table


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer's file; ``folder`` defaults to the installed package's."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("h")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    path = vocabulary("piece_bpe_32k.model")
    both = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                       (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                       (F.col("decoded") == F.replace("text", F.lit(pieces.MARK), F.lit(" "))).alias("round_trip"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert_shards.shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "cell")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    cut = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    cut = stored(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return conversations.repair_report(conversations.damage(table(spark, sf_dir, "conversations"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    budget = 512
    counted = token_counts.totals(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), budget)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), "n_chars", "fit_chars")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_document_fingerprints, op3_html_extraction, op4_url_filter, op5_quality_rules, op6_sentencepiece, op7_toxicity,
                              op8_sharding, op9_packing, op10_ngram_jaccard_join, op11_conversation_repair, op12_spelling_variants, op13_token_counts)
}
ORACLES: dict[str, str] = {}
