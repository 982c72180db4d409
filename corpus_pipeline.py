"""Corpus pipeline: toxicity, quality rules, near-duplicate join, repeated passages, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and reread as the next stage's documents. All stages but the
last return the columns of ``documents``.

Null and empty texts: kept by the toxicity stage (nothing toxic in them), rejected by the quality
rules (no words). Repeated rows: one stays after the join. Empty tables: every stage returns no rows.
Columns beyond those of ``documents`` pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm import jaccard_join, packing, quality_rules, repeats, toxicity
from stepwise.llm.common import ship_package, stored, table
from stepwise.llm.queries import vocabulary


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar accepts (learned from the labelled training fold)."""
    ship_package(spark)
    return toxicity.accepted(docs, toxicity.train_grammar(docs, table(spark, sf_dir, "labels")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.accepted(docs)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    ship_package(spark)
    return jaccard_join.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier place holds."""
    ship_package(spark)
    return repeats.without_repeated_text(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in training sequences."""
    ship_package(spark)
    cut = packing.token_pieces(docs, vocabulary("word_bpe_49k.json"))
    return packing.pack(stored(cut.withColumn("ids_crc32", F.crc32("ids")), "pieces"))


STAGES = [("toxicity", non_toxic), ("quality_rules", good_quality), ("ngram_jaccard_join", one_per_group),
          ("suffix_dedup", without_repeats), ("packing", packed)]
#: learned scores, verified links, byte-wise passes and tokens have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
