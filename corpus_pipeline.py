"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurosheaf.llm import bpe, decontaminate, kneser_ney, quality_rules, similar
from neurosheaf.llm.common import read, remove, shared_dir
from neurosheaf.session import ship

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    ship(spark)
    return kneser_ney.keep(docs, read(spark, sf_dir, "labels")).select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs of their language, or of all languages where theirs has too few labels."""
    judged = quality_rules.judge(docs, read(spark, sf_dir, "labels"), pooled=True)
    return judged.where("kept").select(docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near copies: SimHash finds them, five-word Jaccard similarity of 0.8 or more verifies them."""
    ship(spark)
    return similar.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    ship(spark)
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document left, and whether they decode to its text."""
    ship(spark)
    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    encoded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_filter),
    ("simhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", tokenisation),
]

#: Neither the language model, the fingerprints nor the merges can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents. What a stage wrote to the shared folder goes when the next one's stands."""
    docs, folder, before = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
