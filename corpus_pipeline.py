"""Corpus pipeline: quality rules, near-duplicate join, substring dedup, secret scans, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ngramjoin, packing, quality, secret_scan, substring
from tidemark.llm.common import Tables, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the classifier go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest id stays."""
    return ngramjoin.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that also start earlier are taken out of the texts."""
    return substring.strip(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: Not SQL: a trained classifier, decoding and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; of the tables in between only the last is kept, as long as the next stage needs it."""
    docs = table(spark, sf_dir, "documents")
    with Tables() as tables:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            tables.clear_but_last(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
