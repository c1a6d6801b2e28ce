"""Corpus preparation over the documents table: five stages, each on all that the one before
kept. A stage takes (spark, docs, sf_dir) and returns the columns of documents (the last adds
none either: a document stands as often as the mix takes it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ranklode.llm import decontam, mixing, ngram_join, quality, secrets
from ranklode.session import clean, cut, forget, made, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier rule reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become a mark; all documents stay."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate takes it."""
    return mixing.emit(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources", mixture),
]

#: The outlier rule and the entropy windows have no SQL; tests/llm holds the pipeline against
#: its operators and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written; what it wrote on the way, and its input, goes then."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        since, before, docs = made(), docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage")
            clean(spark, since, docs)
            forget(before)
    return docs
