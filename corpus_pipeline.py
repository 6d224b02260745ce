"""The corpus pipeline: STAGES in order over `documents`, each stage's rows written and read again before the next.

A stage is a function of (spark, docs, sf_dir).  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievestone.llm import packing, quality_gam, rules, secrets, simhash
from sievestone.session import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's bands go."""
    return rules.keep_by_rules(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go; the model learns from all labelled documents outside the held-out fold."""
    model = quality_gam.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_gam.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; every document stays."""
    return secrets.redact(docs)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and place, by its tokens."""
    return packing.pack(packing.token_lengths(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", packing_plan),
]

#: The classifier's model and the tokeniser's ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
