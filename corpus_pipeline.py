"""Corpus pipeline: documents through quality rules, near-duplicate removal, benchmark decontamination, secret redaction and
mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next stage's
docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revspark.llm.common import materialise, table
from revspark.llm.decontaminate import drop_contaminated
from revspark.llm.jaccard_join import keep_first
from revspark.llm.mixing import TARGETS, label_domains, mix
from revspark.llm.quality import keep_good
from revspark.llm.secret_scan import redact
from revspark.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host's shrunk failure rate is too high, go."""
    ship_package(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported secret is replaced by a placeholder."""
    return redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets the rate at which it is to be drawn."""
    return mix(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Signature trees, an FM-index and a trained classifier are not SQL; tests hold each stage against plain Python.
ORACLE_SQL = None
