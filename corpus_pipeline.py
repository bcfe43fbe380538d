"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read
again as the next stage's docs. All stages but the last return the columns of documents.

Null and empty texts fail the quality rules, so later stages see none; null ids and repeated rows are told apart by no
stage and stay or go by their texts (near duplicates: rows without an id stay; rows that share an id are one document).
Empty tables give empty results; further columns of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.op1_decontamination import drop_contaminated
from tallyloom.llm.op2_secrets import redact_secrets
from tallyloom.llm.op6_packing import pack_documents
from tallyloom.llm.op8_quality import keep_quality
from tallyloom.llm.op9_jaccard import keep_one_of_each
from tallyloom.llm.shared import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a plain rule or the outlier test of their language and source rejects go."""
    return keep_quality(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents tied by 5-word shingles at a similarity of 0.8, the one with the smallest id stays."""
    return keep_one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also edited, go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; documents stay."""
    return redact_secrets(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, in sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: the stages use tokens, estimates and iterations that SQL can't express; tests hold each against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
