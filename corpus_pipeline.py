"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents. The result of a stage is written as Parquet and read again as the next one's input.

* ``quality`` drops the documents that the classifier rejects.
* ``near_duplicates`` keeps the smallest doc_id of each class of near duplicates.
* ``decontamination`` drops documents that hold a test item.
* ``secrets`` masks secrets in the texts; every document stays, n_chars follows the new text.
* ``packing`` places every document in training sequences: doc_id, piece, bin_id, position, start_word, n_words.

Null and empty texts pass all stages (unless the classifier rejects empty texts) and are packed as pieces of no words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import save, table
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.near_duplicates import drop_near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import THRESHOLD, classify
from tidemark.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = classify(docs, table(spark, sf_dir, "labels"), into="__score")
    return scored.where(F.col("__score") >= THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]
#: The classifier is trained, so no SQL gives these rows; a test runs plain versions of the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
