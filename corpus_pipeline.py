"""Filtering and mixing a document table in stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on everything its predecessor kept.
All but the last return the columns of ``documents``. :func:`run` writes each stage's result as Parquet in the
shared folder and reads it again for the next, so a lost executor costs at most one stage.

Rows are kept or dropped by doc_id: rows with a repeated id share their fate where a stage keeps one document
of a group, and rows with a null id are judged by their text like any other. Null texts count as empty. An
empty table passes through every stage. Columns beyond those of ``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, quality, secrets, simhash
from tidemark.session import collecting, discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject."""
    docs = docs.select(COLUMNS)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_quality(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the component's smallest id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no verified benchmark item."""
    items = decontaminate.split_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.filter_contaminated(docs, items)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are replaced by their kind in brackets, and n_chars counts the new text."""
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the columns of ``documents`` and ``copy``, numbered from 1."""
    return mixing.emit(docs, COLUMNS)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Fitting a model and scanning by patterns aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        made, kept = [], []
        with collecting(made):
            docs = materialize(stage(spark, docs, sf_dir), name, kept)
        # the stage's own tables and its input go once its result is written
        discard(spark, made + before)
        before = kept
    return docs
