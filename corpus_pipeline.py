"""Corpus pipeline: raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but
the last return the columns of ``docs``. Between stages the rows are written as Parquet. Texts go
to Python in small Arrow batches (``small_batches``), for which a setting of the session may change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.arrays import small_batches
from textloom.llm.decontam import drop_contaminated
from textloom.llm.jaccard import keep_one_of_each
from textloom.llm.packing import pack
from textloom.llm.queries import table, tokenizer_path
from textloom.llm.secret_scan import redact_secrets
from textloom.llm.toxicity import drop_toxic
from textloom.sources.scratch import settle


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labelled documents of this input."""
    small_batches(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    small_batches(spark)
    return keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of benchmark items go."""
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark."""
    small_batches(spark)
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all texts with their sequence and offset."""
    small_batches(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: A learned classifier has no SQL; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
