"""The corpus pipeline: documents -> clean, distinct, mixed and packed training documents.

Each stage works on all that its predecessor kept and is written as Parquet in the
shared folder before the next one reads it, so a lost executor repeats tasks of one
stage.  Rows may repeat, any column may be NULL, texts may be empty and other columns
may be present; they pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heatloom.llm import budget_mix, length_buckets, nb_toxicity, pairwise_quality, partenum
from heatloom.llm.common import table, word_count
from heatloom.llm.queries import BUCKETS, MIX_EPOCHS, MIX_SHARE, MIX_WEIGHTS, TOKEN_BUDGET
from heatloom.operators.rundir import stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: drops the documents that the classifier, fitted on the labels of ``docs``, calls toxic."""
    return nb_toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: drops the documents that score below the threshold."""
    return pairwise_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group stays, the one with the smallest doc_id."""
    return partenum.keep_one_per_class(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents as often as the mix takes them, the one at a source's cut in part."""
    return budget_mix.repeat_taken(budget_mix.mix_sources(docs, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: bucket, batch and place of every row of the mix."""
    return length_buckets.pack_documents(docs, word_count(F.col("text")), BUCKETS, TOKEN_BUDGET)


STAGES = [
    ("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing),
]

#: The classifiers and the similarity join have no SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table to packed documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
