"""A cleaning pipeline over documents: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), where docs is the result of the stage before, written as Parquet and read again,
and returns a DataFrame; all but the last return the columns of documents. As a stage's input is written when it begins,
a stage first deletes the scratch tables of the one before. Workers live through all stages, so batches are kept small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factgrid.llm import decontam, jaccard, linededup, packing, quality
from factgrid.llm.common import release, small_batches, table, work_dir

_SCOPE = "pipeline"


def begin(spark: SparkSession) -> None:
    release(spark, _SCOPE)
    small_batches(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    begin(spark)
    return quality.filtered(docs, table(spark, sf_dir, "labels"), scope=_SCOPE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one of them; all documents stay."""
    begin(spark)
    return linededup.filtered(docs, scope=_SCOPE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    begin(spark)
    return jaccard.filtered(docs, k=5, percent=80, scope=_SCOPE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    begin(spark)
    return decontam.filtered(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, and their places in sequences."""
    begin(spark)
    return packing.sequences(docs, scope=_SCOPE)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Certified cutoffs, tokenizer ids and a genetic algorithm have no SQL form: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{work_dir(spark)}/stage{k}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
