"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage is one operator of ``loomwork.llm`` applied to all that its
predecessor kept.  The first four return the columns of ``documents``; the last
returns the packed batches of what remains.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import decontamination, packing, quality, simhash, toxicity
from loomwork.llm.storage import shared_dir


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id."""
    return simhash.first_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' places in token-budget batches."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models, fingerprints and alignments can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the stages before it are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return found
        path = f"{shared_dir(spark)}/pipeline-{number}-{uuid.uuid4().hex}"
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
