"""A corpus in stages, each over all that the one before kept; every stage's result is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vellumlake.llm import omh, packing, pii, quality, wumanber
from vellumlake.llm.scratch import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the isolation forest, calibrated on the labels, doesn't find anomalous."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return omh.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return wumanber.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with identifiers replaced by their kind."""
    return pii.masked(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii_masking", pii_masking),
    ("sequence_packing", sequence_packing),
]
ORACLE_SQL = None  # a forest, sketches and a linear program: tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
