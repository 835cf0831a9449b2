"""A training corpus from ``documents``: filters, near-duplicates, decontamination, packing.

Every stage calls one operator of :mod:`quillscope.llm` on all that the stage
before kept; stages are written as Parquet and read again.  A stage with no
row returns no row; documents without text are rejected by the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillscope.llm import decontaminate, hilbert_pack, language_id, quality_knn, simhash
from quillscope.llm.components import checkpoint_folder
from quillscope.session import ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or without a likely language."""
    ship_package(spark)
    return language_id.keep_identified(docs, language_id.fit(language_id.training_rows(docs)))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose labelled neighbours vote for low quality."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_knn.keep_good(docs, quality_knn.fit(docs, quality_knn.training_labels(labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id."""
    ship_package(spark)
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark window."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    ship_package(spark)
    return hilbert_pack.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; stages are kept in the shared folder of spark.checkpoint.dir."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
