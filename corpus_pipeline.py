"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and works on all that the one before it kept.

All but the last return the columns of ``documents``. ``run`` writes each stage's result to the shared folder and
reads it again for the next, so a lost executor costs at most the stage at hand; a result is deleted once the next one
stands.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import decontamination, exact_dedup, jaccard_join, language_id, piece_codec
from tabulon.llm.common import read, remove, shared_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return language_id.identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts stays: the longest, then the smallest id."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest id."""
    return jaccard_join.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item stay."""
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and whether they read back to the text."""
    return piece_codec.round_trip(docs).select("doc_id", "ids", "n_ids", "round_trip")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("sentencepiece", encode_stage),
]

#: SQL cannot express the language, near-duplicate and encoding stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages, applied to ``documents``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
