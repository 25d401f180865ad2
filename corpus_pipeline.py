"""The corpus pipeline: documents in, token ids out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import stages
from lorekeep.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", stages.keep_good),
    ("simhash_near_dedup", stages.one_of_each),
    ("substring_dedup", stages.without_repeats),
    ("benchmark_decontamination", stages.without_benchmark),
    ("byte_bpe", stages.tokens),
]

#: SQL can't express the classifier, SimHash components or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
