"""The stages of the corpus pipeline: (spark, docs, folder of the tables) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import bpe, decontaminate, quality, simhash, substring
from lorekeep.llm.queries import public_vocabulary, table


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that importance resampling keeps, all columns. Null and empty texts are weighed by the calibration's constant;
    repeated rows stay or go together; an empty table gives an empty result."""
    return quality.keep_good(docs, table(spark, folder, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near duplicates by op5's contract (3-word shingles, 3 bits), the document of the smallest
    id. Texts that 5-word similarity alone calls alike stay (README). Null and wordless texts are alike, so one row of them
    stays; of repeated rows one stays; an empty table gives an empty result."""
    return simhash.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars follows the text where it changed.
    Null and empty texts stay as they are, repeated rows lose nothing to each other; an empty table gives an empty result."""
    cut = substring.remove_repeats(docs.withColumnRenamed("removed", "_removed"))
    if "n_chars" in docs.columns:
        shorter = F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", shorter.cast(docs.schema["n_chars"].dataType))
    return cut.drop("removed").withColumnRenamed("_removed", "removed").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no 10 words in a row of a benchmark item (of a shorter item: all its words). Null and empty texts
    stay, and so do all documents if the benchmark is empty; an empty table gives an empty result."""
    return decontaminate.keep_clean(docs, table(spark, folder, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids with their digests, and the digest of what they decode to. A null or empty text has no tokens; an
    empty table gives an empty result."""
    path, pattern = public_vocabulary()
    return bpe.round_trip(docs, path, pattern).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")
