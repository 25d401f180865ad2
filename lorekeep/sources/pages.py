"""Page and text scans, and the outcome of fetches recorded in a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as tx

MAX_ATTEMPTS = 2


def page_scan(raw: DataFrame, content: str = "content", url: str = "url") -> DataFrame:
    """Crawl snapshot with binary bodies to (url, html); undecodable bytes are left out."""
    return raw.select(F.col(url).alias("url"), tx.decode_utf8(F.col(content)).alias("html"))


def file_scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files as bytes, one row per file: path, content. ``path`` may hold a glob of folders; ``glob`` filters file names at the listing,
    so that other files are never opened. Files of no bytes have no row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def binary_pages(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Stored page files as (url, html), the file path standing for the URL."""
    return page_scan(file_scan(spark, path, glob), content="content", url="path")


def text_scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Plain text files, one row per file: url, text; undecodable bytes are left out."""
    return binary_pages(spark, path, glob).withColumnRenamed("html", "text")


def outcome_class(status: Column, error: Column) -> Column:
    return (
        F.when(status == 403, "bot_protected")
        .when(status.between(200, 399), "ok")
        .when(status.isNotNull(), "http_error")
        .when(error == "timeout", "timeout")
        .otherwise("error")
    )


def fetch_outcome(log: DataFrame, key: list[str], max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Outcome per fetched key from a log of (key, attempt, status, error).

    Success, bot protection and unclassified errors end the attempts; server errors and timeouts are
    tried again up to ``max_attempts``. Only minima and maxima are kept, so a key with very many
    attempts is reduced before the shuffle.
    """
    tried = log.filter(F.col("attempt") <= max_attempts)
    kind = outcome_class(F.col("status"), F.col("error"))
    fact = F.struct(F.col("attempt"), kind.alias("outcome"), F.col("status"))
    final = kind.isin("ok", "bot_protected", "error")
    best = tried.groupBy(*key).agg(
        F.coalesce(F.min(F.when(final, fact)), F.max(fact)).alias("_f")
    )
    return best.select(
        *key,
        F.col("_f.outcome").alias("outcome"),
        F.col("_f.status").alias("status"),
        F.col("_f.attempt").alias("attempts"),
    )


def retry_delay(attempt: Column) -> Column:
    """Seconds to wait after a failed attempt (1-based) that is tried again."""
    return F.pow(F.lit(2.0), attempt - 1)
