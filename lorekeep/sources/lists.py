"""Source lists: parsing, de-duplication, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.functions import urls as ux


def split_sources(listing: Column) -> Column:
    """Comma-separated text to an array of trimmed, non-blank sources."""
    return F.filter(F.transform(F.split(listing, ","), tx.strip), lambda s: s != "")


def source_list(rows: DataFrame, listing: str, keep: list[str] | None = None) -> DataFrame:
    """One row per source: the ``keep`` columns, seq (from 0), source_url."""
    return rows.select(*(keep or []), F.posexplode(split_sources(F.col(listing))).alias("seq", "source_url"))


def parse_sources(spark: SparkSession, sources: list[str] | str) -> DataFrame:
    """Source list of one call. Text is split at commas and trimmed; a list is taken as it is.

    An empty list is an error when the frame is made.
    """
    if isinstance(sources, str):
        sources = [part.strip() for part in sources.split(",") if part.strip()]
    if not sources:
        raise ValueError("at least one source is needed")
    return spark.createDataFrame(list(enumerate(sources)), "seq int, source_url string")


def require_rows(rows: DataFrame, array: str) -> DataFrame:
    """Fails the job on a row whose parsed list is empty."""
    check = F.assert_true(F.size(array) > 0, F.lit("at least one source is needed"))
    return rows.filter(check.isNull())


def distinct_sources(sources: DataFrame, source: str = "source_url") -> DataFrame:
    return sources.select(source).distinct()


def route(sources: DataFrame, source: str = "source_url") -> DataFrame:
    """Adds source_type and route: ``html`` for websites fetched as pages, ``file`` for what a text
    reader accepts, ``quarantine`` for formats no reader here decodes."""
    kind = ux.source_type(F.col(source))
    way = (
        F.when(kind.isin("pdf", "document"), "quarantine")
        .when(ux.is_http(F.col(source)), "html")
        .otherwise("file")
    )
    return sources.withColumns({"source_type": kind, "is_http": ux.is_http(F.col(source)), "route": way})


def union_sources(sources: DataFrame, discovered: DataFrame) -> DataFrame:
    """Distinct union of listed and discovered URLs."""
    return sources.unionByName(discovered).distinct()
