"""The whole way in one plan: pages, cleaned, gated, chunked, titled, embedded, then searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import ids, titles
from lorekeep.functions import urls as ux
from lorekeep.operators import chunking, embed, html
from lorekeep.plans import ask
from lorekeep.session import spread


def page_entries(pages: DataFrame) -> DataFrame:
    """Entries of all pages under one tenant per language folder of the URL."""
    docs = html.read_documents(pages.select("url", "html"))
    chunks = chunking.chunk_documents(docs)
    name = ux.file_name(F.col("url"))
    rows = chunks.select(
        ids.stable_id(F.col("url"), F.col("chunk_ix")).alias("id"),
        F.element_at(F.split(ux.path(F.col("url")), "/"), 2).alias("business_id"),
        F.lit("website").alias("category"),
        titles.title_hierarchical(F.col("headings"), name, F.col("text")).alias("title"),
        F.col("text").alias("content"),
        titles.metadata_json(F.col("url"), name, F.col("page_nos"), F.col("headings"), F.col("chunk_ix") + 1, F.lit(None).cast("int")).alias("metadata"),
        F.lit(True).alias("is_active"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    return embed.embed_chunks(rows, text="content")


def titles_against_pages(spark: SparkSession, folder: str, threshold: float = 0.3) -> DataFrame:
    pages = spread(spark.read.parquet(f"{folder}/pages.parquet"))
    entries = page_entries(pages)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    asked = pages.select(
        F.col("page_id").alias("question_id"),
        F.element_at(F.split(ux.path(F.col("url")), "/"), 2).alias("business_id"),
        title.alias("question"),
    )
    found = ask.query_knowledge(entries, asked, threshold)
    return found.select("question_id", "hit_rank", "id", "title", F.round("similarity", 6).alias("similarity"), "metadata")
