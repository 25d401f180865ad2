"""Declared schemas of the stored tables and the nested document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# The allowed members of the three constrained columns.
SOURCE_TYPES = ("website", "pdf", "document", "text")
CATEGORIES = ("website", "faq", "policy", "pricing", "procedure", "technical")
STATUSES = ("pending", "loading", "loaded", "failed", "inactive")

# Fixed value: width of a stored vector.
VECTOR_DIM = 1536

SOURCES = StructType(
    [
        StructField("id", StringType(), False),
        StructField("business_id", StringType(), False),
        StructField("source_url", StringType(), False),
        StructField("source_type", StringType(), False),
        StructField("category", StringType(), False),
        StructField("description", StringType()),
        StructField("crawl_internal", BooleanType()),
        StructField("status", StringType(), False),
        StructField("last_loaded_at", TimestampType()),
        StructField("error_message", StringType()),
        StructField("entry_count", IntegerType()),
        StructField("is_active", BooleanType()),
        StructField("created_at", TimestampType()),
        StructField("updated_at", TimestampType()),
    ]
)

ENTRIES = StructType(
    [
        StructField("id", StringType(), False),
        StructField("business_id", StringType(), False),
        StructField("category", StringType(), False),
        StructField("title", StringType(), False),
        StructField("content", StringType(), False),
        StructField("embedding", ArrayType(FloatType())),
        StructField("metadata", StringType()),
        StructField("source_id", StringType()),
        StructField("is_active", BooleanType()),
        StructField("created_at", TimestampType()),
        StructField("updated_at", TimestampType()),
    ]
)

METADATA = StructType(
    [
        StructField("source_url", StringType()),
        StructField("filename", StringType()),
        StructField("page_numbers", ArrayType(IntegerType())),
        StructField("original_title", StringType()),
        StructField("chunk_index", IntegerType()),
        StructField("total_chunks", IntegerType()),
    ]
)

# A block is one heading, paragraph, list item or table of a document, in reading order.
BLOCK_DDL = "struct<ix:int,kind:string,level:int,headings:array<string>,page_no:int,text:string>"
BLOCKS_DDL = f"array<{BLOCK_DDL}>"
CHUNK_DDL = "struct<chunk_ix:int,text:string,headings:array<string>,page_nos:array<int>,n_tokens:int>"
CHUNKS_DDL = f"array<{CHUNK_DDL}>"


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
