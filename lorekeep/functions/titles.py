"""Chunk titles and the metadata document stored next to each entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.text import strip
from lorekeep.schemas import METADATA

UNTITLED = "Untitled Document"
TITLE_WIDTH = 255
FIRST_LINE_WIDTH = 50


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def title_hierarchical(headings: Column, filename: Column, text: Column) -> Column:
    """Last two headings joined, else the file name, else the start of the first line."""
    depth = F.coalesce(F.size(headings), F.lit(0))
    first_line = F.left(strip(F.substring_index(text, "\n", 1)), F.lit(FIRST_LINE_WIDTH))
    chosen = (
        F.when(depth > 1, F.array_join(F.slice(headings, -2, 2), " > "))
        .when(depth == 1, F.element_at(headings, 1))
        .when(filename != "", filename)
        .otherwise(first_line)
    )
    return F.coalesce(_filled(F.left(chosen, F.lit(TITLE_WIDTH))), F.lit(UNTITLED))


def title_simple(headings: Column, filename: Column) -> Column:
    """First heading, else the file name."""
    depth = F.coalesce(F.size(headings), F.lit(0))
    chosen = F.when(depth > 0, F.element_at(headings, 1)).otherwise(filename)
    return F.coalesce(_filled(F.left(chosen, F.lit(TITLE_WIDTH))), F.lit(UNTITLED))


def page_numbers(page_nos: Column) -> Column:
    """Sorted distinct page numbers; null for a chunk without items, empty if none carries one."""
    return F.when(
        page_nos.isNotNull() & (F.size(page_nos) > 0),
        F.array_sort(F.array_distinct(F.array_compact(page_nos))),
    )


def metadata_json(
    source_url: Column,
    filename: Column,
    page_nos: Column,
    headings: Column,
    chunk_index: Column,
    total_chunks: Column,
    **extra: Column,
) -> Column:
    """Metadata as JSON text with null fields kept; ``extra`` adds fields such as ``loaded_at``."""
    fields = [
        source_url.alias("source_url"),
        F.coalesce(filename, F.lit("unknown")).alias("filename"),
        page_numbers(page_nos).alias("page_numbers"),
        F.when(F.size(headings) > 0, F.element_at(headings, 1)).alias("original_title"),
        chunk_index.cast("int").alias("chunk_index"),
        total_chunks.cast("int").alias("total_chunks"),
    ]
    fields += [column.alias(name) for name, column in extra.items()]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def metadata_read(metadata: Column, schema=METADATA) -> Column:
    return F.from_json(F.coalesce(metadata, F.lit("{}")), schema)


def metadata_value(metadata: Column, key: str, as_type: str = "string") -> Column:
    """One open-ended key of a metadata document."""
    return F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", as_type)
