"""Chunking: packing per document, the tiny-chunk filter, and chunk numbering per source."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import packing
from lorekeep.functions import text as tx
from lorekeep.operators.numbering import running_sums
from lorekeep.schemas import CHUNKS_DDL
from lorekeep.session import cut_lineage

MAX_TOKENS = 512
MIN_CHUNK_WORDS = 15
EMBED_BATCH = 100

_COUNTERS = {"token": packing.symbol_tokens, "word": packing.word_tokens}


def _documents(documents: pa.Array) -> Iterator[Iterator[tuple] | None]:
    """Block tuples of each document, taken column by column out of the nested array."""
    blocks = documents.values
    names = ("kind", "level", "headings", "page_no", "text")
    columns = [blocks.field(name).to_pylist() for name in names]
    starts = documents.offsets.to_pylist()
    for i, valid in enumerate(documents.is_valid().to_pylist()):
        yield zip(*[column[starts[i] : starts[i + 1]] for column in columns]) if valid else None


def _chunk_array(placed: list[tuple[int, packing.Chunk]], ends: list[int], whole: list[bool]) -> pa.Array:
    places, chunks = [ix for ix, _ in placed], [chunk for _, chunk in placed]
    columns = [
        pa.array(places, pa.int32()),
        pa.array(["\n".join(c.texts) for c in chunks], pa.string()),
        pa.array([c.headings for c in chunks], pa.list_(pa.string())),
        pa.array([c.pages for c in chunks], pa.list_(pa.int32())),
        pa.array([c.tokens for c in chunks], pa.int32()),
    ]
    rows = pa.StructArray.from_arrays(columns, ["chunk_ix", "text", "headings", "page_nos", "n_tokens"])
    missing = pa.array([not ok for ok in whole], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=missing)


def pack_blocks(
    blocks: Column,
    max_tokens: int = MAX_TOKENS,
    merge_peers: bool = True,
    counter: str | packing.TokenCounter = "token",
    min_words: int = 0,
) -> Column:
    """Blocks of one document to its array of chunks of at least ``min_words`` words. A document that
    fails gives null."""
    count = _COUNTERS[counter] if isinstance(counter, str) else counter

    @F.arrow_udf(CHUNKS_DDL)
    def run(documents: pa.Array) -> pa.Array:
        ends, whole, found = [0], [], []
        for document in _documents(documents):
            packed = None
            try:
                if document is not None:
                    packed = packing.pack(document, max_tokens, merge_peers, count)
                    packed = [(ix, c) for ix, c in enumerate(packed) if c.n_words() >= min_words]
            except Exception:
                logging.getLogger(__name__).exception("document skipped in chunking")
            whole.append(packed is not None)
            found += packed or []
            ends.append(len(found))
        return _chunk_array(found, ends, whole)

    return run.asNondeterministic()(blocks)


def chunk_documents(
    docs: DataFrame,
    max_tokens: int = MAX_TOKENS,
    merge_peers: bool = True,
    min_chunk_words: int = MIN_CHUNK_WORDS,
    counter: str | packing.TokenCounter = "token",
) -> DataFrame:
    """One row per kept chunk: the document's other columns plus chunk_ix, text, headings, page_nos,
    n_tokens. There is no shuffle: every document is one row and is packed where it is read."""
    return explode_chunks(docs, max_tokens, merge_peers, counter, min_chunk_words)


def explode_chunks(
    docs: DataFrame,
    max_tokens: int = MAX_TOKENS,
    merge_peers: bool = True,
    counter: str | packing.TokenCounter = "token",
    min_words: int = 0,
) -> DataFrame:
    """All chunks of all documents, duplicates kept; by default before the tiny-chunk filter."""
    packed = docs.withColumn("_chunks", pack_blocks(F.col("blocks"), max_tokens, merge_peers, counter, min_words))
    others = [c for c in docs.columns if c != "blocks"]
    return packed.select(*others, F.inline("_chunks"))


def drop_tiny(chunks: DataFrame, min_words: int = MIN_CHUNK_WORDS, text: str = "text") -> DataFrame:
    return chunks.filter(tx.word_count(F.col(text)) >= min_words)


def floor_average(total: Column, count: Column) -> Column:
    return F.when(count > 0, F.floor(total / count)).otherwise(F.lit(0)).cast("bigint")


def _stats(min_words: int, text: str) -> list[Column]:
    n = tx.word_count(F.col(text))
    kept = n >= min_words
    return [
        F.count_if(kept).alias("chunks_kept"),
        F.count_if(~kept).alias("chunks_filtered"),
        floor_average(F.sum(F.when(kept, n)), F.count_if(kept)).alias("avg_words"),
    ]


def chunk_stats(chunks: DataFrame, by: list[str], min_words: int = MIN_CHUNK_WORDS, text: str = "text") -> DataFrame:
    """Chunks kept and filtered with the floor-average words, per document or (``by=[]``) overall."""
    return chunks.groupBy(*by).agg(*_stats(min_words, text))


def number_chunks(
    docs: DataFrame,
    group: list[str],
    unit: str,
    key: str,
    chunks: str = "chunks",
    chunk: str = "chunk",
    index: str = "chunk_index",
    total: str = "total_chunks",
) -> DataFrame:
    """Each element of the array ``chunks`` as a row (column ``chunk``), with its 1-based position and the row count within
    ``group``. ``key`` tells the rows of ``docs`` apart and is not null.

    Only (group, unit, key, size) is ordered and summed up; the texts meet their document's first position and are exploded, with
    no sort or window over them. Documents come in the order of the first 16 bits of the hash of ``unit``, then
    ``unit`` and ``key``, the same on every retry.
    """
    spot = F.substring(F.md5(F.col(unit).cast("string")), 1, 4)
    sizes = docs.select(F.struct(*group).alias("_group"), spot.alias("_spot"), F.col(unit).alias("_unit"), F.col(key).alias("_key"), F.size(chunks).alias("_n"))
    summed = running_sums(cut_lineage(sizes.filter("_n > 0")), ["_group"], ["_spot", "_unit", "_key"], "_n", "_first", total)
    starts = summed.select(F.col("_key").alias(key), "_first", total)
    others = [c for c in docs.columns if c != chunks]
    exploded = docs.join(starts, key).select(*others, total, "_first", F.posexplode(chunks).alias("_at", chunk))
    return exploded.select(*others, chunk, (F.col("_first") + F.col("_at") + 1).alias(index), total)


def embed_batches(numbered: DataFrame, size: int = EMBED_BATCH) -> DataFrame:
    """Batch number of each chunk, the last index in that batch, and progress in percent."""
    batch = F.floor((F.col("chunk_index") - 1) / size)
    end = F.least((batch + 1) * size, F.col("total_chunks"))
    return numbered.withColumns(
        {
            "batch_no": batch.cast("bigint"),
            "batch_end": end.cast("bigint"),
            "progress": end / F.col("total_chunks") * 100.0,
        }
    )
