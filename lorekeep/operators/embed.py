"""Embedding through a pluggable, vectorised model function."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.chunking import EMBED_BATCH
from lorekeep.schemas import VECTOR_DIM

Embedder = Callable[[list[str]], np.ndarray]
_WORDS = re.compile(r"\w+")
# Words whose codes a task remembers.
WORD_MEMORY = 1 << 17
# Vectors of an output batch.
OUT_ROWS = 1000


def word_code(word: str) -> int:
    """The first 32 bits of a word's MD5, which SQL engines have as well."""
    return int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4])


def hashing_embedder(dim: int = VECTOR_DIM) -> Callable[[], Embedder]:
    """Offline default: signed feature hashing of lower-cased words, scaled to unit length."""
    memory = WORD_MEMORY

    def build() -> Embedder:
        codes_of: dict[str, int] = {}

        def code(word: str) -> int:
            found = codes_of.get(word)
            if found is None:
                if len(codes_of) >= memory:
                    codes_of.clear()
                found = codes_of[word] = word_code(word)
            return found

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in enumerate(texts):
                seen = _WORDS.findall(text.lower())
                if not seen:
                    continue
                codes = np.fromiter(map(code, seen), np.int64, len(seen))
                signs = np.where((codes >> 31) & 1, 1.0, -1.0)
                out[row] = np.bincount(codes % dim, weights=signs, minlength=dim)
                norm = math.sqrt(float((out[row].astype(np.float64) ** 2).sum()))
                if norm:
                    out[row] /= norm
            return out

        return embed

    return build


def _vectors(rows: list[np.ndarray | None]) -> pa.Array:
    known = [r for r in rows if r is not None]
    ends = np.cumsum([0] + [0 if r is None else len(r) for r in rows], dtype=np.int32)
    flat = np.concatenate(known) if known else np.zeros(0, np.float32)
    missing = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float32()), mask=missing)


def embed(
    text: Column,
    model: Callable[[], Embedder] | None = None,
    batch: int = EMBED_BATCH,
    on_error: str = "abort",
) -> Column:
    """Vector of each text. ``model`` is built once per worker task and called with at most
    ``batch`` texts at a time. ``on_error='skip'`` gives null for texts the model fails on, trying
    a failed batch again text by text."""
    build = model or hashing_embedder()

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = build()

        def guarded(texts: list[str]) -> list[np.ndarray | None]:
            try:
                return list(np.asarray(call(texts), dtype=np.float32))
            except Exception:
                if on_error != "skip":
                    raise
                if len(texts) == 1:
                    return [None]
                return [vector for text in texts for vector in guarded([text])]

        for whole in batches:
            # Vectors are far wider than texts: they leave in parts, not one batch of as many as texts came.
            for begin in range(0, max(len(whole), 1), OUT_ROWS):
                texts = whole.slice(begin, OUT_ROWS).to_pylist()
                given = [i for i, t in enumerate(texts) if t is not None]
                out: list[np.ndarray | None] = [None] * len(texts)
                for at in range(0, len(given), batch):
                    spot = given[at : at + batch]
                    for i, vector in zip(spot, guarded([texts[i] for i in spot])):
                        out[i] = vector
                yield _vectors(out)

    return run.asNondeterministic()(text)


def embed_chunks(
    chunks: DataFrame,
    model: Callable[[], Embedder] | None = None,
    text: str = "text",
    on_error: str = "abort",
) -> DataFrame:
    """Adds ``embedding``; with ``on_error='skip'`` rows the model fails on are left out."""
    embedded = chunks.withColumn("embedding", embed(F.col(text), model, on_error=on_error))
    return embedded.filter(F.col("embedding").isNotNull()) if on_error == "skip" else embedded


def attach_vectors(chunks: DataFrame, vectors: DataFrame, on: str | list[str]) -> DataFrame:
    """Pairs chunks with precomputed vectors by key."""
    return chunks.join(vectors, on)
