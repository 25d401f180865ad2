"""Vector expressions. Pairs of columns are compared in the JVM; a column against one fixed vector
goes through a matrix product; batches of questions through ``operators.search``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType


def widths(vectors: pa.Array) -> np.ndarray:
    """Length of each vector of a list array, 0 for null."""
    return pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)


def units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of those that have a length, and which they are."""
    norm = np.sqrt((rows * rows).sum(axis=1))
    return rows[norm > 0] / norm[norm > 0, None], norm > 0


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, summed in double precision."""
    return np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))


def dense(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the usable vectors of a list array, and their positions. Null and zero vectors, and
    those of another length than ``width``, are left out."""
    at = np.flatnonzero(widths(vectors) == width)
    if not width or not len(at):
        return np.zeros((0, width)), at[:0]
    rows = np.asarray(vectors.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), width)
    unit, known = units(rows)
    return unit, at[known]


# What stands for a vector that is packed.
PACKED = StructType([StructField("width", IntegerType()), StructField("places", BinaryType()), StructField("values", BinaryType())])
# Vectors that are packed at a time.
PACK_ROWS = 1024


def _place_type(width: int) -> str:
    return "<u2" if width <= 1 << 16 else "<u4"


def packed(rows: DataFrame, element: str) -> DataFrame:
    """``rows`` with the fields of ``PACKED`` for ``embedding``, vectors of ``element`` ("<f4" or "<f8"): bytes of all values, or where
    most are zero those of the others and their places. Rows of null and empty vectors are left out.

    A function of batches, not of a column: that would keep the rows with their vectors in the JVM until their bytes are back.
    """
    kept = [f for f in rows.schema if f.name != "embedding"]
    schema = StructType([*kept, *PACKED])
    names, kinds = [f.name for f in kept], [to_arrow_type(f.dataType) for f in PACKED]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in (whole.slice(begin, PACK_ROWS) for begin in range(0, len(whole), PACK_ROWS)):
                sizes = widths(part.column("embedding"))
                for width in np.unique(sizes[sizes > 0]).tolist():
                    some = part.take(pa.array(np.flatnonzero(sizes == width)))
                    vectors = np.asarray(some.column("embedding").flatten(), dtype=element).reshape(len(some), width)
                    places, values = [], []
                    for row in vectors:
                        at = np.flatnonzero(row)
                        most = 2 * len(at) >= width
                        places.append(None if most else at.astype(_place_type(width)).tobytes())
                        values.append((row if most else row[at]).tobytes())
                    columns = [some.column(name) for name in names]
                    columns += [pa.array(column, kind) for column, kind in zip(([width] * len(some), places, values), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.mapInArrow(pack, schema)


def values(places: pa.Array, held: pa.Array, width: int, element: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each packed vector, the places of the values that are held, and these in double precision."""
    every = np.arange(width)
    for at, known in zip(places.to_pylist(), held.to_pylist(), strict=True):
        yield every if at is None else np.frombuffer(at, _place_type(width)).astype(np.int64), np.frombuffer(known, element).astype(np.float64)


def unpacked(places: pa.Array, values: pa.Array, width: int, element: str) -> np.ndarray:
    """The rows of packed vectors of one width."""
    rows = np.zeros((len(values), width), element)
    for row, at, known in zip(rows, places.to_pylist(), values.to_pylist(), strict=True):
        row[slice(None) if at is None else np.frombuffer(at, _place_type(width))] = np.frombuffer(known, element)
    return rows


def similarity_to(embedding: Column, vector: list[float]) -> Column:
    """Cosine similarity to one fixed vector, a batch at a time; null for a null or zero vector."""
    fixed = np.array(vector, dtype=np.float64)
    length = float(np.sqrt((fixed * fixed).sum()))

    @F.arrow_udf(DoubleType())
    def score(vectors: pa.Array) -> pa.Array:
        out, known = np.zeros(len(vectors)), np.zeros(len(vectors), dtype=bool)
        rows, at = dense(vectors, len(fixed))
        if len(at) and length > 0:
            out[at], known[at] = np.round(rows @ (fixed / length), 12), True
        return pa.array(out, pa.float64(), mask=~known)

    return score.asNondeterministic()(embedding)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Computed in double precision; null for a null or zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
