"""Importance resampling towards a target distribution, ranked by regular sampling.

Hashed n-grams of the documents and of a target corpus are counted by bucket; a bucket's gain is the rounded log of
how much commoner it is in the target. Weights are looked up in the array of gains. Gumbel noise that depends on the
id makes a weight a score, and the highest scores are drawn. Their exact ranks come from parallel sorting by
regular sampling: rows are dealt into equal runs, each run is sorted where it lies, equally spaced rows of all
runs give the splitters, rows are exchanged by splitter, each segment is merged, and the segments' sizes
are added up to give the rank that each begins at.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import cut_lineage

BUCKETS = 10_000
LONGEST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes to words: A-Z lower-cased; digits, a-z and all bytes of other scripts kept; the rest are gaps.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(data: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """(words, the bucket of each n-gram of 1 to ``longest`` words) of a UTF-8 text."""
    words = data.translate(LETTERS).split()
    hashed = [zlib.crc32(w) for w in words]
    for n in range(2, longest + 1):
        hashed += [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return len(words), np.array(hashed, np.int64) % buckets


def _bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; none for a null."""
    return (x.as_py() or b"" for x in column.cast(pa.binary()))


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket's n-grams occur; a task sends one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in _bytes(batch.column(0)):
                sums += np.bincount(features(data, longest, buckets)[1], minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    sums = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # a row for each bucket at most
        sums[bucket] = n
    return sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of a text's n-grams, 0 without any."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in _bytes(batch.column(1)):
                n_words, found = features(data, longest, len(gain))
                rows.append((n_words, len(found), int(gain[found].sum()) // len(found) if len(found) else 0))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_words", "n_features", "weight"])

    chosen = docs.select(id_col, F.col(text_col).cast("string"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 8 hex digits of sha256(``seed:id``); a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u)))


def _segment(score: Column, id_: Column, run: Column, at: Column, splitters: list[tuple]) -> Column:
    """Which segment a row falls into: the number of splitters that are not behind it."""
    if not splitters:
        return F.lit(0)

    @F.arrow_udf("int")
    def place(scores: pa.Array, ids: pa.Array, runs: pa.Array, ats: pa.Array) -> pa.Array:
        rows = zip(scores.to_pylist(), ids.to_pylist(), runs.to_pylist(), ats.to_pylist(), strict=True)
        return pa.array([bisect_right(splitters, sort_key(*row)) for row in rows], pa.int32())

    return place(score, id_, run, at)


def sort_key(score: int, id_, run: int, at: int) -> tuple:
    """Highest score first, then the smallest id, null first; run and place tell rows alike in both apart."""
    return -score, id_ is not None, id_ if id_ is not None else 0, run, at


def ranked(rows: DataFrame, id_col: str, score_col: str, parts: int | None = None) -> DataFrame:
    """``rows`` with the column rank: 1, 2, 3, ... by falling score, ties to the smaller id (null first).

    Parallel sorting by regular sampling over ``parts`` runs (default: the session's shuffle partitions) of equal size. A
    segment has at most twice its share of the rows, however many of them tie, since a row's run and place
    in it end the sort key. ``parts`` - 1 splitters and ``parts`` sizes reach the driver; the ``parts`` squared
    sampled keys are sorted in Spark. Columns named _run, _at and _segment are reserved.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(score_col), F.asc(id_col)]
    # Locally sorted runs; a row's place in its run is the low 33 bits of the generated id.
    dealt = rows.repartition(parts).sortWithinPartitions(*order)
    runs = cut_lineage(dealt.withColumns({"_run": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    key = [score_col, id_col, "_run", "_at"]
    sizes = runs.groupBy(F.col("_run").alias("_of")).agg(F.count("*").alias("_n"))
    spaced = F.floor((F.col("_at") + 1) * parts / F.col("_n")) > F.floor(F.col("_at") * parts / F.col("_n"))
    samples = runs.select(*key).join(sizes, F.col("_run") == F.col("_of")).where(spaced).select(*key)
    whole = Window.orderBy(*order, "_run", "_at")  # ``parts`` squared keys at most
    place = samples.withColumn("_i", F.row_number().over(whole)).where((F.col("_i") % parts == 0) & (F.col("_i") < parts * parts))
    splitters = sorted(sort_key(*row[:4]) for row in place.select(*key).collect())  # ``parts`` - 1 rows
    exchanged = cut_lineage(runs.withColumn("_segment", _segment(*[F.col(c) for c in key], splitters)))
    starts, before = {}, 0
    for segment, n in sorted(tuple(r) for r in exchanged.groupBy("_segment").count().collect()):  # ``parts`` rows
        starts[segment], before = before, before + n
    offset = F.element_at(F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(parts)]), F.col("_segment") + 1)
    merged = F.row_number().over(Window.partitionBy("_segment").orderBy(*order, "_run", "_at"))
    return exchanged.withColumn("rank", merged + offset).drop("_run", "_at", "_segment")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs``; rank is null for rows that are not drawn.

    Of the N rows with ``min_words`` words or more the floor(``percent`` N / 100) of the highest scores are drawn, rank 1 first; ties go to
    the smaller id, null first; rows alike in id and score come in either order. Null and empty texts
    have no features and weight 0. All counts cover every row. An empty target gives gains that favour
    rare buckets; empty ``docs`` give an empty result. Other columns are not read.
    """
    source = bucket_counts(docs, text_col, longest, buckets)
    gain = gains(source, bucket_counts(target, target_text_col, longest, buckets))
    weighed = weigh(docs, gain, longest, id_col, text_col)
    scored = cut_lineage(weighed.withColumn("score", (F.col("weight") + noise(F.col(id_col), seed)).cast("long")))
    able = scored.where(F.col("n_words") >= min_words)
    k = percent * able.count() // 100
    columns = [id_col, "n_features", "weight", "score"]
    placed = ranked(able.select(*columns), id_col, "score")
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")).cast("long"))
    others = scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*columns, "rank").unionByName(others)
