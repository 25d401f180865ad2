"""Quality by importance resampling.

Two generative models of hashed n-grams, one of texts labelled good and one of all texts, give each text a
log ratio: how much likelier it is under the first. Documents are then sampled without replacement by
Gumbel top-k over that weight. The n-grams are words, 5-grams of character classes (which show shouting,
symbol runs and lists in any language), and whether a word repeats the one before.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import cut_lineage

BUCKETS = 1 << 12
#: Families of n-grams and where their buckets end: classes, words, repeats.
ENDS = (BUCKETS, 2 * BUCKETS, 2 * BUCKETS + 2)
#: Most labelled rows that the target model and the calibration read, and so the most that is broadcast.
LABELLED = 20_000
#: Keys that may be sent to the driver to find the k-th, and cells of a histogram of them.
KEYS, CELLS = 10_000, 1_024


def _classes() -> np.ndarray:
    table = np.full(256, 1, np.uint64)  # lower case, and every byte of other scripts
    for code in range(128):
        mark = chr(code)
        table[code] = 1 if mark.islower() else 2 if mark.isupper() else 3 if mark.isdigit() else 4 if mark == " " else 5 if mark == "\n" else 6 + code
    return table


def counts(data: bytes, table: np.ndarray) -> np.ndarray:
    """How often each bucket's n-grams occur in a UTF-8 text."""
    code = table[np.frombuffer(data, np.uint8)]
    found = np.zeros(ENDS[-1])
    if len(code) >= 5:
        mixed = code[:-4]
        for i in range(1, 5):
            mixed = mixed * np.uint64(1_000_003) + code[i : len(code) - 4 + i]
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        found[: ENDS[0]] = np.bincount(mixed.astype(np.int64), minlength=BUCKETS)
    words = data.split()
    if words:
        hashed = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS
        found[ENDS[0] : ENDS[1]] = np.bincount(hashed, minlength=BUCKETS)
        same = sum(map(operator.eq, words, words[1:]))
        found[ENDS[1] :] = same, len(words) - 1 - same
    return found


def ratios(data: bytes, table: np.ndarray, weights: np.ndarray) -> list[float]:
    """The mean log ratio of the n-grams of each family; 0 for a family without any."""
    found, means, start = counts(data, table), [], 0
    for end in ENDS:
        n = found[start:end].sum()
        means.append(float(found[start:end] @ weights[start:end] / n) if n else 0.0)
        start = end
    return means


@dataclass
class Model:
    """Log ratios by bucket, and the line that turns the three means into log odds."""

    weights: np.ndarray
    slopes: np.ndarray


def _bucket_sums(docs: DataFrame, text_col: str, good_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over the good texts and over all of ``docs``; each task sends one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = _classes(), np.zeros((2, ENDS[-1]))
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1), strict=True):
                found = counts((text.as_py() or "").encode(), table)
                sums[1] += found
                if good.as_py():
                    sums[0] += found
        used = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0, used]), pa.array(sums[1, used])], names=["bucket", "good", "every"])

    rows = docs.select(text_col, good_col).mapInArrow(run, "bucket long, good double, every double").groupBy("bucket").agg(F.sum("good"), F.sum("every"))
    sums = np.zeros((2, ENDS[-1]))
    for bucket, good, every in rows.collect():  # at most 8,194 rows
        sums[:, bucket] = good, every
    return sums[0], sums[1]


def _log_share(sums: np.ndarray) -> np.ndarray:
    out, start = np.zeros(len(sums)), 0
    for end in ENDS:
        part = sums[start:end] + 0.5
        out[start:end] = np.log(part / part.sum())
        start = end
    return out


def _line(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps; the last slope is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grade = x.T @ (p - y) / len(y) + ridge * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + ridge * np.eye(len(w)), grade)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """The two models: all texts count in one; in the other those labelled 1 among at most ``labelled``
    labelled rows, chosen by a hash of the id. On the same rows the log ratios are turned into log odds."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_good"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("_id"), "_id").limit(labelled))
    marked = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(chosen, F.col("_key") == F.col("_id"), "left")
    good, every = _bucket_sums(marked, "_text", "_good")
    weights = _log_share(good) - _log_share(every) if good.sum() else np.zeros(ENDS[-1])
    three = _ratios_udf(Model(weights, np.zeros(4)))
    known = marked.where("_good is not null").select(three("_text").alias("r"), "_good").collect()  # narrow, at most ``labelled`` ids
    if len({r["_good"] for r in known}) < 2:
        return Model(weights, np.array([1.0, 1.0, 1.0, 0.0]))
    return Model(weights, _line(np.array([r["r"] for r in known]), np.array([float(r["_good"]) for r in known])))


def _ratios_udf(model: Model):
    shared = model.weights

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        table = _classes()
        return pd.Series([ratios((t or "").encode(), table, shared) for t in texts])

    return run


def log_odds(text: Column, model: Model) -> Column:
    """The calibrated log importance weight of a text; null counts as empty."""
    shared = model

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        table = _classes()
        return pd.Series([float(np.dot([*ratios((t or "").encode(), table, shared.weights), 1.0], shared.slopes)) for t in texts], dtype="float64")

    return run(text)


def gumbel_key(weight: Column, id_: Column, seed: int = 42) -> Column:
    """``weight`` plus Gumbel noise that depends on the id alone."""
    bits = F.shiftrightunsigned(F.xxhash64(id_, F.lit(seed)), 12).cast("double")
    return weight - F.log(-F.log((bits + 0.5) / float(1 << 52)))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of the column key: histograms are narrowed until few enough keys are left to fetch."""
    keys = keys.select("key")
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while n > KEYS and low < high:
        width = (high - low) / CELLS
        cell = F.least(F.floor((F.col("key") - low) / width), F.lit(CELLS - 1))
        inside = keys.where(F.col("key").between(low, high))
        cells = {r[0]: r[1:] for r in inside.groupBy(cell).agg(F.count("*"), F.min("key"), F.max("key")).collect()}
        for at in sorted(cells, reverse=True):
            if k <= cells[at][0]:
                break
            k -= cells[at][0]
        if (low, high) == cells[at][1:]:
            break
        n, low, high = cells[at]
    if low == high:
        return low
    return sorted((r[0] for r in keys.where(F.col("key").between(low, high)).collect()), reverse=True)[k - 1]


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> tuple[DataFrame, Model, float]:
    """((doc_id, log_weight, key, kept) for each row of ``docs``, the model, the smallest key that is kept).

    Kept are the k rows of the largest keys; by default k is the number of documents that are more likely
    good than not. Equal keys (rows of one id and text) stay or go together. Null and empty texts
    have no n-grams and the weight of the calibration's constant. Without labels of both kinds the weights
    are not calibrated. An empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col, labelled=labelled)
    scored = docs.select(id_col, log_odds(F.col(text_col), model).alias("log_weight"))
    scored = cut_lineage(scored.withColumn("key", gumbel_key(F.col("log_weight"), F.col(id_col))))
    if k is None:
        k = scored.where("log_weight > 0").count()
    least = kth_largest(scored, k)
    return scored.withColumn("kept", F.col("key") >= least), model, least


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows with all their columns. The weight is computed again rather than joined: no text moves."""
    _, model, least = resample(docs, labels, None, id_col, text_col)
    keyed = docs.withColumn("_key", gumbel_key(log_odds(F.col(text_col), model), F.col(id_col)))
    return keyed.where(F.col("_key") >= F.lit(least)).select(*docs.columns)
