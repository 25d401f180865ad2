"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts confirmed toxic; everything else the learner sees is unlabelled. A linear model over the
words and in-word 5-grams that a text has is fitted in numpy by the non-negative risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss: where the estimate of the negatives' risk falls below zero, the step undoes it. Every
unlabelled row of the learning fold counts: they are dealt into blocks, a task fits a model to each block and all
confirmed texts, and the model is the mean of theirs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import cut_lineage

BUCKETS = 1 << 20
#: Most confirmed texts that the fit reads (and so ids that are broadcast), and unlabelled rows of a block.
SAMPLE = 20_000
#: Features that the model has at most.
FEATURES = 4_096
#: Features have so many times the share among confirmed texts, and a likelihood ratio (G) of so much against chance.
LIFT, EVIDENCE = 3, 10
#: Words that a task remembers.
MEMORY = 300_000
CUT = 0.7


def word_features(word: str) -> list[int]:
    """Buckets of a word and of the 5-grams of it with its ends marked."""
    marked = f"<{word}>"
    parts = {f"={word}", *(marked[i : i + 5] for i in range(len(marked) - 4))}
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


class _Words(dict):
    """The chosen features of each word; emptied when full."""

    def __init__(self, chosen: set[int] | None) -> None:
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(f for f in word_features(word) if self.chosen is None or f in self.chosen)
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found
        return found


def features(text: str, known: _Words) -> set[int]:
    return set().union(*map(known.__getitem__, set(re.findall(r"\w+", text.lower()))))


@dataclass
class Model:
    """Weight of each chosen feature, and the constant."""

    weights: dict[int, float]
    bias: float


def held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(3)) == 1, F.lit(False))


def nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, width: int, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and constant from a sparse 0/1 matrix, given by its (row, column) pairs, and a flag per row."""
    n, p, u = len(positive), positive, ~positive
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols], n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_negative = np.logaddexp(0, z)
        rest = as_negative[u].mean() - prior * as_negative[p].mean()
        push = np.zeros(n)  # the gradient by z
        if rest >= 0:
            push[p] = prior * (s[p] - 1) / p.sum() - prior * s[p] / p.sum()
            push[u] = s[u] / u.sum()
        else:
            push[p] = prior * s[p] / p.sum()
            push[u] = -s[u] / u.sum()
        g = np.append(np.bincount(cols, push[rows], width), push.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _learning(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[DataFrame, float | None]:
    """(id, text, positive) of the learning fold, and the share of toxic ones among all that are labelled.
    Confirmed texts beyond ``sample`` are left out."""
    known = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_toxic"))
    n, toxic = known.agg(F.count("*"), F.sum((F.col("_toxic") == 1).cast("int"))).first()
    fold = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").where(~held_out(F.col("id")))
    confirmed = known.where("_toxic = 1").select("_id")
    chosen = F.broadcast(confirmed.orderBy(F.xxhash64("_id"), "_id").limit(sample))  # at most ``sample`` ids
    rows = fold.join(chosen, F.col("id") == F.col("_id"), "left").withColumn("positive", F.col("_id").isNotNull()).drop("_id")
    if toxic and toxic > sample:
        rest = rows.where("not positive").join(confirmed, F.col("id") == F.col("_id"), "left_anti")
        rows = rows.where("positive").unionByName(rest)
    return rows, (toxic / n if n and toxic and toxic < n else None)


def _chosen(rows: DataFrame, limit: int) -> tuple[dict[int, int], int, int]:
    """The number of each feature to use, and how many rows are positive and not. Counted over all rows, with
    a sum for each feature and task."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = _Words(None), np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for text, positive in zip(batch.column(0), batch.column(1), strict=True):
                sums[int(positive.as_py()), [BUCKETS, *features(text.as_py() or "", known)]] += 1
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[1, used]), pa.array(sums[0, used])], names=["feature", "p", "u"])

    seen = rows.select("text", "positive").mapInArrow(occurrences, "feature long, p long, u long")
    seen = cut_lineage(seen.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")))  # at most BUCKETS + 1 rows
    sizes = seen.where(F.col("feature") == BUCKETS).first()
    n_p, n_u = (sizes["p"], sizes["u"]) if sizes else (0, 0)
    if not n_p or not n_u:
        return {}, n_p, n_u
    p, u = F.col("p"), F.col("u")
    lift = ((p + 0.5) / n_p) / ((u + 0.5) / n_u)

    def part(own: Column, size: int) -> Column:
        return F.when(own > 0, own * F.log(own / ((p + u) * (size / (n_p + n_u))))).otherwise(0.0)

    sure = 2 * (part(p, n_p) + part(u, n_u)) >= EVIDENCE
    gain = p / n_p * F.log(lift)
    best = seen.where((F.col("feature") < BUCKETS) & (lift >= LIFT) & sure).orderBy(gain.desc(), "feature").limit(limit).collect()
    return {r["feature"]: i for i, r in enumerate(best)}, n_p, n_u


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, limit: int = FEATURES) -> Model:
    """Learns from the rows that are not held out: of confirmed toxic texts at most ``sample``, chosen by a hash
    of the id, and all others, in blocks of some ``sample`` rows. At most ``limit`` features are used. The class
    prior is the share of toxic rows among all labelled ones; without both labels, or without texts of either
    kind, the model is a constant."""
    rows, prior = _learning(docs, labels, id_col, text_col, label_col, sample)
    if prior is None:
        return Model({}, -5.0)
    chosen, n_p, n_u = _chosen(rows, limit)
    if not n_p or not n_u:
        return Model({}, -5.0)
    kind, blocks, width = rows.schema["id"].dataType.simpleString(), -(-n_u // sample), len(chosen)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = _Words(set(chosen)), 0
        for batch in batches:
            held = [sorted(chosen[f] for f in features(x.as_py() or "", known)) for x in batch.column(1)]
            # Numbered too, so that rows of one id are dealt out like any others.
            block = [zlib.crc32(f"{x}:{at + i}".encode()) % blocks for i, x in enumerate(batch.column(0).to_pylist())]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int32())), batch.column(2), pa.array(block, pa.int32())], names=["id", "held", "positive", "block"])

    table = cut_lineage(rows.mapInArrow(narrowed, f"id {kind}, held array<int>, positive boolean, block int"))
    confirmed = table.where("positive").groupBy("id").agg(F.min("held").alias("held")).orderBy("id")  # a row for each id: ``sample`` at most
    shared = docs.sparkSession.sparkContext.broadcast([r["held"] for r in confirmed.select("held").collect()])

    def fitted(block: pd.DataFrame) -> pd.DataFrame:
        held = [*shared.value, *sorted(map(list, block["held"]))]
        each = np.repeat(np.arange(len(held)), [len(x) for x in held])
        cols = np.array([f for x in held for f in x], np.int64)
        weights, bias = nnpu(each, cols, np.arange(len(held)) < len(shared.value), width, prior)
        return pd.DataFrame({"at": np.arange(width + 1), "weight": np.append(weights, bias)})

    means = table.where("not positive").select("block", "held").groupBy("block").applyInPandas(fitted, "at int, weight double").groupBy("at").agg(F.avg("weight").alias("weight"))
    mean = {r["at"]: r["weight"] for r in means.collect()}  # at most ``limit`` + 1 rows
    return Model({f: mean[i] for f, i in chosen.items()}, mean[width])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``: score is the model's probability that
    the text is toxic, predicted is 1 from 0.7 on. Null and empty texts score as texts without any feature;
    rows alike score alike; a null id is not held out; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        known = _Words(set(weights))
        for batch in batches:
            z = [bias + sum(map(weights.__getitem__, sorted(features(x.as_py() or "", known)))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[id_col, "score"])

    rows = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return rows.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the rows that are not held out and scores all."""
    return score(docs, fit(docs, labels))
