"""Language of web pages by Bayesian evidence fusion.

    log P(language | page) = text log likelihood + log P(declared | language) + log P(language | host) + const

The text model is naive Bayes over hashed byte trigrams. What pages declare, and what hosts and address
suffixes hold, is counted over all pages by grouped aggregation of the text's posterior: suffixes are
smoothed towards all pages, hosts towards their suffix, and a page does not count for its own prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import cut_lineage

BUCKETS = 1 << 14
#: Most labelled documents that the text model reads, and so ids that are broadcast.
LABELLED = 20_000
#: Trigrams beyond this many weigh no more: they are not independent evidence.
EVIDENCE = 60.0
#: Pages' worth of trust in the suffix for a host, in all pages for a suffix, and in one declaration for a language.
HOST_TRUST, SUFFIX_TRUST, DECLARED_TRUST = 5.0, 20.0, 5.0
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&\w+;")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a lower-cased text, white space joined up."""
    code = np.frombuffer(" ".join(text.lower().split()).encode(), np.uint8).astype(np.uint32)
    if len(code) < 3:
        return np.zeros(0, np.int64)
    mixed = (code[:-2] << np.uint32(16) | code[1:-1] << np.uint32(8) | code[2:]) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(18)).astype(np.int64)


def visible(html: str) -> str:
    return _HIDDEN.sub(" ", html)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", labelled: int = LABELLED) -> tuple[list[str], np.ndarray]:
    """Languages, and the log share of each bucket in them, from at most ``labelled`` labelled documents,
    chosen by a hash of the id."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(lang_col).alias("_lang")).orderBy(F.xxhash64("_id"), "_id").limit(labelled)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_lang", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text.as_py() or ""), minlength=BUCKETS)
        for lang, found in sums.items():
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(found[used])], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counted})  # a few languages of 16,384 buckets at most
    sums = np.full((len(langs), BUCKETS), 0.5)
    for lang, bucket, n in counted:
        sums[langs.index(lang), bucket] += n
    return langs, np.log(sums / sums.sum(axis=1, keepdims=True)) if langs else sums


def _text_udf(shares: np.ndarray):
    @F.pandas_udf("array<double>")
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for html in pages:
            found = trigrams(visible(html or ""))
            sums = shares[:, found].sum(axis=1) * min(1.0, EVIDENCE / max(1, len(found)))
            out.append(sums - np.logaddexp.reduce(sums))
        return pd.Series(out)

    return run


def _sums(n: int) -> list[Column]:
    return [F.sum(F.exp(F.col("text")[i])).alias(f"c{i}") for i in range(n)]


def _array(n: int) -> Column:
    return F.array(*[F.col(f"c{i}") for i in range(n)])


def identify(pages: DataFrame, docs: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) for each row of ``pages`` (page_id, url, html).

    Null and empty pages have no text evidence, null urls the empty host; undeclared pages have a declaration
    of their own kind, which is weighed like any other. Ties go to the first language by name. Repeated rows
    keep their rows. Without labelled documents lang is null and probability 0.
    """
    langs, shares = fit(docs, labelled=labelled)
    n = len(langs)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][\w+.-]*:)?//([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    rows = pages.select("page_id", host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"), declared.alias("declared"), "html")
    if not n:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    rows = cut_lineage(rows.select("page_id", "host", "suffix", "declared", _text_udf(shares)("html").alias("text")))

    every = rows.groupBy().agg(*_sums(n)).select(_array(n).alias("all_c"))
    one = F.lit(1.0)
    by_suffix = rows.groupBy("suffix").agg(*_sums(n)).select("suffix", _array(n).alias("suffix_c"))
    by_host = rows.groupBy("host").agg(*_sums(n)).select("host", _array(n).alias("host_c"))
    by_declared = rows.groupBy("declared").agg(*_sums(n)).select("declared", _array(n).alias("declared_c"))
    total = [x or 0.0 for x in every.first()["all_c"]]  # one number for each language
    share = F.array(*[F.lit((x + 1) / (sum(total) + n)) for x in total])
    counts = F.array(*[F.lit(float(x)) for x in total])
    met = rows.join(by_suffix, "suffix").join(by_host, "host").join(by_declared, "declared")

    def less(column: str) -> Column:
        """Counts without the page itself."""
        return F.zip_with(column, "own", lambda c, x: F.greatest(c - x, F.lit(0.0)))

    def added(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)

    def smoothed(column: str, base: str, trust: float) -> Column:
        part = added(F.col(column)) + trust
        return F.zip_with(column, base, lambda c, b: (c + b * trust) / part)

    met = met.withColumn("own", F.transform("text", lambda x: F.exp(x)))
    for column in ("suffix_c", "host_c", "declared_c"):
        met = met.withColumn(column, less(column))
    met = met.withColumn("share", share).withColumn("suffix_p", smoothed("suffix_c", "share", SUFFIX_TRUST))
    met = met.withColumn("host_p", smoothed("host_c", "suffix_p", HOST_TRUST))
    # P(declared | language), smoothed by how often it is declared at all.
    often = (added(F.col("declared_c")) + one) / (added(counts) + one)
    met = met.withColumn("said_p", F.zip_with("declared_c", counts, lambda c, m: (c + often * DECLARED_TRUST) / (m + DECLARED_TRUST)))
    joint = F.transform("text", lambda t, i: t + F.log(F.get("host_p", i)) + F.log(F.get("said_p", i)))
    met = met.withColumn("joint", joint).withColumn("best", F.array_max("joint"))
    names = F.lit(langs)
    return met.select(
        "page_id",
        F.get(names, F.array_position("joint", F.col("best")).cast("int") - 1).alias("lang"),
        (one / added(F.transform("joint", lambda x: F.exp(x - F.col("best"))))).alias("probability"),
        F.get(names, F.array_position("text", F.array_max("text")).cast("int") - 1).alias("text_lang"),
        "declared",
        "host",
    )
