"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of each 6 neighbouring 5-grams of words the one with the smallest hash is kept (the last one among equals),
so two texts that share 10 words in a row keep the same 5-gram within them. Documents and items meet on kept
hashes; each meeting is extended to the windows of 10 words around it, and the exact windows are compared.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import cut_lineage

WINDOW = 10
GRAM = 5
#: What stands between words: ASCII marks, spaces and control characters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = 0x7FFFFFFF


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none for null."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.filter(F.split(low, GAP), lambda w: w != ""), F.array().cast("array<string>"))


def once(column: Column) -> Column:
    """The column, marked as one that Catalyst may not copy into filters or lambdas nor evaluate again."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def _numbers(count: Column) -> Column:
    """0 to count - 1, or nothing."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _grams(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (with words) and the column grams: a hash for each place where ``size`` words begin."""
    hashed = rows.withColumn("_h", once(F.transform("words", lambda w: F.xxhash64(w))))
    each = F.transform(_numbers(F.size("_h") - (size - 1)), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(size)]))
    return hashed.withColumn("grams", once(each)).drop("_h")


def fingerprints(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The winnowed fingerprints of ``rows`` (with words): a row (…, pos, gram) for each, without the words.

    A text of fewer than ``window`` words has none.
    """
    span = window - gram + 1
    keys = [c for c in rows.columns if c != "words"]
    # The upper half of a key is from the hash, the lower half falls with the position: one minimum gives both.
    keyed = _grams(rows, gram).withColumn("_v", once(F.transform("grams", lambda g, i: g.bitwiseAND(~_LOW).bitwiseOR(F.lit(_LOW) - i))))
    least = F.transform(_numbers(F.size("_v") - (span - 1)), lambda i: F.least(*[F.get("_v", i + j) for j in range(span)]))
    kept = keyed.withColumn("_kept", once(F.array_distinct(least)))
    kept = kept.withColumn("_at", F.transform("_kept", lambda v: (F.lit(_LOW) - v.bitwiseAND(_LOW)).cast("int")))
    pairs = F.transform("_at", lambda p: F.struct(p.alias("pos"), F.get("grams", p).alias("gram")))
    return kept.select(*keys, once(pairs).alias("_pairs")).select(*keys, F.inline("_pairs"))


def _all_grams(rows: DataFrame, size: int) -> DataFrame:
    keys = [c for c in rows.columns if c != "words"]
    return _grams(rows, size).select(*keys, F.posexplode("grams").alias("pos", "gram"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, window, size): distinct windows of each item, with its words; an item of fewer words is one window."""
    n = F.size("words")
    starts = _numbers(F.greatest(n - (window - 1), F.least(n, F.lit(1))))
    spread = items.select("item", "words", F.explode(starts).alias("at"))
    part = F.slice("words", F.col("at") + 1, window)
    return spread.select("item", F.concat_ws(" ", part).alias("window"), F.size(part).alias("size")).distinct()


def hits(texts: DataFrame, items: DataFrame, windows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, tag, start, size, window): where a window of an item occurs in a document (id, tag, text).

    The second join is a merge join at every size: it moves each text once, before its words are cut, and
    does the same on a little data as on much."""
    docs = texts.select("id", "tag", words(F.col("text")).alias("words"))
    near = fingerprints(docs, window, gram).join(fingerprints(items, window, gram).select("gram").distinct(), "gram", "left_semi")
    near = near.select("id", "tag", "pos", F.lit(0).alias("whole"))
    # Items of fewer words have no window of 10 to winnow: their first words are looked up everywhere. At most 9 sizes.
    short = sorted(r[0] for r in windows.where(F.col("size") < window).select("size").distinct().collect())
    if short:
        firsts = _all_grams(items.where(F.size("words") < window), short[0]).where("pos = 0").select("gram").distinct()
        near = near.unionByName(_all_grams(docs, short[0]).join(firsts, "gram", "left_semi").select("id", "tag", "pos", F.lit(1).alias("whole")))
    near = cut_lineage(near.distinct())
    found = near.groupBy(F.col("id").alias("_id"), F.col("tag").alias("_tag")).agg(
        F.collect_list(F.when(F.col("whole") == 0, F.col("pos"))).alias("near"), F.collect_list(F.when(F.col("whole") == 1, F.col("pos"))).alias("firsts")
    )
    held = texts.hint("merge").join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
    held = held.withColumn("words", once(words(F.col("text"))))
    n = F.size("words")

    def around(p: Column) -> Column:
        low, high = F.greatest(p - (window - gram), F.lit(0)), F.least(p, n - window)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    tries = F.transform(F.array_distinct(F.flatten(F.transform("near", around))), lambda s: F.struct(s.alias("start"), F.lit(window).alias("size")))

    def whole(size: int) -> Column:
        fits = F.filter("firsts", lambda p: p + size <= n)
        return F.transform(fits, lambda p: F.struct(p.alias("start"), F.lit(size).alias("size")))

    tries = F.concat(tries, *[whole(size) for size in short])
    opened = held.select("id", "tag", "words", once(tries).alias("_tries")).select("id", "tag", "words", F.inline("_tries"))
    opened = opened.select("id", "tag", "start", "size", F.concat_ws(" ", F.slice("words", F.col("start") + 1, F.col("size"))).alias("window"))
    return cut_lineage(opened.join(windows.select("window", "size").distinct(), ["window", "size"], "left_semi").distinct())


def covered(spans: Column) -> Column:
    """How many positions the (start, size) spans cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["start"] + x["size"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], x["start"])).alias("n"), end.alias("end"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"].cast("long"))


def _parts(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tagged = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col("text")).alias("words"))
    windows = item_windows(items)
    return tagged, windows, hits(tagged, items, windows)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns kept, without those that ``decontaminate`` calls contaminated."""
    found = _parts(docs, benchmark, id_col, text_col, item_col)[2]
    bad = found.select(F.struct("id", "tag").alias("_row")).distinct()
    rows = docs.withColumn("_row", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag")))
    return rows.join(bad, "_row", "left_anti").select(*docs.columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    A word is hit if it lies in an occurrence of 10 consecutive words of an item, or of all words of a
    shorter one. Null and wordless texts have no words and are clean; such items match nothing. Each
    repeated row keeps its row; rows of one id but different texts are judged apart; a null item_id hits
    words but is not listed; other columns are ignored. With no documents or no items there are no hits.
    """
    tagged, windows, found = _parts(docs, benchmark, id_col, text_col, item_col)
    places = found.groupBy("id", "tag").agg(covered(F.collect_set(F.struct("start", "size"))).alias("n_hit"))
    listed = found.select("id", "tag", "window").distinct().join(windows.select("window", "item"), "window").select("id", "tag", "item").distinct()
    ids = F.array_sort(F.collect_set(F.col("item").cast("string")))
    named = listed.groupBy("id", "tag").agg(F.count("item").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    places = places.select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), "n_hit")
    named = named.select(F.col("id").alias("_id2"), F.col("tag").alias("_tag2"), "n_items", "items_sha256")
    base = tagged.select("id", "tag", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    base = base.join(places, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    base = base.join(named, F.col("id").eqNullSafe(F.col("_id2")) & (F.col("tag") == F.col("_tag2")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
