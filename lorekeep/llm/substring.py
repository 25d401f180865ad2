"""Substring dedup by hashing runs of sentences and lines.

A text is cut into units: after a line break, after sentence-ending marks, and before a capitalised word
that follows a lower-case one. A unit of WINDOW words or more is cut again before the word of the smallest
hash in each window of WINDOW words, so that parts of sentences have common boundaries too. A run is the
shortest series of whole units from one unit on, or back from one unit, that has ``min_words`` words. Its
digest (126 bits over 64-bit word hashes) comes from prefix sums of polynomials over its text, however units
divide it. Equal runs (case and white space apart) are grouped by it over the whole corpus; the earliest, by id
and offset, stays and all others go. So a passage of ``min_words`` words or more that begins and ends with a unit goes as a whole wherever it is repeated,
whatever stands around it, and the earliest copy of every unit stays. Of any other passage of at least
``min_words`` + 3 * WINDOW - 2 words (50), wherever it begins and ends, at most WINDOW words at either end
stay: its first boundary is among its first WINDOW words, the boundary ``min_words`` words or more behind that
lies where no window reaches over its end, and the same holds from its last boundary back.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.prefix import PRIMES, Powers
from lorekeep.session import cut_lineage

MIN_WORDS = 25
#: Words of a window that holds a boundary.
WINDOW = 9
#: What a character may be: white space, a line break, an end of sentences, a lower-case letter or comma, a capital.
SPACE, BREAK, ENDS, SOFT, UPPER = 1, 2, 4, 8, 16
#: Code points from here on are neither letters of a case nor white space.
CASED = 0x1F000
#: The odd base of the polynomial modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
#: Runs that are gathered for one output batch.
BATCH = 50_000
#: Code points whose words are hashed at a time; a longer word is hashed by itself.
SLICE = 1 << 16


def cutter() -> np.ndarray:
    """What each character may be to a gap between units."""
    kinds = np.zeros(CASED, np.uint8)
    for code in range(CASED - 1):
        char = chr(code)
        kinds[code] = SPACE * char.isspace() | SOFT * (unicodedata.category(char) == "Ll") | UPPER * (unicodedata.category(char) == "Lu")
    for chars, kind in ((".!?", ENDS), (",;", SOFT), ("\n", BREAK)):
        for char in chars:
            kinds[ord(char)] |= kind
    return kinds


class Spans:
    """Hashes of any spans of a series of numbers, from prefix sums of polynomials."""

    def __init__(self) -> None:
        self.powers, self.up, self.down = Powers(), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def hashes(self, series: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Modulo 2**64."""
        n = len(series)
        if len(self.up) <= n:
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(2 * n, x, np.uint64)), dtype=np.uint64) for x in (FACTOR, pow(FACTOR, -1, 1 << 64)))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(series * self.up[:n], out=sums[1:])
        return (sums[ends] - sums[begins]) * self.down[begins]

    def words(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words of a text, SLICE code points at a time: a hash is the same wherever its word begins, so memory
        does not grow with the text."""
        out, at = np.zeros(len(begins), np.uint64), 0
        while at < len(begins):
            start = begins[at]
            upto = max(at + 1, int(np.searchsorted(ends, start + SLICE, "right")))
            part = codes[start : ends[upto - 1]].astype(np.uint64) + np.uint64(1)
            out[at:upto] = self.hashes(part, begins[at:upto] - start, ends[at:upto] - start)
            at = upto
        return out

    def checks(self, series: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Modulo two primes: 62 bits."""
        n, lanes = len(series), []
        self.powers.upto(n)
        for k, prime in enumerate(map(np.uint64, PRIMES)):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(series % prime * self.powers.up[k][:n] % prime, out=sums[1:])
            lanes.append((sums[ends] - sums[begins]) % prime * self.powers.down[k][begins] % prime)
        return lanes[0] << np.uint64(32) | lanes[1]


def boundaries(sentence: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where sentences, given by their number for each word, are cut again: the place of the smallest hash, the
    last of equal ones, in each window of WINDOW words that lies in one sentence. Only the window's words decide."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64)
    least, at, wide = hashes, np.arange(len(hashes)), 1
    while wide < WINDOW:  # the least of ``wide`` words from each on, and of a window that overlaps them
        step = min(wide, WINDOW - wide)
        later = least[step:] <= least[:-step]
        least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        wide += step
    return at[sentence[WINDOW - 1 :] == sentence[: 1 - WINDOW]]


class Words:
    """Begins, ends and hashes of the words of a text, and ``firsts``: the first word of each unit, and the end."""

    def __init__(self, text: str, cut: np.ndarray, spans: Spans) -> None:
        small = text.lower()
        kinds, self.begins, self.ends = _words(_codes(text), cut)
        codes = _codes(small)
        begins, ends = (self.begins, self.ends) if len(small) == len(text) else _words(codes, cut)[1:]
        mixed = spans.words(codes, begins, ends)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(FACTOR)
        self.hashes = mixed ^ mixed >> np.uint64(29)
        starts = np.ones(len(begins), bool)
        if len(starts) > 1:
            breaks = np.flatnonzero(kinds & BREAK)
            before, after = kinds[self.ends[:-1] - 1], kinds[self.begins[1:]]
            starts[1:] = (before & ENDS > 0) | ((before & SOFT > 0) & (after & UPPER > 0))
            starts[np.searchsorted(self.begins, breaks[breaks < self.begins[-1]])] = True
            starts[boundaries(np.cumsum(starts), self.hashes)] = True
        self.firsts = np.append(np.flatnonzero(starts), len(starts))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _words(codes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kinds of the code points, and where words begin and end."""
    kinds = cut.take(codes, mode="clip")
    inside = np.zeros(len(codes) + 2, np.uint8)
    inside[1:-1] = ~kinds & SPACE
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return kinds, edges[::2], edges[1::2]


def units(text: str, cut: np.ndarray) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each unit, without the white space around it."""
    found, words = Words(text, cut, Spans()), text.lower().split()
    firsts = found.firsts.tolist()
    return [(int(found.begins[a]), int(found.ends[b - 1]), words[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]


def runs(firsts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each run, and the one behind its last; ``firsts`` are the units' first words and the end."""
    begins, ends = firsts[:-1], firsts[1:]
    last = np.searchsorted(ends, begins + min_words)
    on = np.flatnonzero(last < len(ends))
    first = np.searchsorted(begins, ends - min_words, "right") - 1
    back = np.flatnonzero(first >= 0)
    back = back[last[first[back]] != back]
    return np.concatenate((begins[on], begins[first[back]])), np.concatenate((ends[last[on]], ends[back]))


def _digests(docs: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """(h1) of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, spans = cutter(), Spans()
        for batch in batches:
            for text in batch.column(0):
                words = Words(text.as_py() or "", cut, spans)
                yield pa.RecordBatch.from_arrays([pa.array(spans.hashes(words.hashes, *runs(words.firsts, min_words)).view(np.int64))], names=["h1"])

    return docs.select(text_col).mapInArrow(run, "h1 long")


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(h1, h2, doc_id, tag, begin, end) of each run; tag tells rows of one id apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, spans = cutter(), Spans()
        for batch in batches:
            found, held = [], 0
            for at, text in enumerate(batch.column(1)):
                words = Words(text.as_py() or "", cut, spans)
                first, last = runs(words.firsts, min_words)
                found.append((spans.hashes(words.hashes, first, last), spans.checks(words.hashes, first, last), np.full(len(first), at), words.begins[first], words.ends[last - 1]))
                held += len(first)
                if held >= BATCH or at == batch.num_rows - 1:
                    h1, h2, rows, begin, end = map(np.concatenate, zip(*found, strict=True))
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column(0).take(take), batch.column(2).take(take), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))],
                        names=["h1", "h2", "id", "tag", "begin", "end"],
                    )
                    found, held = [], 0

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.hash(text_col).alias("tag"))
    return chosen.mapInArrow(run, f"h1 long, h2 long, id {kind}, tag int, begin int, end int")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, tag, spans: array of (begin, end) in code points) of the texts that hold a run seen earlier.

    The first shuffle carries 8 bytes a run and finds what may repeat; the second brings only that together.
    """
    # Written first: a side that is an aggregate over its own exchange keeps AQE from splitting the other's hot keys.
    often = cut_lineage(_digests(docs, text_col, min_words).groupBy("h1").count().where("count > 1").select("h1"))
    held = cut_lineage(_occurrences(docs, id_col, text_col, min_words).join(often, "h1", "left_semi"))
    rank = F.struct("id", "tag", "begin", "end")
    first = held.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = held.join(cut_lineage(first.select("h1", "h2", "first")), ["h1", "h2"]).where(~rank.eqNullSafe(F.col("first")))
    return later.groupBy("id", "tag").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def _joined_up(spans: list) -> list[tuple[int, int]]:
    found: list[list[int]] = []
    for begin, end in sorted(spans):
        if found and begin <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([begin, end])
    return [tuple(x) for x in found]


def _cut(text: Column, spans: Column) -> Column:
    """struct(kept text, removed spans joined up). Only texts that lose something leave their Arrow buffer."""

    @F.arrow_udf("struct<kept:string,removed:array<struct<begin:int,end:int>>>")
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        hit = spans.is_valid()
        pieces, gone = [], [[]] * len(texts)
        for row in np.flatnonzero(hit.to_numpy(zero_copy_only=False)).tolist():
            gone[row] = _joined_up([(x["begin"], x["end"]) for x in spans[row].as_py()])
            source, left, at = texts[row].as_py(), [], 0
            for begin, end in gone[row]:
                left.append(source[at:begin])
                at = end
            pieces.append("".join(left) + source[at:])
        kept = pc.replace_with_mask(texts, hit, pa.array(pieces, texts.type))
        removed = pa.array(gone, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
        return pa.StructArray.from_arrays([kept, removed], ["kept", "removed"])

    return run(text, spans)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every row and column of ``docs`` with the repeated runs cut out of its text, and the column
    ``removed``: their (begin, end) offsets in code points of the original text, joined where they touch.

    Null and empty texts have no runs. Rows alike in id and text count as one occurrence, so neither loses
    text to the other; a null id ranks first. A column that is called removed already is replaced.
    """
    found = repeats(docs, id_col, text_col, min_words).select(F.col("id").alias("_at_id"), F.col("tag").alias("_at_tag"), F.col("spans").alias("_at_spans"))
    same = F.col(id_col).eqNullSafe(F.col("_at_id")) & (F.hash(text_col) == F.col("_at_tag"))
    cut = docs.drop("removed").join(found, same, "left").withColumn("_cut", _cut(F.col(text_col), F.col("_at_spans")))
    kept = cut.withColumn(text_col, F.col("_cut.kept")).withColumn("removed", F.col("_cut.removed"))
    return kept.select(*docs.drop("removed").columns, "removed")
