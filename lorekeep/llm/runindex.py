"""Exact removal of long repeated byte strings by run-length indexes.

A string of ``length`` bytes has one anchor: its first gram of ``gram`` bytes with the smallest hash, which the
string's bytes alone decide. Consecutive strings of one anchor are a piece, so equal strings lie in pieces of
equal anchors, and only those need to meet:

1. Pieces that are equal as a whole, in two texts or twice in one, repeat with all their strings. Digests settle this.
2. Different pieces of one anchor are indexed together: a suffix array of their concatenation gives the run-length
   Burrows-Wheeler transform, with the text position and common prefix at both ends of each run. Streaming over
   the text, the matching statistics of every position follow from the last run end before it (within a run
   the match shrinks by one from position to position), and those of ``length`` or more mark repeats.
3. Pieces of an anchor that are too many for one index are split by where the string begins before the anchor: halves
   of the range share a longer core, by which they are grouped anew, at most log2(length) times; at the
   end a core is the string itself. Pieces that became equal are settled as in 1.

Texts that are equal as a whole are indexed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import cut_lineage

LENGTH = 400
#: Bytes of an anchor. Longer ones meet by chance more seldom, shorter ones are fewer.
GRAM = 128
#: Bytes of pieces that one index takes; pieces of one anchor beyond that are split first.
INDEX_BYTES = 1 << 20
#: Positions that are hashed at a time, and rows of an output batch.
BLOCK, BATCH = 1 << 20, 50_000
MULTIPLIER = 0x9E3779B97F4A7C15
LOW = np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Anchors:
    """Finds the pieces of texts that lie one after another in a buffer."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram, self.grams = length, min(gram, length), length - min(gram, length) + 1
        self.symbols = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
        self.powers, self.inverses = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", MULTIPLIER), ("inverses", pow(MULTIPLIER, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """The hash of the gram that begins at each byte: prefix sums of a polynomial, modulo 2 to the 64."""
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.symbols[data] * self.powers[: len(data)], out=sums[1:])
        n = len(data) - self.gram + 1
        return _mixed((sums[self.gram :] - sums[:n]) * self.inverses[:n])

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first start, last start, anchor, anchor's hash) of each piece; ``offsets`` are the ends of the texts, after a 0."""
        whole, edge = np.zeros(len(data) + 1, np.int8), offsets[1:]
        np.add.at(whole, np.maximum(offsets[:-1], edge - self.length + 1), 1)
        np.add.at(whole, edge, -1)
        whole = np.cumsum(whole[:-1], dtype=np.int8) == 0
        parts = []
        for at in range(0, len(data) - self.length + 1, BLOCK):
            block = data[at : at + BLOCK + self.length - 1]
            hashed = self.hashes(block)
            key = (hashed & ~LOW) | np.arange(len(hashed), dtype=np.uint64)
            step, least = 1, key
            while 2 * step <= self.grams:
                least = np.minimum(least[:-step], least[step:])
                step *= 2
            if rest := self.grams - step:
                least = np.minimum(least[:-rest], least[rest:])
            chosen = (least & LOW).astype(np.int64)
            start = np.flatnonzero(whole[at : at + len(chosen)])
            chosen = chosen[start]
            new = np.ones(len(start), bool)
            new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            if len(first):
                parts.append((start[first] + at, start[last] + at, chosen[first] + at, hashed[chosen[first]]))
        if not parts:
            empty = np.empty(0, np.int64)
            return empty, empty, empty, empty.astype(np.uint64)
        first, last, anchor, hashed = (np.concatenate(x) for x in zip(*parts, strict=True))
        # A piece may go on from one block to the next.
        new = np.ones(len(first), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != last[:-1] + 1)
        begins = np.flatnonzero(new)
        return first[begins], last[np.append(begins[1:], len(first)) - 1], anchor[begins], hashed[begins]


def _digests(data: memoryview, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests of slices, as rows of two 64-bit integers."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]), "<i8").reshape(-1, 2)


PIECE = "k1 long, k2 long, mute boolean, a int, lo int, hi int, core long, s1 long, s2 long, again boolean, quiet boolean"
NAMES = ["k1", "k2", "mute", "a", "lo", "hi", "core", "s1", "s2", "again", "quiet"]


def _batches(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for at in range(0, whole.num_rows, BATCH):
        yield whole.slice(at, BATCH)


def pieces(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The pieces of ``texts`` (k1, k2, mute, text), each once for a text: (k1, k2, mute, anchor, first and last start, the anchor's hash as core, a
    digest of the piece, whether the text has it again). Rows without a core are starts that repeat within
    their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            column = batch.column(3).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            held = column.buffers()[2]
            data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
            offsets = offsets - offsets[0]
            first, last, anchor, hashed = anchors.pieces(data, offsets)
            if not len(first):
                continue
            digest = _digests(memoryview(data), first, last + length)
            row = np.searchsorted(offsets, first, "right") - 1
            order = np.lexsort((first, digest[:, 1], digest[:, 0], row))
            same = np.zeros(len(order) + 1, bool)
            a, b = order[:-1], order[1:]
            same[1:-1] = (row[a] == row[b]) & (digest[a] == digest[b]).all(axis=1)
            own, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
            later[order] = same[:-1]
            own[order] = same[1:]
            base = offsets[row]

            def of(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray, settled: bool) -> list[pa.Array]:
                n, at = int(mask.sum()), pa.array(row[mask])
                shifts = [pa.array((x[mask] - base[mask]).astype(np.int32)) for x in (anchor, lo, hi)]
                none = pa.nulls(n, pa.int64())
                found = [none] * 3 if settled else [pa.array(hashed[mask].view(np.int64)), pa.array(digest[mask, 0]), pa.array(digest[mask, 1])]
                return [*(batch.column(i).take(at) for i in range(3)), *shifts, *found, pa.array(own[mask]), pa.array(np.zeros(n, bool))]  # noqa: B023

            yield from _batches(of(~later, first, last, False), NAMES)
            if later.any():
                # Neighbouring starts of settled pieces are joined up.
                head = later.copy()
                head[1:] &= ~(later[:-1] & (first[1:] == last[:-1] + 1) & (row[1:] == row[:-1]))
                begins = np.flatnonzero(head)
                ends = np.zeros(len(first), np.int64)
                places = np.flatnonzero(later)
                ends[begins] = last[places[np.append(np.searchsorted(places, begins)[1:], len(places)) - 1]]
                yield from _batches(of(head, first, ends, True), NAMES)

    return texts.select("k1", "k2", "mute", "text").mapInArrow(run, PIECE)


def halves(wanted: DataFrame, length: int, gram: int, level: int) -> DataFrame:
    """The pieces of ``wanted`` (text, k1, k2, pieces) cut at a grid of so many levels, grouped by longer cores."""
    grams = length - min(gram, length) + 1
    width = -(-grams // (1 << level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        core_of, digest_of = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            rows = []
            for text, k1, k2, found in zip(*(batch.column(i) for i in range(4)), strict=True):
                data, key = memoryview(text.cast(pa.binary()).as_py()), (k1.as_py(), k2.as_py())
                for piece in found.as_py():
                    a = piece["a"]
                    least, most = a - piece["hi"], a - piece["lo"]  # how far before the anchor strings begin
                    for cell in range(least // width, most // width + 1):
                        near, far = cell * width, (cell + 1) * width - 1
                        lo, hi = a - min(most, far), a - max(least, near)
                        core = core_of(data[a - near : a - far + length], seed=cell) if far - near < length else 0
                        rows.append((*key, piece["mute"], a, lo, hi, core, digest_of(data[lo : hi + length]), piece["quiet"]))
            if rows:
                k1, k2, mute, a, lo, hi, core, digest, quiet = zip(*rows, strict=True)
                pair = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                numbers = [pa.array(x, pa.int32()) for x in (a, lo, hi)]
                columns = [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(mute), *numbers, pa.array(np.array(core, np.uint64).view(np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1])]
                yield from _batches([*columns, pa.array([False] * len(rows)), pa.array(quiet)], NAMES)

    return wanted.select("text", "k1", "k2", "pieces").mapInArrow(run, PIECE)


#: Symbols of a packed key and bits of each: separators are 0, bytes 1 to 256, the end 257.
PACK, BITS = 7, 9


def suffix_array(packed: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by prefix doubling from keys of PACK symbols; only ties are sorted on."""
    n, h = len(packed), PACK
    order = np.argsort(packed)
    ranked = packed[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        held = order[slots]
        key = rank[held] * (n + 1) + rank[np.minimum(held + h, n)] + 1
        by = np.argsort(key)
        held, key = held[by], key[by]
        order[slots] = held
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] |= fresh
        rank[held] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        h *= 2


def pack(symbols: np.ndarray) -> np.ndarray:
    """PACK symbols from each place on in one integer."""
    padded = np.concatenate([symbols, np.zeros(PACK, np.int64)])
    packed = np.zeros(len(symbols), np.int64)
    for i in range(PACK):
        packed = (packed << BITS) | padded[i : i + len(symbols)]
    return packed


def common(packed: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of different suffixes."""
    found, live, at = np.zeros(len(x), np.int64), np.arange(len(x)), 0
    while len(live):
        differ = packed[x[live] + at] ^ packed[y[live] + at]
        ended = differ != 0
        done, rest = live[ended], differ[ended]
        same = np.ones(len(done), bool)
        found[done] = at
        for i in range(PACK - 1, -1, -1):
            same &= (rest >> (BITS * i)) & ((1 << BITS) - 1) == 0
            found[done] += same
        live, at = live[~ended], at + PACK
    return found


@dataclass
class RunIndex:
    """A run-length Burrows-Wheeler transform with samples at run ends.

    ``symbols`` and ``sizes`` are the runs; ``heads`` and ``tails`` the text positions of their first and last rows; ``above`` is
    the common prefix of a run's first row with the row before it, ``below`` that of its last with the row behind.
    """

    symbols: np.ndarray
    sizes: np.ndarray
    heads: np.ndarray
    tails: np.ndarray
    above: np.ndarray
    below: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray) -> RunIndex:
        """The index of a text of symbols that ends with one that is found nowhere else."""
        packed = pack(symbols)
        order = suffix_array(packed)
        last = symbols[order - 1]  # before the first symbol comes the end, so that its row is a run by itself
        begin = np.ones(len(order), bool)
        begin[1:] = last[1:] != last[:-1]
        first = np.flatnonzero(begin)
        ends = np.append(first[1:], len(order))
        meet = common(packed, order[first[1:]], order[first[1:] - 1])
        return cls(last[first], ends - first, order[first], order[ends - 1], np.append(0, meet), np.append(meet, 0))

    def statistics(self) -> np.ndarray:
        """For each position, how long a string from there on is found at another position too."""
        n = int(self.sizes.sum())
        at, longest = np.arange(n), np.zeros(n, np.int64)
        for places, lengths in ((self.heads, self.above), (self.tails, self.below)):
            known = np.zeros(n, np.int64)
            known[places] = lengths
            sampled = np.zeros(n, np.int64)
            sampled[places] = places
            latest = np.maximum.accumulate(sampled)
            longest = np.maximum(longest, known[latest] - (at - latest))
        return longest


def repeated(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first start, last start) of the runs of strings of ``length`` bytes within parts that are found elsewhere in them."""
    sizes = np.array([len(p) for p in parts], np.int64)
    symbols = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    symbols[ends] = 0
    symbols[-1] = 257
    long = RunIndex.of(symbols).statistics() >= length
    inside = np.zeros(len(symbols) + 1, np.int64)
    # A part shorter than the string has no start.
    np.add.at(inside, begins, 1)
    np.add.at(inside, np.maximum(begins, ends - length + 1), -1)
    marked = np.concatenate([[False], long & (np.cumsum(inside[:-1]) > 0), [False]])
    edges = np.flatnonzero(marked[1:] != marked[:-1]).reshape(-1, 2)
    part = np.searchsorted(begins, edges[:, 0], "right") - 1
    return part, edges[:, 0] - begins[part], edges[:, 1] - 1 - begins[part]


SPAN = "k1 long, k2 long, begin int, end int"


def index_marks(found: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """Spans (k1, k2, begin, end) that repeat among the pieces of a core. ``found`` has (core, k1, k2, lo, quiet, data). All
    rows of a core come one after another; indexes end between cores once they have ``index_bytes``."""

    def marks(held: list[tuple]) -> pa.RecordBatch:
        part, lo, hi = repeated([x[4] for x in held], length)
        loud = ~np.array([x[3] for x in held])[part]
        part, lo, hi = part[loud], lo[loud], hi[loud]
        base = np.array([x[2] for x in held], np.int64)[part]
        keys = [pa.array(np.array([x[i] for x in held], np.int64)[part]) for i in (0, 1)]
        columns = [*keys, pa.array((base + lo).astype(np.int32)), pa.array((base + hi + length).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for core, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if core != last and size >= index_bytes:
                    yield marks(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[4]), core
        if held:
            yield marks(held)

    placed = found.select("core", "k1", "k2", "lo", "quiet", "data").repartition("core").sortWithinPartitions("core")
    return placed.mapInArrow(run, SPAN)


def _with_text(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(text, k1, k2, pieces) of the texts that have chosen pieces."""
    by_text = chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "mute", "a", "lo", "hi", "quiet")).alias("pieces"))
    return texts.select("k1", "k2", "text").join(cut_lineage(by_text), ["k1", "k2"])


def _sliced(wanted: DataFrame, length: int) -> DataFrame:
    """(core, k1, k2, lo, quiet, data) of each piece of ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "k1", "k2", "lo", "quiet", "data"]
        for batch in batches:
            rows = []
            for text, k1, k2, found in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = text.cast(pa.binary()).as_py()
                rows += [(p["core"], k1.as_py(), k2.as_py(), p["lo"], p["quiet"], data[p["lo"] : p["hi"] + length]) for p in found.as_py()]
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], sliced)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], sliced)

    kinds = [("core", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("quiet", pa.bool_()), ("data", pa.binary())]
    sliced = pa.schema(kinds)
    return wanted.select("text", "k1", "k2", "pieces").mapInArrow(run, "core long, k1 long, k2 long, lo int, quiet boolean, data binary")


def spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(k1, k2, begin, end) in bytes, overlapping, that cover all strings of ``length`` bytes that ``texts`` (k1, k2, mute, text; keys
    unique) hold at more than one place. Texts with ``mute`` count as places but get no spans."""
    end = (F.col("hi") + length).alias("end")
    rows = cut_lineage(pieces(texts, length, gram))
    marks = [rows.where("core is null and not mute").select("k1", "k2", F.col("lo").alias("begin"), end)]
    rows, level = rows.where("core is not null"), 0
    while True:
        # A piece and its place, whichever; its digest says what it holds.
        place = [F.first(c).alias(c) for c in ("k1", "k2", "mute", "a", "lo", "hi")]
        kinds = rows.groupBy("core", "s1", "s2").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.max("quiet").alias("quiet"), *place)
        kinds = cut_lineage(kinds.withColumn("settled", (F.col("n") > 1) | F.col("again")))
        settled = kinds.where("settled").select("core", "s1", "s2")
        marks.append(rows.where("not quiet and not mute").join(settled, ["core", "s1", "s2"]).select("k1", "k2", F.col("lo").alias("begin"), end))
        quiet = (F.col("settled") | F.col("quiet") | F.col("mute")).alias("quiet")
        narrow = kinds.select("core", "k1", "k2", "mute", "a", "lo", "hi", quiet)
        size = F.sum((F.col("hi") - F.col("lo") + length).cast("long")).alias("size")
        groups = cut_lineage(narrow.groupBy("core").agg(F.count("*").alias("n"), size, F.min("quiet").alias("done")).where("n > 1 and not done").select("core", "size"))
        met = narrow.join(groups, "core")
        small = _sliced(_with_text(texts, met.where(F.col("size") <= index_bytes)), length)
        marks.append(cut_lineage(index_marks(small, length, index_bytes)))
        if groups.where(F.col("size") > index_bytes).isEmpty():
            break
        level += 1
        rows = cut_lineage(halves(_with_text(texts, met.where(F.col("size") > index_bytes)), length, gram, level))
    found = marks[0]
    for more in marks[1:]:
        found = found.unionByName(more)
    return found


def joined_up(found: list) -> list[tuple[int, int]]:
    """Spans that overlap or touch, joined."""
    out: list[list[int]] = []
    for begin, end in sorted(found):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


CUT = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<begin:long,end:long>>"


def _cut(marked: DataFrame) -> DataFrame:
    """What is removed from each text of ``marked`` (k1, k2, text, spans), and the digest of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, digests = [], []
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                data, at, digest = memoryview(text.cast(pa.binary()).as_py()), 0, hashlib.sha256()
                merged = joined_up([(x["begin"], x["end"]) for x in found.as_py()])
                for begin, end in merged:
                    digest.update(data[at:begin])
                    at = end
                digest.update(data[at:])
                gone.append(merged)
                digests.append(digest.hexdigest())
            removed = pa.array([[{"begin": b, "end": e} for b, e in x] for x in gone], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            sizes = [pa.array([sum(e - b for b, e in x) for x in gone], pa.int64()), pa.array([len(x) for x in gone], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sizes, pa.array(digests, pa.string()), removed], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "removed"])

    return marked.select("k1", "k2", "text", "spans").mapInArrow(run, CUT)


def _keys(text: Column) -> dict[str, Column]:
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("other"), text)}


def long_matches(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) of each row: ``removed`` are the maximal runs of bytes (begin, end) of the text in UTF-8 that
    a string of ``length`` bytes covers which also starts anywhere else, in this row's text or another's.

    Every row is a place of its own, so rows alike in id and text remove each other. Null and
    empty texts and those of fewer bytes have no such strings. Rows keep null ids and repeated ids; other
    columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    long = docs.select(text.alias("text")).where(F.octet_length("text") >= length).withColumns(_keys(F.col("text")))
    texts = long.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.any_value("text").alias("text"))
    texts = cut_lineage(texts.withColumn("mute", F.col("n") > 1))
    by_text = cut_lineage(spans(texts, length, gram, index_bytes).groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    cut = _cut(texts.where("not mute").join(by_text, ["k1", "k2"]))
    # Copies of a text remove each other as a whole.
    size = F.octet_length("text").cast("long")
    gone = F.array(F.struct(F.lit(0).cast("long").alias("begin"), size.alias("end")))
    whole = texts.where("mute").select("k1", "k2", size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), gone.alias("removed"))
    changed = cut_lineage(cut.unionByName(whole))
    rows = docs.select(F.col(id_col), text.alias("_text")).select(id_col, *[c.alias(k) for k, c in _keys(F.col("_text")).items()], F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("_all"))
    found = rows.join(changed, ["k1", "k2"], "left")
    none = F.lit(0).cast("long")
    return found.select(
        id_col, "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "_all").alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("removed"),
    )


def without_removed(docs: DataFrame, matches: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``kept``: the bytes of its text (null: none) that ``matches`` leaves. Ids must be unique and not null."""

    @F.arrow_udf("binary")
    def rest(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.cast(pa.binary()).to_pylist(), found.to_pylist(), strict=True):
            data, at, parts = text or b"", 0, []
            for span in spans or []:
                parts.append(data[at : span["begin"]])
                at = span["end"]
            out.append(b"".join([*parts, data[at:]]))
        return pa.array(out, pa.binary())

    removed = matches.select(id_col, F.col("removed").alias("_removed"))
    return docs.join(removed, id_col, "left").withColumn("kept", rest(F.col(text_col).cast("string"), F.col("_removed"))).drop("_removed")
