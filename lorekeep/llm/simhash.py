"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Two that differ in at most 3 bits differ in at most 1 bit of their lower or of
their upper half. The anchors of a half are the words of a covering code: bits 0-30 are a word of the
perfect [31, 26] Hamming code, bit 31 is free, so each half lies within radius 1 of its own anchor (home).
Each fingerprint also visits every anchor within radius + threshold = 2, which is 1 + 15 + 1 anchors at
most; so one of two linked fingerprints always visits the home of the other. Only there are they compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.components import components
from lorekeep.session import cut_lineage

MAX_BITS = 3
SHINGLE = 3
#: Homes of one anchor that are compared at once; an anchor with more is cut into parts of about this size.
HOMES = 4096
#: Cells of one comparison in memory.
CELLS = 1 << 20


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text: XXH64 (seed 42) of its word shingles, majority per bit; 0 without words."""
    import xxhash

    words = data.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], 42) for a, b in spans), ">u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CELLS // 64):
        ones += np.unpackbits(hashes[at : at + CELLS // 64].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, fp: long) for each row; a null or wordless text has fingerprint 0. tag is a hash of the text."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, tag long, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint((x.as_py() or "").encode()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["id", "tag", "fp"])

    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, schema)


def _syndrome_tables() -> tuple[np.ndarray, np.ndarray]:
    """By byte place and value, the XOR of the numbers (from 1) of the set bits; by syndrome, the 15 pairs
    of bits that also reach a code word."""
    places = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and place * 8 + bit < 31:
                    places[place, value] ^= place * 8 + bit + 1
    pairs = np.zeros((32, 15), np.uint32)
    for s in range(1, 32):
        pairs[s] = [1 << i - 1 | 1 << (i ^ s) - 1 for i in range(1, 32) if i < i ^ s]
    return places, pairs


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``fps``, anchor key, at home?) of each visit."""
    places, pairs = _syndrome_tables()
    rows, keys, homes = [], [], []

    def visit(at: np.ndarray, key: np.ndarray, home: bool) -> None:
        rows.append(at)
        keys.append(key)
        homes.append(np.full(len(at), home))

    for half in (0, 1):
        word = (fps >> np.uint64(32 * half)).astype(np.uint32)
        code = word & np.uint32(0x7FFFFFFF)
        syndrome = places[0, code & 255] ^ places[1, code >> 8 & 255] ^ places[2, code >> 16 & 255] ^ places[3, code >> 24]
        fix = np.where(syndrome > 0, np.uint32(1) << (np.maximum(syndrome, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
        label = np.int64(half) << np.int64(32)
        every, off = np.arange(len(fps)), np.flatnonzero(syndrome)
        visit(every, (word ^ fix).astype(np.int64) | label, True)
        visit(every, (word ^ fix ^ np.uint32(1 << 31)).astype(np.int64) | label, False)
        wide = word[off, None] ^ pairs[syndrome[off]]
        visit(np.repeat(off, 15), wide.ravel().astype(np.int64) | label, False)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            rows, keys, homes = anchors(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(homes), pa.array(part[rows])], names=["anchor", "home", "fp"])


class _Anchor:
    """The homes of one anchor, or of one part of it, while its visitors pass."""

    def __init__(self) -> None:
        self.homes = np.zeros(0, np.uint64)
        self.label = np.zeros(0, np.int64)

    def add(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.homes = np.concatenate((self.homes, fps))
        self.label = np.concatenate((self.label, np.arange(len(self.label), len(self.homes))))
        yield from self.meet(fps)

    def meet(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One edge for each visitor that is near a home; homes near the same visitor get one label."""
        m = len(self.homes)
        step = max(1, CELLS // max(1, m))
        for at in range(0, len(fps) if m else 0, step):
            own = fps[at : at + step]
            near = np.bitwise_count(own[:, None] ^ self.homes[None, :]) <= MAX_BITS
            hit = near.any(axis=1)
            near, own = near[hit], own[hit]
            if not len(own):
                continue
            yield own, self.homes[near.argmax(axis=1)]
            while True:
                low = np.where(near, self.label, m).min(axis=1)
                split = np.flatnonzero(low < np.where(near, self.label, -1).max(axis=1))
                if not len(split):
                    break
                row = near[split[0]]
                self.label[np.isin(self.label, self.label[row])] = low[split[0]]

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        return self.homes, self.homes[self.label] if len(self.homes) else self.homes


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) from visits sorted by anchor, part, homes first. At most one edge for each row and one
    more for each home leave, which keep every component whole. Memory: one batch and one part's homes."""
    key, open_at = None, _Anchor()
    for batch in batches:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        anchor, part, guest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fps = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fps)]))
        useful = (ends - starts > 1) & ~guest[starts]
        useful[[0, -1]] = True
        for a, b in zip(starts[useful].tolist(), ends[useful].tolist(), strict=True):
            if (anchor[a], part[a]) != key:
                found.append(open_at.close())
                key, open_at = (anchor[a], part[a]), _Anchor()
            own = ~guest[a:b]
            if own.any():
                found += open_at.add(fps[a:b][own])
            found += open_at.meet(fps[a:b][~own])
        yield _edges(found)
    yield _edges([open_at.close()])


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
    v = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
    keep = u != v
    return pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(v[keep].view(np.int64))], names=["u", "v"])


def links(fps: DataFrame, homes: int = HOMES) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that join exactly those within 3 bits into components.

    An anchor that is home to more than ``homes`` fingerprints is cut into parts; each of its visitors goes
    to every part, so that no task holds more than about ``homes`` of them."""
    distinct = fps.select("fp").distinct()
    visits = distinct.mapInArrow(_visits, "anchor long, home boolean, fp long")
    crowd = visits.where("home").groupBy("anchor").count().where(F.col("count") > homes)
    crowd = crowd.select("anchor", F.ceil(F.col("count") / homes).cast("int").alias("parts"))
    placed = visits.join(crowd, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.select("anchor", "home", "fp", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    at_home = F.col("home") & (F.pmod(F.xxhash64("fp"), F.col("parts")) == F.col("part"))
    placed = placed.select("anchor", "part", (~at_home).alias("guest"), "fp")
    return placed.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "guest").mapInArrow(_linked, "u long, v long")


def _classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, fp, root, component_id) for each row of ``docs``; root is a fingerprint of the component and its key."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col))
    named = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = cut_lineage(components(links(rows)))
    marked = named.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    marked = cut_lineage(marked)
    best = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(marked.join(best, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Rows whose fingerprints differ in at most 3 bits are linked, equal ones included; component_id is the
    smallest id reachable. Null and wordless texts have fingerprint zero and are linked like any other.
    Repeated rows and ids each keep their row. A null id is not a smallest id unless its whole component has
    none. Other columns are ignored; an empty table gives an empty result.
    """
    classed = _classed(docs, id_col, text_col)
    return classed.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``near_duplicates``, all columns kept: that of the smallest id. Of rows
    alike in id and text one stays; rows of one id but different texts are told apart by a hash of the text.
    Components are told apart by their root, as ids may repeat or be null in several of them."""
    first = _classed(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("root").agg(F.min(F.struct("id", "tag")).alias("_row")).select("_row")
    rows = docs.withColumn("_row", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag")))
    return rows.join(first, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
