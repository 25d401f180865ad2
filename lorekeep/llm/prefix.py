"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, modulo two primes, the sum of c[i] * B**i over its first code points. Two
of its entries give the hash of any span, so spans are compared in constant time, and the longest common
extension of two places is found by binary search. A fingerprint is the hash of the whole text and the 64
smallest of the hashes of its spans of 24 code points; of a text under 96, shorter spans (a power of two, at most
a quarter of the text) are among them, so that halves in common show at every length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two primes below 2**31, and a base for each.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_017)
SPAN, KEPT = 24, 64


class Powers:
    """Powers of the bases and of their inverses, longer when asked."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def upto(self, n: int) -> None:
        for k, prime in enumerate(PRIMES):
            for rows, base in ((self.up, BASES[k]), (self.down, pow(BASES[k], -1, prime))):
                while len(rows[k]) <= n:
                    have = rows[k]
                    rows[k] = np.concatenate((have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)))


class Prefix:
    """The prefix arrays of a text."""

    def __init__(self, codes: np.ndarray, powers: Powers) -> None:
        self.codes, self.n, self.powers = codes, len(codes), powers
        powers.upto(self.n)
        wide = codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for k, prime in enumerate(PRIMES):
            terms = wide * powers.up[k][: self.n] % np.uint64(prime)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(prime))))

    def span(self, begin: int, end: int) -> tuple[int, ...]:
        """The hash of the code points from begin to end, wherever they stand."""
        found = []
        for k, prime in enumerate(PRIMES):
            low, high = int(self.sums[k][begin]), int(self.sums[k][end])
            found.append((high - low) * int(self.powers.down[k][begin]) % prime)
        return tuple(found)

    def common(self, begin: int, other: Prefix, at: int) -> int:
        """The longest common extension of self from begin and other from at."""
        low, high = 0, min(self.n - begin, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(begin, begin + middle) == other.span(at, at + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def mixed(self, size: int) -> np.ndarray:
        """The hash of each span of so many code points, with both primes in it."""
        mixed = np.zeros(self.n - size + 1, np.uint64)
        for k, prime in enumerate(PRIMES):
            p, s = np.uint64(prime), self.sums[k]
            own = (s[size:] + p - s[:-size]) % p * self.powers.down[k][: len(mixed)] % p
            mixed = (mixed ^ own) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return mixed

    def sketch(self) -> np.ndarray:
        """The smallest mixed hashes of the spans, distinct and sorted."""
        if not self.n:
            return np.zeros(0, np.uint32)
        mixed = self.mixed(SPAN) if self.n >= SPAN else np.zeros(0, np.uint64)
        if self.n < 4 * SPAN:
            mixed = np.append(self.mixed(1 << max((self.n // 4).bit_length() - 1, 0)), mixed)
        mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
        few = KEPT
        while few < len(mixed):
            low = np.unique(np.partition(mixed, few)[: few + 1])
            if len(low) >= KEPT:
                return low[:KEPT]
            few *= 4
        return np.unique(mixed)[:KEPT]

    def fingerprint(self) -> str:
        whole = "".join(f"{x:08x}" for x in self.span(0, self.n))
        return f"{self.n:x}-{whole}-" + "".join(f"{x:08x}" for x in self.sketch().tolist())


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), "<u4")


def likeness(a: str, b: str) -> float:
    """The share of spans that two texts have in common, from their fingerprints: 1 for equal ones. The
    smallest hashes of both together are a sample of all spans, of which Jaccard and so Dice are estimated."""
    if a == b:
        return 1.0
    one, two = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (a.rsplit("-", 1)[1], b.rsplit("-", 1)[1]))
    sample = sorted(one | two)[:KEPT]
    if not sample:
        return 0.0
    share = sum(x in one and x in two for x in sample) / len(sample)
    return 2 * share / (1 + share)


def _part(id_: Column, splits: list[float]) -> Column:
    """How many split points are at or below the id; a null id is in the first part."""
    return F.coalesce(F.size(F.filter(F.lit(splits), lambda s: s <= id_)), F.lit(0)) if splits else F.lit(0)


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(part, guard, id, text), each part in one task and sorted: its rows by id (null first, then by text),
    and then, as guard, the row that follows its last one. After the last row of all comes the first.

    The split points are quantiles of the ids; ``parts`` bounds them and the guards, which go by broadcast.
    Each text moves once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    probes = [i / parts for i in range(1, parts)]
    splits = sorted(set(rows.stat.approxQuantile("id", probes, 0.25 / parts))) if parts > 1 else []
    placed = rows.select(_part(F.col("id"), splits).alias("part"), F.lit(0).alias("guard"), "id", "text")
    firsts = sorted((r["part"], r["first"]["id"]) for r in placed.groupBy("part").agg(F.min(F.struct("id")).alias("first")).collect())
    if not firsts:
        return placed
    following = [(part, firsts[(i + 1) % len(firsts)][1]) for i, (part, _) in enumerate(firsts)]
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    wanted = F.broadcast(spark.createDataFrame(following, f"to int, first {kind}"))  # at most ``parts`` rows
    guards = rows.join(wanted, F.col("id").eqNullSafe(F.col("first"))).select(F.col("to").alias("part"), F.lit(1).alias("guard"), "id", "text")
    return placed.unionByName(guards).repartition(parts, "part").sortWithinPartitions("part", "guard", "id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """For each row of ``docs``: its fingerprint, that of its edited text (its last half, rounded down, replaced
    by as many code points from the start of the next document, or all it has), and the likeness of its own to
    the edited text's and to the next document's; shared_edited and shared_next are the longest common starts.

    A null text is an empty one; an empty text has no spans and is like empty texts alone. Repeated ids are
    ordered by text; a single document follows itself; an empty table gives an empty result. Other columns
    are ignored. A task holds two texts at a time beside its batch.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_edited", "shared_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        powers, held = Powers(), None
        for batch in batches:
            ids, done = batch.column(2), []
            for part, guard, id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids.to_pylist(), batch.column(3), strict=True):
                if guard and (held is None or held[0] != part):
                    continue
                own = Prefix(code_points(text.as_py()), powers)
                mark = own.fingerprint()
                if held is not None:
                    _, before, start, named = held
                    take = start.n // 2
                    codes = np.concatenate((start.codes[: start.n - take], own.codes[:take]))
                    edited = Prefix(codes, powers)
                    changed = edited.fingerprint()
                    digest = hashlib.sha256(codes.astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest()
                    done.append((before, start.n, digest, named, changed, likeness(named, changed), likeness(named, mark), start.common(0, edited, 0), start.common(0, own, 0)))
                held = None if guard else (part, id_, own, mark)
            if done:
                columns = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids.type), *map(pa.array, columns[1:])], names=names)

    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_edited long, shared_next long"
    return with_next(docs, id_col, text_col, parts).mapInArrow(run, schema)
