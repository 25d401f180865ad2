"""Tenant-filtered cosine search: exact for one or many questions, and approximate by cells;
metadata and keyword lookups over the same entries."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from lorekeep.functions import text as tx
from lorekeep.functions import titles as mx
from lorekeep.functions import vectors as vx
from lorekeep.session import place, scratch_path

MATCH_THRESHOLD = 0.7
MATCH_COUNT = 3
LISTS = 100
SHELVES = 256
# Questions that a task holds at a time, and entries of a business that stream past them.
BLOCK_ROWS = 8192
ENTRY_ROWS = 16384
# Vectors stored in one piece of a block, entries scored at a time, scores of one product, and pairs scored again in double precision at a time.
STORED, STEP, SCORES, PAIRS = 1024, 4096, 1 << 20, 1024
# Entries scored first, which set the marks that the others have to reach.
FIRST = 512
# Tasks that pairs of blocks are dealt out to, for each of the session's shuffle partitions.
PAIR_TASKS = 4
# At most so many tasks share a block of questions; a task goes on with what it has found for it in its next entry block.
LANES = 16
# Of questions with at most one value in so many that is not zero, a place goes through the product if as many of the questions hold it.
SPARSE = 12
# More than single precision can be wrong by in a product of unit vectors.
SLACK = 1e-4


def kb_scan(entries: DataFrame) -> DataFrame:
    """The columns a search returns, with the content named ``text``."""
    return entries.select(
        "id", "business_id", "category", "title", F.col("content").alias("text"), "metadata", "created_at", "updated_at"
    )


def eligible(entries: DataFrame, business_id: str, question: list[float] | Column, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Active entries of one business at least ``threshold`` similar to the question.

    The tenant and activity filters reach the scan; only what they leave is scored.
    """
    scoped = entries.filter((F.col("business_id") == business_id) & F.col("is_active"))
    vector = F.col("embedding")
    alike = vx.cosine_similarity(vector, question) if isinstance(question, Column) else vx.similarity_to(vector, question)
    return scoped.withColumn("similarity", alike).filter(F.col("similarity") >= threshold)


def search(
    entries: DataFrame, business_id: str, question: list[float] | Column, threshold: float = MATCH_THRESHOLD, k: int = MATCH_COUNT
) -> DataFrame:
    """Best ``k`` entries for a single question; ties go to the smaller id."""
    hits = eligible(entries, business_id, question, threshold)
    return hits.orderBy(F.desc("similarity"), F.asc("id")).limit(k)


class _Best:
    """The best k entries seen so far of each question of one block and width. Questions come packed; of entries, ``rows`` are the
    vectors and ``norm`` their lengths."""

    def __init__(self, keys: list, places: pa.Array, values: pa.Array, width: int, element: str, threshold: float, k: int) -> None:
        self.k = k
        sizes, norm = map(np.array, zip(*((len(row), np.sqrt(np.dot(row, row))) for _, row in vx.values(places, values, width, element)), strict=True))
        self.keys = [key for key, n in zip(keys, norm, strict=True) if n > 0]
        self.sparse = sizes.sum() * SPARSE <= len(sizes) * width
        self.floor = np.full(len(self.keys), threshold)
        self.pool = pd.DataFrame({"q": np.empty(0, np.int64), "id": np.empty(0, object), "s": np.empty(0)})
        units = ((at, row / n) for (at, row), n in zip(vx.values(places, values, width, element), norm, strict=True) if n > 0)
        if not self.sparse or not self.keys:
            self.unit = np.zeros((len(self.keys), width))
            for unit, (at, row) in zip(self.unit, units, strict=True):
                unit[at] = row
            self.common, self.single, self.rest = None, self.unit.astype(np.float32), None
            return
        units = list(units)
        self.sizes = np.array([len(at) for at, _ in units])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.places, self.values = (np.concatenate(column) for column in zip(*units, strict=True))
        del units
        often = np.bincount(self.places, minlength=width) * SPARSE >= len(self.keys)
        self.common, column = np.flatnonzero(often), np.cumsum(often) - 1
        of, held = np.repeat(np.arange(len(self.keys)), self.sizes), often[self.places]
        self.single = np.zeros((len(self.keys), len(self.common)), np.float32)
        self.single[of[held], column[self.places[held]]] = self.values[held]
        ends = np.cumsum(np.bincount(of[~held], minlength=len(self.keys)))[:-1]
        self.rest = list(zip(np.split(self.places[~held], ends), np.split(self.values[~held].astype(np.float32), ends), strict=True))

    def offer(self, ids: np.ndarray, rows: np.ndarray, norm: np.ndarray) -> None:
        """Products in single precision choose the pairs that are computed in double."""
        if len(self.pool) == 0 and len(rows) > FIRST:
            self.offer(ids[:FIRST], rows[:FIRST], norm[:FIRST])
            ids, rows, norm = ids[FIRST:], rows[FIRST:], norm[FIRST:]
        by_place = np.empty(rows.shape[::-1], np.float32)
        np.multiply(rows.T, (1 / norm).astype(rows.dtype), out=by_place, casting="same_kind")
        common = by_place if self.common is None else by_place[self.common]
        taken, more = np.empty((max((len(at) for at, _ in self.rest or []), default=0), len(rows)), np.float32), np.empty(len(rows), np.float32)
        asked, near, step = [], [], max(1, SCORES // len(rows))
        for begin in range(0, len(self.keys), step):
            for q, rough in enumerate(self.single[begin : begin + step] @ common, begin):
                if self.rest and len(self.rest[q][0]):
                    at, values = self.rest[q]
                    rough += np.dot(values, by_place.take(at, axis=0, out=taken[: len(at)], mode="clip"), out=more)
                some = (rough >= float(self.floor[q]) - SLACK).nonzero()[0]
                if len(some) > 8 * self.k:
                    least = np.partition(rough[some], len(some) - self.k)[len(some) - self.k]
                    some = some[rough[some] >= least - np.float32(2 * SLACK)]
                if len(some):
                    asked.append(q)
                    near.append(some)
        if near:
            q, r = np.repeat(asked, [len(some) for some in near]), np.concatenate(near)
            score = np.concatenate([self._exact(q[at : at + PAIRS], rows, norm, r[at : at + PAIRS]) for at in range(0, len(q), PAIRS)])
            good = score >= self.floor[q]
            self._keep(q[good], ids[r[good]], score[good])

    def _exact(self, q: np.ndarray, rows: np.ndarray, norm: np.ndarray, r: np.ndarray) -> np.ndarray:
        if not self.sparse:
            return np.einsum("ij,ij->i", rows[r] / norm[r, None], self.unit[q]).round(12)
        sizes = self.sizes[q]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.starts[q] - starts, sizes)
        products = rows[np.repeat(r, sizes), self.places[at]] * self.values[at]
        return (np.add.reduceat(products, starts) / norm[r]).round(12)

    def _keep(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        pool = pd.concat([self.pool, pd.DataFrame({"q": q, "id": ids, "s": score})], ignore_index=True)
        pool = pool.sort_values(["q", "s", "id"], ascending=[True, False, True])
        place = pool.groupby("q", sort=False).cumcount()
        self.pool = pool[place < self.k]
        full = pool[place == self.k - 1]
        self.floor[full["q"]] = full["s"]


def _element(asked: DataFrame, scan: DataFrame) -> str:
    kinds = {rows.schema["embedding"].dataType.elementType.typeName() for rows in (asked, scan)}
    return "<f4" if kinds == {"float"} else "<f8"


def _runs(batch: pa.RecordBatch, key: list[str]) -> Iterator[tuple[list, int, int]]:
    """Key, begin and end of the rows in a row that share a key."""
    of = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
    starts = [i for i in range(len(of)) if i == 0 or of[i] != of[i - 1]]
    for begin, end in zip(starts, [*starts[1:], len(of)], strict=True):
        yield list(of[begin]), begin, end


def _stored(rows: DataFrame, key: list[str], side: str, folder: str) -> DataFrame:
    """Writes the vectors (key, side, width, places, values) of each block, once, to the shared folder: a file for each task, in it
    an Arrow stream for each block. Where the blocks are: (key, side + "_file", side + "_at").

    Files have names that no other attempt uses, and only those of a finished task are read.
    """
    schema = StructType([rows.schema[c] for c in key]).add(f"{side}_file", "string").add(f"{side}_at", "long")
    arrows, stored, size = [to_arrow_type(f.dataType) for f in schema], [side, *vx.PACKED.fieldNames()], STORED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = current = stream = None
        files, root = place(folder)
        name = uuid.uuid4().hex
        for batch in batches:
            begun = []
            for here, begin, end in _runs(batch, key):
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                if here != current:
                    if stream is not None:
                        stream.close()
                    begun.append([*here, name, out.tell()])
                    current, stream = here, pa.ipc.new_stream(out, batch.select(stored).schema)
                for at in range(begin, end, size):
                    stream.write_batch(batch.select(stored).slice(at, min(size, end - at)))
            columns = zip(*begun, strict=True) if begun else [[] for _ in arrows]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrows, strict=True)], names=schema.fieldNames())
        if out is not None:
            stream.close()
            out.close()

    return rows.repartition(*key).sortWithinPartitions(*key).select(*key, *stored).mapInArrow(run, schema)


def _pairs(asked: DataFrame, scan: DataFrame, scope: list[str], folder: str) -> DataFrame:
    """Questions and entries of each scope, cut into blocks on both sides and stored once, in ``folder``. A pair of blocks is a row
    that says where they are: (scope, _e, _q, question_id_file, question_id_at, id_file, id_at). So what is written grows with
    questions plus entries, however many blocks a scope has.
    """

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy(*scope).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    def dealt(key: str, parts: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(parts)).cast("int")

    sizes = blocks(asked, BLOCK_ROWS, "_nq").join(blocks(scan, ENTRY_ROWS, "_ne"), scope)
    # Sizes count rows without a vector as well, so that counting reads and computes no vectors.
    known, held = asked.join(sizes, scope), scan.join(sizes, scope).filter(F.size("embedding") > 0)
    known = known.select(*scope, dealt("question_id", "_nq").alias("_q"), "question_id", "embedding")
    held = held.select(*scope, dealt("id", "_ne").alias("_e"), "id", "embedding")
    element = _element(asked, scan)
    questions = _stored(vx.packed(known, element), [*scope, "_q"], "question_id", folder)
    entries = _stored(vx.packed(held, element), [*scope, "_e"], "id", folder)
    # Pairs are few and small, and each is much work: dealt out evenly, to so many tasks that AQE doesn't join them up.
    tasks = PAIR_TASKS * int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.hash(*scope).cast("long") + F.col("_q").cast("long") * LANES + F.col("_e") % LANES
    pairs = entries.join(questions, scope).repartitionById(tasks, F.pmod(turn, F.lit(tasks)).cast("int"))
    return pairs.sortWithinPartitions(*scope, "_q", "_e")


def _block(files, root: str, pair: dict, side: str) -> Iterator[pa.RecordBatch]:
    """The stored vectors of one side of a pair: (side, width, places, values)."""
    with files.open_input_file(f"{root}/{pair[f'{side}_file']}") as file:
        file.seek(pair[f"{side}_at"])
        yield from pa.ipc.open_stream(file)


def _met(asked: DataFrame, scan: DataFrame, scope: list[str]) -> DataFrame:
    """What the tasks of ``_score`` read, as a table: (scope, _e, _q, _kind, question_id, id, packed), id null for questions.
    A question is read for each entry block of its scope, an entry for each question block, and of each pair of blocks the
    questions come first."""
    folder = scratch_path(scan.sparkSession, "blocks")
    pairs, key = _pairs(asked, scan, scope, folder), [*scope, "_e", "_q"]
    schema = StructType([pairs.schema[c] for c in key]).add("_kind", "integer").add("question_id", asked.schema["question_id"].dataType)
    schema = schema.add("id", scan.schema["id"].dataType).add("packed", vx.PACKED)
    arrows, names = {f.name: to_arrow_type(f.dataType) for f in schema}, schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = place(folder)
        for pair in (pair for batch in batches for pair in batch.to_pylist()):
            for kind, side in enumerate(("question_id", "id")):
                for part in _block(files, root, pair, side):
                    own = {c: pa.repeat(pa.scalar(v, arrows[c]), len(part)) for c, v in [*((c, pair[c]) for c in key), ("_kind", kind)]}
                    own |= {c: part.column(side) if c == side else pa.nulls(len(part), arrows[c]) for c in ("question_id", "id")}
                    own["packed"] = pa.StructArray.from_arrays([part.column(f.name) for f in arrows["packed"]], fields=list(arrows["packed"]))
                    yield pa.RecordBatch.from_arrays([own[c] for c in names], names=names)

    return pairs.mapInArrow(run, schema)


def _score(asked: DataFrame, scan: DataFrame, scope: list[str], threshold: float, k: int) -> DataFrame:
    """Of each block of questions and the entry blocks that a task reads for it, per question the best ``k`` entries at or above the
    threshold. Questions are held, entries stream by."""
    element, folder = _element(asked, scan), scratch_path(scan.sparkSession, "blocks")
    pairs, tenant = _pairs(asked, scan, scope, folder), scope[0]
    schema = StructType([asked.schema["question_id"], scan.schema[tenant], scan.schema["id"]]).add("similarity", "double")
    arrows, names = [to_arrow_type(f.dataType) for f in schema], schema.fieldNames()

    def by_width(parts: list[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for whole in pa.Table.from_batches(parts).combine_chunks().to_batches():
            sizes = whole.column("width").to_numpy()
            for width in np.unique(sizes).tolist():
                yield width, whole.take(pa.array(np.flatnonzero(sizes == width)))

    def steps(parts: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            held.append(part)
            if sum(map(len, held)) >= STEP:
                yield held
                held = []
        if held:
            yield held

    def offer(best: dict[int, _Best], parts: list[pa.RecordBatch]) -> None:
        for width, part in by_width(parts):
            if width in best and best[width].keys:
                rows = vx.unpacked(part.column("places"), part.column("values"), width, element)
                norm = vx.lengths(rows)
                known = np.flatnonzero(norm > 0)
                if len(known) < len(rows):
                    rows, norm, part = rows[known], norm[known], part.take(pa.array(known))
                if len(rows):
                    best[width].offer(np.array(part.column("id").to_pylist(), dtype=object), rows, norm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = place(folder)
        current, best = None, {}

        def results(of: list) -> Iterator[pa.RecordBatch]:
            for block in best.values():
                pool = block.pool
                columns = [[block.keys[i] for i in pool["q"]], [of[0]] * len(pool), pool["id"].tolist(), pool["s"].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrows, strict=True)], names=names)

        for pair in (pair for batch in batches for pair in batch.to_pylist()):
            here = [pair[c] for c in (*scope, "_q")]
            if here != current:
                yield from results(current or [])
                current, best = here, {}
                for width, part in by_width(list(_block(files, root, pair, "question_id"))):
                    columns = (part.column(c) for c in ("places", "values"))
                    best[width] = _Best(part.column("question_id").to_pylist(), *columns, width, element, threshold, k)
            for parts in steps(_block(files, root, pair, "id")):
                offer(best, parts)
        yield from results(current or [])

    return pairs.mapInArrow(run, schema)


def search_batch(
    entries: DataFrame,
    questions: DataFrame,
    threshold: float = MATCH_THRESHOLD,
    k: int = MATCH_COUNT,
    index: CellIndex | None = None,
    nprobe: int = 1,
) -> DataFrame:
    """Best ``k`` entries for each question (question_id, business_id, embedding), each within its
    own business: question_id, business_id, id, similarity, hit_rank.

    One lazy plan at every size. Entries are kept to the scopes asked for (tenant, and with an ``index`` the
    ``nprobe`` nearest cells of each question), which prunes the scan of a table partitioned by them. Each side
    is cut into blocks of some thousand rows, stored once in the shared folder; for each pair of blocks of a scope a task holds the
    questions and lets the entries stream by, so a vector is read once for each block of the other side, never once for each pair.
    A hot tenant is many blocks. Null and zero vectors match nothing, nor do vectors of different lengths.
    """
    scope = ["business_id"] + (["cell"] if index else [])
    asked = questions.select("question_id", "business_id", "embedding").filter(F.size("embedding") > 0)
    if index:
        asked = asked.withColumn("cell", F.explode(index.probes(F.col("embedding"), nprobe)))
    scan = entries.filter(F.col("is_active")).join(asked.select(*scope).distinct(), scope, "left_semi")
    scan = scan.select(*scope, "id", "embedding")
    order = Window.partitionBy("question_id").orderBy(F.desc("similarity"), F.asc("id"))
    scored = _score(asked, scan, scope, threshold, k)
    return scored.withColumn("hit_rank", F.row_number().over(order)).filter(F.col("hit_rank") <= k)


def with_entries(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds the returned columns to ranked hits, within the business of each. Hits are few; AQE measures and broadcasts them."""
    return hits.join(kb_scan(entries), ["business_id", "id"])


def format_hits(hits: DataFrame) -> DataFrame:
    """Result rows: id as text, similarity as double, null metadata as ``{}``, ISO timestamps."""
    return hits.withColumns(
        {
            "id": F.col("id").cast("string"),
            "similarity": F.col("similarity").cast("double"),
            "metadata": F.coalesce("metadata", F.lit("{}")),
            "created_at": tx.iso_timestamp(F.col("created_at")),
            "updated_at": tx.iso_timestamp(F.col("updated_at")),
        }
    )


def context_count(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Number of hits per question, 0 where there is none."""
    counts = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("_n"))
    return questions.select("question_id").join(counts, "question_id", "left").select(
        "question_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("context_count")
    )


class CellIndex:
    """Inverted lists: unit-length centroids, at most a few hundred, so small by construction.

    ``save`` and ``load`` keep them beside the celled table, so that later loads give new vectors their cells
    and searches probe without a new fit.
    """

    def __init__(self, centroids: np.ndarray):
        norm = np.sqrt((centroids * centroids).sum(axis=1))
        self.centroids = centroids / np.where(norm > 0, norm, 1.0)[:, None]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, row) for i, row in enumerate(self.centroids.tolist())]
        spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        return cls(np.array([row["centroid"] for row in spark.read.parquet(path).orderBy("cell").collect()], np.float64))

    def probes(self, embedding: Column, nprobe: int) -> Column:
        """The ``nprobe`` nearest cells of each vector; none for a vector that can't be compared."""
        centroids = self.centroids

        @F.arrow_udf("array<int>")
        def cells(vectors: pa.Array) -> pa.Array:
            found: list[list[int]] = [[]] * len(vectors)
            rows, at = vx.dense(vectors, centroids.shape[1])
            order = np.argsort(-(rows @ centroids.T), axis=1, kind="stable")[:, :nprobe]
            for place, row in zip(at.tolist(), order.tolist(), strict=True):
                found[place] = row
            return pa.array(found, pa.list_(pa.int32()))

        return cells(embedding)

    def assign(self, embedding: Column) -> Column:
        """Cell of each vector; null for a missing vector."""
        centroids = self.centroids

        @F.arrow_udf("int")
        def cell(vectors: pa.Array) -> pa.Array:
            found = np.zeros(len(vectors), dtype=np.int32)
            rows, at = vx.dense(vectors, centroids.shape[1])
            if len(at):
                found[at] = (rows @ centroids.T).argmax(axis=1)
            return pa.array(found, pa.int32(), mask=~np.asarray(vectors.is_valid()))

        return cell.asNondeterministic()(embedding)


def ann_build(entries: DataFrame, lists: int = LISTS, seed: int = 42) -> tuple[DataFrame, CellIndex]:
    """Cells by k-means on unit vectors. Returns the entries with ``cell`` and the index.

    Centroids are fitted on all vectors, whatever their number, and every entry gets a cell. ``save_by(celled, path, "cell")`` lets a search read only the
    cells it probes.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = entries.filter(F.col("embedding").isNotNull())
    norm = F.sqrt(vx.dot(F.col("embedding"), F.col("embedding")))
    unit = known.select(F.transform("embedding", lambda x: x / norm).alias("v"), norm.alias("n")).filter("n > 0")
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(unit.select(array_to_vector("v").alias("features")))
    index = CellIndex(np.array(model.clusterCenters(), dtype=np.float64))
    return entries.withColumn("cell", index.assign(F.col("embedding"))), index


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact hits that an approximate search also returned."""
    pairs = exact.select("question_id", "id").join(
        found.select("question_id", "id", F.lit(1).alias("_hit")), ["question_id", "id"], "left"
    )
    return pairs.agg(
        F.count(F.lit(1)).alias("exact_hits"),
        F.count("_hit").alias("found_hits"),
        F.coalesce(F.count("_hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0)).alias("recall"),
    )


def metadata_filter(rows: DataFrame, metadata: str, key: str, value, as_type: str = "string") -> DataFrame:
    """Rows whose metadata holds ``value`` under ``key``."""
    return rows.filter(mx.metadata_value(F.col(metadata), key, as_type) == F.lit(value))


def keywords(text: Column) -> Column:
    """Distinct lower-case words of a text, punctuation left out."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def postings(entries: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """Postings (term, key, shelf). The shelf is a hash of the term: ``save_by(posted, path, "shelf")``
    lets a lookup read only the shelves of its terms."""
    spread_out = entries.select(F.col(key), F.explode(keywords(F.col(text))).alias("term"))
    return spread_out.withColumn("shelf", _shelf(F.col("term")))


def _shelf(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(SHELVES)).cast("int")


def save_by(rows: DataFrame, path: str, column: str) -> DataFrame:
    """Writes rows partitioned by ``column`` and reads them back. Rebalancing splits a value that
    holds much of the rows over several tasks and files."""
    rows.hint("rebalance", column).write.partitionBy(column).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def keyword_search(posted: DataFrame, terms: list[str], key: str = "id") -> DataFrame:
    """Keys whose text has all terms. Grouping is by key, so a frequent term is no hot spot; a term has one
    posting per key, so they are counted as they are."""
    wanted = sorted({t.lower() for t in terms})
    shelves = F.col("shelf").isin([zlib.crc32(t.encode()) % SHELVES for t in wanted])
    matched = posted.filter(shelves & F.col("term").isin(wanted)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return matched.filter(F.col("_n") == len(wanted)).select(key)
