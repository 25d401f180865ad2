"""Stored tables: checks, upsert, cascade delete, and all-or-nothing publishing.

A store is a folder of Parquet parts plus numbered manifests. A manifest names the parts that make up
the two tables; publishing writes new parts first and then adds the next manifest. Readers follow the
highest manifest, so they see all of a load or nothing of it, and no part is ever overwritten.
"""

from __future__ import annotations

import json
import uuid as uuidlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lorekeep import schemas
from lorekeep.functions import ids

SOURCE_KEY = ["business_id", "source_url"]


# ---- checks -------------------------------------------------------------------------------------


def split_uuid(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a valid UUID (rewritten to canonical form) and the quarantined rest."""
    good = rows.filter(ids.uuid_valid(F.col(column)))
    bad = rows.filter(~ids.uuid_valid(F.col(column)))
    return good.withColumn(column, ids.uuid_canonical(F.col(column))), bad


def _broken(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def _rules(table: str, width: int | None = None, uuid: bool = False) -> dict[str, Column]:
    if table == "sources":
        rules = {f"{c}_not_null": F.col(c).isNotNull() for c in ("business_id", "source_url")}
        rules["source_type_allowed"] = F.col("source_type").isin(*schemas.SOURCE_TYPES)
        rules["category_allowed"] = F.col("category").isin(*schemas.CATEGORIES)
        rules["status_allowed"] = F.col("status").isin(*schemas.STATUSES)
        return rules
    rules = {f"{c}_not_null": F.col(c).isNotNull() for c in ("business_id", "category", "title", "content")}
    if uuid:
        rules["business_id_uuid"] = F.col("business_id").isNull() | ids.uuid_valid(F.col("business_id"))
    if width is not None:
        rules["embedding_width"] = F.col("embedding").isNull() | (F.size("embedding") == width)
    return rules


def constraint_violations(rows: DataFrame, table: str, key: str = "id", width: int | None = None, uuid: bool = False) -> DataFrame:
    """One row per broken rule: key, rule. ``table`` is ``sources`` or ``entries``; vectors of entries must have
    ``width`` numbers where that is given, and may be null; with ``uuid`` their businesses must be UUIDs."""
    return rows.select(key, F.explode(_broken(_rules(table, width, uuid))).alias("rule"))


def counted(rows: DataFrame, seen: Observation, table: str, width: int | None = None, uuid: bool = False) -> DataFrame:
    """``rows``, whose broken rules are counted in ``seen`` by the job that writes them."""
    broken = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in _rules(table, width, uuid).items()]
    return rows.observe(seen, *broken)


def require_unbroken(seen: Observation, what: str) -> None:
    found = {rule: n for rule, n in seen.get.items() if n}
    if found:
        raise ValueError(f"{what}: {found}")


def duplicate_keys(sources: DataFrame) -> DataFrame:
    """(business_id, source_url) pairs that occur more than once."""
    return sources.groupBy(*SOURCE_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _orphans(rows: DataFrame, column: str, parents: DataFrame, parent: str, rule: str) -> DataFrame:
    """Keys without a parent, with their row counts. Keys are reduced before they meet the parents,
    so a key that most rows share costs one row."""
    keys = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key"))
    counted = keys.agg(F.count(F.lit(1)).alias("n_rows"))
    known = parents.select(F.col(parent).alias("key"))
    return counted.join(known, "key", "left_anti").select(F.lit(rule).alias("rule"), "key", "n_rows")


def fk_violations(entries: DataFrame, sources: DataFrame, businesses: DataFrame) -> DataFrame:
    """Foreign keys without a parent: rule, key, n_rows."""
    return (
        _orphans(entries, "business_id", businesses, "id", "entries.business_id")
        .unionByName(_orphans(entries, "source_id", sources, "id", "entries.source_id"))
        .unionByName(_orphans(sources, "business_id", businesses, "id", "sources.business_id"))
    )


def require_none(violations: DataFrame, what: str) -> None:
    found = violations.take(5)
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


# ---- changes ------------------------------------------------------------------------------------


def source_lookup(sources: DataFrame, source_id: str | None = None, business_id: str | None = None, source_url: str | None = None) -> DataFrame:
    """Sources by id, or by business and URL."""
    if source_id is not None:
        return sources.filter(F.col("id") == source_id)
    return sources.filter((F.col("business_id") == business_id) & (F.col("source_url") == source_url))


def source_upsert(existing: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Full source table after announcing a load of ``incoming``.

    ``incoming`` has business_id, source_url, category, source_type, crawl_internal, description and
    seq; a key listed more than once counts as its last listing, with the last non-null description.
    """
    at = F.col("seq")
    last = incoming.groupBy(*SOURCE_KEY).agg(
        F.max_by(F.struct("category", "source_type", "crawl_internal"), at).alias("_new"),
        F.max(F.when(F.col("description").isNotNull(), F.struct(at, F.col("description")))).alias("_text"),
    )
    old = existing.select(*SOURCE_KEY, F.struct(*schemas.SOURCES.fieldNames()).alias("_old"))
    joined = old.join(last, SOURCE_KEY, "full_outer")
    hit = F.col("_new").isNotNull()
    values = {
        "id": F.coalesce("_old.id", ids.stable_id(F.col("business_id"), F.col("source_url"))),
        "business_id": F.col("business_id"),
        "source_url": F.col("source_url"),
        "source_type": F.when(hit, F.col("_new.source_type")).otherwise(F.col("_old.source_type")),
        "category": F.when(hit, F.col("_new.category")).otherwise(F.col("_old.category")),
        "description": F.coalesce("_text.description", "_old.description"),
        "crawl_internal": F.when(hit, F.coalesce("_new.crawl_internal", F.lit(True))).otherwise(F.col("_old.crawl_internal")),
        "status": F.when(hit, "loading").otherwise(F.col("_old.status")),
        "last_loaded_at": F.col("_old.last_loaded_at"),
        "error_message": F.when(~hit, F.col("_old.error_message")),
        "entry_count": F.when(hit, 0).otherwise(F.col("_old.entry_count")),
        "is_active": F.when(hit, True).otherwise(F.col("_old.is_active")),
        "created_at": F.coalesce(F.col("_old.created_at"), as_of),
        "updated_at": F.when(hit, as_of).otherwise(F.col("_old.updated_at")),
    }
    return joined.select(*[column.cast(schemas.SOURCES[name].dataType).alias(name) for name, column in values.items()])


def source_mark_loaded(sources: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Applies load outcomes (source_id, entry_count, error_message): ``failed`` when there is an
    error text, else ``loaded``. Sources without an outcome stay as they are."""
    seen = outcomes.select(F.col("source_id").alias("id"), F.struct("entry_count", "error_message").alias("_out"))
    joined = sources.join(seen, "id", "left")
    hit = F.col("_out").isNotNull()
    error = F.col("_out.error_message")
    changed = {
        "status": F.when(hit, F.when(error.isNotNull(), "failed").otherwise("loaded")).otherwise(F.col("status")),
        "last_loaded_at": F.when(hit, as_of).otherwise(F.col("last_loaded_at")),
        "entry_count": F.when(hit, F.col("_out.entry_count")).otherwise(F.col("entry_count")).cast("int"),
        "error_message": F.when(hit, error).otherwise(F.col("error_message")),
        "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
    }
    return joined.withColumns(changed).select(*sources.columns)


def cascade_delete(entries: DataFrame, deleted: DataFrame, source_id: str = "id") -> DataFrame:
    """Entries whose source is not among the deleted ones; entries without a source stay."""
    gone = deleted.select(F.col(source_id).alias("source_id")).distinct()
    return entries.join(gone, "source_id", "left_anti").select(*entries.columns)


def with_entry_defaults(entries: DataFrame, as_of: Column) -> DataFrame:
    """Fills the defaulted columns of new entries and brings them to the table's shape."""
    have = set(entries.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    filled = entries.withColumns(
        {
            "is_active": given("is_active", F.lit(True)),
            "created_at": given("created_at", as_of),
            "updated_at": given("updated_at", as_of),
        }
    )
    return filled.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.ENTRIES])


# ---- the store ----------------------------------------------------------------------------------


class Store:
    """Knowledge tables under one folder of a file system that all executors share. Entries whose vectors do not
    have ``width`` numbers are refused."""

    def __init__(self, spark: SparkSession, root: str, width: int = schemas.VECTOR_DIM):
        self.spark = spark
        self.root = root.rstrip("/")
        self.width = width

    # manifests

    def _hadoop(self):
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        return jvm, folder.getFileSystem(conf), folder

    def versions(self) -> list[int]:
        _, fs, folder = self._hadoop()
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "sources": None, "entries": [], "tombstones": [], "batches": {}}
        version = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.root}/manifests/v{version:012d}.json", wholetext=True)
        return json.loads(text.first()[0])

    def _commit(self, manifest: dict) -> None:
        """Adds the next manifest; fails if another writer has taken its number meanwhile."""
        jvm, fs, folder = self._hadoop()
        fs.mkdirs(folder)
        path = jvm.org.apache.hadoop.fs.Path
        draft = path(folder, f".draft-{uuidlib.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, path(folder, f"v{manifest['version']:012d}.json"), no_overwrite)

    # reading

    def sources(self, manifest: dict | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        if not manifest["sources"]:
            return schemas.empty_table(self.spark, schemas.SOURCES)
        return self.spark.read.schema(schemas.SOURCES).parquet(f"{self.root}/{manifest['sources']}")

    def entries(self, manifest: dict | None = None) -> DataFrame:
        """Current entries. Parts are partitioned by business_id, so a tenant filter prunes the scan;
        the anti-join against deleted sources is planned only when there are any."""
        manifest = manifest or self.manifest()
        if not manifest["entries"]:
            return schemas.empty_table(self.spark, schemas.ENTRIES)
        rows = self._read_parts(manifest["entries"])
        if manifest["tombstones"]:
            dead = self.spark.read.schema("source_id string, through long").parquet(
                *[f"{self.root}/{part}" for part in manifest["tombstones"]]
            )
            dead = dead.groupBy(F.col("source_id").alias("_dead")).agg(F.max("through").alias("_through"))
            gone = (F.col("source_id") == F.col("_dead")) & (F.col("load_seq") <= F.col("_through"))
            rows = rows.join(dead, gone, "left_anti")
        return rows.select(*schemas.ENTRIES.fieldNames())

    def _read_parts(self, parts: list[str]) -> DataFrame:
        """One scan over all parts; ``part`` and ``business_id`` are partition columns."""
        stored = StructType(schemas.ENTRIES.fields + [StructField("load_seq", LongType()), StructField("part", StringType())])
        reader = self.spark.read.schema(stored).option("basePath", f"{self.root}/entries")
        return reader.parquet(*[f"{self.root}/{part}" for part in parts])

    # writing

    def write_entries(self, entries: DataFrame, version: int, placed: bool = False) -> str:
        """Writes a part of entries and returns its path. Rebalancing gives files of even size: small
        tenants share tasks, a tenant that holds much of the load is split over many. Rows that are
        ``placed`` so already are not moved again."""
        part = f"entries/part={uuidlib.uuid4().hex}"
        rows = entries.withColumn("load_seq", F.lit(version).cast("long"))
        rows = rows if placed else rows.hint("rebalance", "business_id")
        writer = rows.sortWithinPartitions("business_id", "source_id").write.partitionBy("business_id")
        # vectors hardly repeat a value, so a dictionary for them is wasted work
        writer.option("parquet.enable.dictionary#embedding.list.element", "false").parquet(f"{self.root}/{part}")
        return part

    def publish(
        self,
        sources: DataFrame,
        parts: list[str] | None = None,
        deleted: DataFrame | None = None,
        base: dict | None = None,
        batch: tuple[str, int] | None = None,
    ) -> int:
        """Makes new sources, entry parts and deletions visible at once; returns the version.

        ``deleted`` has a column ``source_id``; entries of those sources from earlier versions
        vanish. ``base`` is the manifest the change was computed from.
        """
        base = base or self.manifest()
        version = base["version"] + 1
        table = f"sources/{uuidlib.uuid4().hex}"
        shaped = sources.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.SOURCES])
        shaped.hint("rebalance").write.parquet(f"{self.root}/{table}")
        tombstones = list(base["tombstones"])
        if deleted is not None:
            stone = f"tombstones/{uuidlib.uuid4().hex}"
            gone = deleted.select("source_id").distinct().withColumn("through", F.lit(version - 1).cast("long"))
            gone.write.parquet(f"{self.root}/{stone}")
            tombstones.append(stone)
        batches = dict(base.get("batches", {}))
        if batch:
            batches[batch[0]] = batch[1]
        self._commit(
            {
                "version": version,
                "sources": table,
                "entries": base["entries"] + list(parts or []),
                "tombstones": tombstones,
                "batches": batches,
            }
        )
        return version

    def announce_sources(self, incoming: DataFrame, as_of: Column) -> int:
        """Creates or updates sources on their own; see ``source_upsert``."""
        base = self.manifest()
        return self.publish(source_upsert(self.sources(base), incoming, as_of), base=base)

    def mark_loaded(self, outcomes: DataFrame, as_of: Column) -> int:
        """Records load outcomes (source_id, entry_count, error_message) on their own."""
        base = self.manifest()
        return self.publish(source_mark_loaded(self.sources(base), outcomes, as_of), base=base)

    def delete_sources(self, deleted: DataFrame) -> int:
        """Removes sources (column ``id``) together with their entries."""
        base = self.manifest()
        kept = self.sources(base).join(deleted.select("id"), "id", "left_anti").select(*schemas.SOURCES.fieldNames())
        return self.publish(kept, deleted=deleted.select(F.col("id").alias("source_id")), base=base)

    def compact(self) -> int:
        """Rewrites the current entries as one part without tombstones."""
        base = self.manifest()
        version = base["version"] + 1
        part = self.write_entries(self.entries(base), version)
        fresh = {**base, "entries": [], "tombstones": []}
        return self.publish(self.sources(base), parts=[part], base=fresh)


def entries_append(store: Store, entries: DataFrame, as_of: Column) -> int:
    """Appends entries to the store, defaults filled in, as a version of its own."""
    base = store.manifest()
    shaped = with_entry_defaults(entries, as_of)
    require_none(constraint_violations(shaped, "entries", width=store.width), "entries break constraints")
    part = store.write_entries(shaped, base["version"] + 1)
    return store.publish(store.sources(base), parts=[part], base=base)
