"""Stored tables, loading, event history and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.functions import urls as ux
from lorekeep.operators import embed, events, quality
from lorekeep.operators import store as st
from lorekeep.plans import load
from lorekeep.plans.catalog.pages_q import SQL_CLEAN, SQL_UNESCAPE
from lorekeep.plans.catalog.registry import (
    CTE_DOCS,
    CTE_ENTRIES,
    CTE_LINES,
    SQL_WORD,
    category_of_lang,
    docs,
    entries,
    lines,
    query,
    sql_stable_id,
    sql_words,
    table,
)
from lorekeep.session import scratch_path
from lorekeep.streaming import history, ingest

BIG = "bigint"
OLD, NOW = 1_600_000_000, 1_700_000_000
WIDTH = 64  # of the given vectors
TENANT = "12345678-1234-5678-1234-567812345678"


def _at(second: int):
    return F.timestamp_seconds(F.lit(second))


# ---- checks -------------------------------------------------------------------------------------

CTE_CHECKED = f"""{CTE_DOCS},
checked AS (
  SELECT doc_id AS id, CASE WHEN n_chars > 300 THEN source END AS business_id, url AS source_url,
         CASE lang WHEN 'en' THEN 'website' WHEN 'de' THEN 'word' ELSE 'text' END AS source_type,
         CASE lang WHEN 'en' THEN 'faq' WHEN 'fr' THEN 'news' ELSE 'policy' END AS category,
         CASE source WHEN 'src1' THEN 'gone' ELSE 'loaded' END AS status FROM docs)"""


@query(
    "constraint_violations",
    f"""
WITH {CTE_CHECKED}, {CTE_ENTRIES}
SELECT id, 'business_id_not_null' AS rule FROM checked WHERE business_id IS NULL
UNION ALL SELECT id, 'source_url_not_null' FROM checked WHERE source_url IS NULL
UNION ALL SELECT id, 'source_type_allowed' FROM checked WHERE source_type NOT IN ('website', 'pdf', 'document', 'text')
UNION ALL SELECT id, 'category_allowed' FROM checked WHERE category NOT IN ('website', 'faq', 'policy', 'pricing', 'procedure', 'technical')
UNION ALL SELECT id, 'status_allowed' FROM checked WHERE status NOT IN ('pending', 'loading', 'loaded', 'failed', 'inactive')
UNION ALL SELECT id, 'embedding_width' FROM entries WHERE lang = 'fr' AND embedding IS NOT NULL
UNION ALL SELECT id, 'business_id_uuid' FROM entries WHERE lang <> 'de'
""",
)
def constraint_violations(spark, folder):
    """Documents as sources, and as entries whose French vectors are a number short and of whose businesses
    only the German are UUIDs, in the form with braces."""
    lang = F.col("lang")
    rows = docs(spark, folder).select(
        F.col("doc_id").alias("id"),
        F.when(F.col("n_chars") > 300, F.col("source")).alias("business_id"),
        F.col("url").alias("source_url"),
        F.when(lang == "en", "website").when(lang == "de", "word").otherwise("text").alias("source_type"),
        F.when(lang == "en", "faq").when(lang == "fr", "news").otherwise("policy").alias("category"),
        F.when(F.col("source") == "src1", "gone").otherwise("loaded").alias("status"),
    )
    stored = entries(spark, folder)
    short = F.when(lang == "fr", F.slice("embedding", 1, WIDTH - 1)).otherwise(F.col("embedding"))
    braced = F.concat(F.lit("{"), F.md5("business_id"), F.lit("}"))
    wrong = stored.withColumns({"embedding": short, "business_id": F.when(lang == "de", braced).otherwise(F.col("business_id"))})
    return st.constraint_violations(rows, "sources").unionByName(st.constraint_violations(wrong, "entries", width=WIDTH, uuid=True))


@query(
    "empty_tables",
    f"""
WITH {CTE_ENTRIES}
SELECT CAST(id AS VARCHAR) AS id, business_id, category, title, content, CAST(NULL AS VARCHAR) AS metadata, source_id, is_active,
       CAST(len(embedding) AS INTEGER) AS width, CAST(NULL AS VARCHAR) AS created_at FROM entries
""",
)
def empty_tables(spark, folder):
    """Documents added to an empty stored table of entries: its columns and types, nulls where they have none."""
    none = schemas.empty_table(spark, schemas.ENTRIES)
    rows = entries(spark, folder).withColumn("id", F.col("id").cast("string")).select("id", "business_id", "category", "title", "content", "embedding", "source_id", "is_active")
    held = none.unionByName(rows, allowMissingColumns=True)
    width = F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("width")
    return held.select("id", "business_id", "category", "title", "content", "metadata", "source_id", "is_active", width, F.col("created_at").cast("string").alias("created_at"))


@query(
    "fk_violations",
    """
WITH biz AS (SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_acctbal > 0),
src AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS VARCHAR) AS business_id FROM part WHERE p_retailprice < 1500)
SELECT 'entries.business_id' AS rule, CAST(l_suppkey AS VARCHAR) AS key, count(*) AS n_rows FROM lineitem
  WHERE CAST(l_suppkey AS VARCHAR) NOT IN (SELECT id FROM biz) GROUP BY l_suppkey
UNION ALL SELECT 'entries.source_id', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem
  WHERE CAST(l_partkey AS VARCHAR) NOT IN (SELECT id FROM src) GROUP BY l_partkey
UNION ALL SELECT 'sources.business_id', business_id, count(*) FROM src WHERE business_id NOT IN (SELECT id FROM biz) GROUP BY business_id
""",
)
def fk_violations(spark, folder):
    """Line items as entries, parts as their sources, suppliers as businesses."""
    items = table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("business_id"), F.col("l_partkey").cast("string").alias("source_id"))
    parts = table(spark, folder, "part").filter("p_retailprice < 1500").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("string").alias("business_id"))
    owners = table(spark, folder, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("id"))
    return st.fk_violations(items, parts, owners)


# ---- source table -------------------------------------------------------------------------------

# Known sources: pages, and documents with a label. Incoming: every document.
CTE_KNOWN = f"""{CTE_DOCS},
known AS (
  SELECT 'p' || page_id AS id, 'web' AS business_id, url AS source_url, 'website' AS source_type, 'website' AS category,
         CAST(NULL AS VARCHAR) AS description, 'loaded' AS status, 5 AS entry_count, {OLD} AS created, CAST(NULL AS VARCHAR) AS error_message FROM pages
  UNION ALL
  SELECT 'd' || docs.doc_id, source, url, 'text', 'faq', 'old ' || quality, 'failed', 9, {OLD} + docs.doc_id, 'e' FROM docs JOIN labels ON docs.doc_id = labels.doc_id),
incoming AS (
  SELECT source AS business_id, url AS source_url, 'website' AS source_type,
         CASE lang WHEN 'en' THEN 'website' WHEN 'fr' THEN 'faq' WHEN 'es' THEN 'policy' ELSE 'technical' END AS category,
         CASE WHEN lang = 'fr' THEN left(text, 30) END AS description FROM docs),
upserted AS (
  SELECT coalesce(k.id, {sql_stable_id('i.business_id', 'i.source_url')}) AS id, coalesce(i.business_id, k.business_id) AS business_id,
         coalesce(i.source_url, k.source_url) AS source_url, coalesce(i.source_type, k.source_type) AS source_type, coalesce(i.category, k.category) AS category,
         coalesce(i.description, k.description) AS description, CASE WHEN i.source_url IS NULL THEN k.status ELSE 'loading' END AS status,
         CASE WHEN i.source_url IS NULL THEN k.error_message END AS error_message,
         CASE WHEN i.source_url IS NULL THEN k.entry_count ELSE 0 END AS entry_count,
         coalesce(k.created, {NOW}) AS created, CASE WHEN i.source_url IS NULL THEN {OLD} ELSE {NOW} END AS updated
  FROM known k FULL OUTER JOIN incoming i ON k.business_id = i.business_id AND k.source_url = i.source_url)"""


def _known(spark, folder):
    none = F.lit(None).cast("string")
    page = table(spark, folder, "pages").select(
        F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.lit("web").alias("business_id"), F.col("url").alias("source_url"),
        F.lit("website").alias("source_type"), F.lit("website").alias("category"), none.alias("description"),
        F.lit("loaded").alias("status"), none.alias("error_message"), F.lit(5).alias("entry_count"), _at(OLD).alias("created_at"),
    )
    labelled = docs(spark, folder).join(table(spark, folder, "labels"), "doc_id").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("source").alias("business_id"), F.col("url").alias("source_url"),
        F.lit("text").alias("source_type"), F.lit("faq").alias("category"), F.concat(F.lit("old "), F.col("quality")).alias("description"),
        F.lit("failed").alias("status"), F.lit("e").alias("error_message"), F.lit(9).alias("entry_count"),
        F.timestamp_seconds(F.lit(OLD) + F.col("doc_id")).alias("created_at"),
    )
    return page.unionByName(labelled).withColumns(
        {"crawl_internal": F.lit(True), "last_loaded_at": F.lit(None).cast("timestamp"), "is_active": F.lit(True), "updated_at": _at(OLD)}
    )


def _incoming(spark, folder):
    return docs(spark, folder).select(
        F.col("doc_id").alias("seq"), F.col("source").alias("business_id"), F.col("url").alias("source_url"),
        ux.source_type(F.col("url")).alias("source_type"), category_of_lang().alias("category"),
        F.when(F.col("lang") == "fr", F.left("text", F.lit(30))).alias("description"), F.lit(True).alias("crawl_internal"),
    )


def _upserted(spark, folder):
    return st.source_upsert(_known(spark, folder), _incoming(spark, folder), _at(NOW))


def _plain(sources):
    seconds = {"created": F.unix_seconds("created_at"), "updated": F.unix_seconds("updated_at")}
    return sources.withColumns(seconds).select(
        "id", "business_id", "source_url", "source_type", "category", "description", "status", "error_message",
        F.col("entry_count").cast(BIG).alias("entry_count"), "created", "updated",
    )


SQL_PLAIN = "id, business_id, source_url, source_type, category, description, status, error_message, CAST(entry_count AS BIGINT) AS entry_count, CAST(created AS BIGINT) AS created, CAST(updated AS BIGINT) AS updated"


@query("source_upsert", f"WITH {CTE_KNOWN} SELECT {SQL_PLAIN} FROM upserted")
def source_upsert(spark, folder):
    return _plain(_upserted(spark, folder))


@query("source_lookup", f"WITH {CTE_KNOWN} SELECT {SQL_PLAIN} FROM upserted WHERE business_id = 'src1' AND source_url = (SELECT min(url) FROM docs WHERE source = 'src1')")
def source_lookup(spark, folder):
    wanted = docs(spark, folder).filter("source = 'src1'").agg(F.min("url")).first()[0]
    return _plain(st.source_lookup(_upserted(spark, folder), business_id="src1", source_url=wanted))


@query(
    "source_mark_loaded",
    f"""
WITH {CTE_KNOWN}, n AS (SELECT url, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS n, lang FROM docs)
SELECT id, source_url, CASE WHEN n.url IS NULL THEN status WHEN lang = 'de' THEN 'failed' ELSE 'loaded' END AS status,
       CASE WHEN n.url IS NULL THEN error_message WHEN lang = 'de' THEN 'no parser' END AS error_message,
       CAST(CASE WHEN n.url IS NULL THEN entry_count ELSE n END AS BIGINT) AS entry_count, CASE WHEN n.url IS NOT NULL THEN CAST({NOW} AS BIGINT) END AS loaded
FROM upserted LEFT JOIN n ON upserted.source_url = n.url
""",
)
def source_mark_loaded(spark, folder):
    """Each document's line count as the outcome of its source; German ones failed."""
    counts = lines(spark, folder).groupBy("url", "lang").agg(F.count(F.lit(1)).alias("entry_count"))
    sources = _upserted(spark, folder)
    outcome = sources.select(F.col("id").alias("source_id"), F.col("source_url").alias("url")).join(counts, "url").select(
        "source_id", "entry_count", F.when(F.col("lang") == "de", "no parser").alias("error_message")
    )
    marked = st.source_mark_loaded(sources, outcome, _at(NOW))
    return marked.select("id", "source_url", "status", "error_message", F.col("entry_count").cast(BIG).alias("entry_count"), F.unix_seconds("last_loaded_at").alias("loaded"))


@query(
    "cascade_delete",
    f"""
WITH {CTE_DOCS}, gone AS (SELECT DISTINCT source || '/' || lang AS id FROM docs JOIN labels ON docs.doc_id = labels.doc_id WHERE toxic = 1)
SELECT doc_id, url FROM docs WHERE lang = 'es' OR source || '/' || lang NOT IN (SELECT id FROM gone)
""",
)
def cascade_delete(spark, folder):
    """Sources with a toxic document are deleted; Spanish entries have no source and stay."""
    group = F.concat_ws("/", "source", "lang")
    rows = docs(spark, folder).select("doc_id", "url", F.when(F.col("lang") != "es", group).alias("source_id"))
    toxic = table(spark, folder, "labels").filter("toxic = 1")
    gone = docs(spark, folder).join(toxic, "doc_id", "left_semi").select(group.alias("id"))
    return st.cascade_delete(rows, gone).select("doc_id", "url")


@query(
    "load_report",
    f"""
WITH {CTE_LINES}, r AS (SELECT l.doc_id, any_value(toxic) AS toxic, count(*) AS n FROM lines l LEFT JOIN labels ON l.doc_id = labels.doc_id GROUP BY l.doc_id)
SELECT CAST(sum(CASE WHEN coalesce(toxic, 0) = 1 THEN 0 ELSE n END) AS BIGINT) AS total_entries, count(*) AS sources_processed,
       count(*) FILTER (WHERE coalesce(toxic, 0) = 0) AS sources_successful, count(*) FILTER (WHERE toxic = 1) AS sources_failed FROM r
""",
)
def load_report(spark, folder):
    counted = lines(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    failed = F.coalesce("toxic", F.lit(0)) == 1
    results = counted.join(table(spark, folder, "labels"), "doc_id", "left").select(
        F.when(failed, "failed").otherwise("loaded").alias("status"), F.when(failed, 0).otherwise(F.col("n")).alias("entry_count")
    )
    return quality.load_totals(results)


# ---- the store ----------------------------------------------------------------------------------


def _for_store(spark, folder):
    return entries(spark, folder).select(
        F.col("id").cast("string").alias("id"), "business_id", "category", "title", "content", "embedding", "source_id",
        F.concat(F.lit('{"n":'), F.col("n_chars").cast("string"), F.lit("}")).alias("metadata"), "is_active",
    )


@query(
    "entries_append",
    f"WITH {CTE_ENTRIES} SELECT CAST(id AS VARCHAR) AS id, business_id, category, title, content, CAST(len(embedding) AS BIGINT) AS dim, '{{\"n\":' || n_chars || '}}' AS metadata, source_id, is_active, CAST({NOW} AS BIGINT) AS created FROM entries",
)
def entries_append(spark, folder):
    """Entries written to a new store and read back."""
    store = st.Store(spark, scratch_path(spark, "store"), WIDTH)
    st.entries_append(store, _for_store(spark, folder), _at(NOW))
    return store.entries().select(
        "id", "business_id", "category", "title", "content", F.size("embedding").cast(BIG).alias("dim"), "metadata", "source_id", "is_active",
        F.unix_seconds("created_at").alias("created"),
    )


@query("entries_append_skip", f"WITH {CTE_ENTRIES} SELECT CAST(id AS VARCHAR) AS id, business_id, category FROM entries WHERE NOT contains(content, 'qu')")
def entries_append_skip(spark, folder):
    """A model that fails on some texts: their rows are left out, the others of the batch are kept."""

    def build():
        inner = embed.hashing_embedder(WIDTH)()

        def call(texts):
            if any("qu" in text for text in texts):
                raise RuntimeError("unusable text")
            return inner(texts)

        return call

    store = st.Store(spark, scratch_path(spark, "store"), WIDTH)
    rows = embed.embed_chunks(_for_store(spark, folder).drop("embedding"), build, text="content", on_error="skip")
    st.entries_append(store, rows, _at(NOW))
    return store.entries().select("id", "business_id", "category")


@query(
    "publish",
    f"""
WITH {CTE_ENTRIES}, bad AS (SELECT DISTINCT source_id FROM entries WHERE NOT is_active)
SELECT 3 AS version, business_id, count(*) AS n_entries FROM entries WHERE source_id NOT IN (SELECT source_id FROM bad) GROUP BY business_id
UNION ALL SELECT 1, business_id, count(*) FROM entries WHERE lang = 'en' GROUP BY business_id
""",
)
def publish(spark, folder):
    """Two appends and a cascading delete of the sources with an inactive entry; the current version
    next to the first one, which stays readable."""
    store = st.Store(spark, scratch_path(spark, "store"), WIDTH)
    rows = _for_store(spark, folder)
    st.entries_append(store, rows.filter("category = 'website'"), _at(NOW))
    st.entries_append(store, rows.filter("category <> 'website'"), _at(NOW))
    store.delete_sources(rows.filter(~F.col("is_active")).select(F.col("source_id").alias("id")).distinct())

    def count(version: int):
        found = store.entries(store.manifest(version)).groupBy("business_id").agg(F.count(F.lit(1)).alias("n_entries"))
        return found.select(F.lit(version).alias("version"), "business_id", "n_entries")

    return count(3).unionByName(count(1))


# Chunks of at most 200 words of every page and document. A page's trail is its h1 once that has come
# (marked by chr(1)); documents have none.
CTE_LOADED = f"""{CTE_LINES},
page_cut AS (
  SELECT url, regexp_split_to_array(replace(replace(regexp_replace({SQL_CLEAN}, '<!--.*?-->|<title>.*?</title>|<!DOCTYPE[^>]*>', '', 'gs'), '<br>', chr(10)), '<h1>', '<h1>' || chr(1)),
         '</?(?:p|h1|div|article|footer|body|html|ul|li)\\b[^>]*>') AS ps FROM pages),
page_text AS (SELECT url, list_transform(ps, lambda p: regexp_replace(p, '<[^>]*>', '', 'g')) AS ps FROM page_cut),
page_words AS (SELECT url, list_filter(list_transform(ps, lambda p: regexp_extract_all({SQL_UNESCAPE.format('p')}, '{SQL_WORD}')), lambda w: len(w) > 0) AS ws FROM page_text),
page_blocks AS (SELECT url AS key, unnest(generate_series(0, len(ws) - 1)) AS ix, unnest(ws) AS ws FROM page_words),
page_trails AS (SELECT *, coalesce(last_value(CASE WHEN starts_with(ws[1], chr(1)) THEN array_to_string(ws, ' ') END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ix ROWS UNBOUNDED PRECEDING), '') AS trail FROM page_blocks),
body AS (
  SELECT key, ix, trail, ws FROM page_trails WHERE NOT starts_with(ws[1], chr(1))
  UNION ALL
  SELECT source || '/' || doc_id || '.txt', ix, '', regexp_extract_all(text, '{SQL_WORD}') FROM lines
  WHERE doc_id IN (SELECT doc_id FROM documents WHERE {sql_words('text')} <= 10000)),
cuts AS (SELECT *, unnest(generate_series(0, CAST(ceil(len(ws) / 200.0) AS BIGINT) - 1)) AS part FROM body WHERE len(ws) > 0),
seated AS (SELECT key, trail, least(200, len(ws) - part * 200) AS size, row_number() OVER (PARTITION BY key ORDER BY ix, part) AS seat FROM cuts),
packed(key, seat, chunk_ix, total, trail) AS (
  SELECT key, seat, 0, size, trail FROM seated WHERE seat = 1
  UNION ALL
  SELECT s.key, s.seat, CASE WHEN s.trail = p.trail AND p.total + s.size <= 200 THEN p.chunk_ix ELSE p.chunk_ix + 1 END,
         CASE WHEN s.trail = p.trail AND p.total + s.size <= 200 THEN p.total + s.size ELSE s.size END, s.trail
  FROM packed p JOIN seated s ON s.key = p.key AND s.seat = p.seat + 1),
sized_chunks AS (SELECT p.key, p.chunk_ix, sum(s.size) AS n FROM packed p JOIN seated s ON p.key = s.key AND p.seat = s.seat GROUP BY p.key, p.chunk_ix),
loaded AS (SELECT key, count(*) FILTER (WHERE n >= 15) AS n_chunks FROM sized_chunks GROUP BY key)"""


@query(
    "load_documents",
    f"""
WITH RECURSIVE {CTE_LOADED},
listed AS (SELECT url, 'website' AS source_type FROM pages UNION ALL SELECT source || '/' || doc_id || '.txt', 'text' FROM documents)
SELECT url AS source_url, {sql_stable_id(f"'{TENANT}'", 'url')} AS source_id, source_type,
       CASE WHEN coalesce(n_chunks, 0) > 0 THEN 'loaded' ELSE 'failed' END AS status, CAST(coalesce(n_chunks, 0) AS INTEGER) AS entry_count,
       CASE WHEN n_chunks IS NULL THEN 'No documents extracted' WHEN n_chunks = 0 THEN 'No chunks created' END AS error_message
FROM listed LEFT JOIN loaded ON url = key
""",
)
def load_documents(spark, folder):
    """Every page and every document as a source of one business, loaded in one job."""
    page = table(spark, folder, "pages")
    text = docs(spark, folder).select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("url"), "text")
    listed = page.select(F.col("url").alias("source_url")).unionAll(text.select("url")).withColumns(
        {
            "seq": F.lit(0), "business_id": F.lit(TENANT), "category": F.lit("website"), "crawl_internal": F.lit(False),
            "description": F.lit(None).cast("string"), "source_type": ux.source_type(F.col("source_url")),
        }
    )
    store = st.Store(spark, scratch_path(spark, "store"))
    announced, listed = load.announce(store, listed, _at(NOW))
    found = load.extract(load.source_pages(listed, None), page, text)
    report = load.load_listed(store, listed, announced, found, _at(NOW), "catalogue", max_tokens=200, counter="word", on_source_error="record")
    return report.results.select("source_url", "source_id", "source_type", "status", "entry_count", "error_message")


@query(
    "stream_ingest",
    f"""
WITH RECURSIVE {CTE_LOADED},
hosts AS (SELECT 'https://' || regexp_extract(url, '//([^/?#]*)', 1) AS source_url, n_chunks FROM pages JOIN loaded ON url = key)
SELECT source_url, CASE WHEN sum(n_chunks) > 0 THEN 'loaded' ELSE 'failed' END AS status, CAST(sum(n_chunks) AS INTEGER) AS entry_count,
       CASE WHEN sum(n_chunks) = 0 THEN 'No chunks created' END AS error_message FROM hosts GROUP BY source_url
""",
)
def stream_ingest(spark, folder):
    """Pages arriving as captures, loaded by a stream: entries per source."""
    landing, store = scratch_path(spark, "landing"), st.Store(spark, scratch_path(spark, "store"))
    host = F.regexp_extract("url", "//([^/?#]*)", 1)
    captures = table(spark, folder, "pages").select(
        F.lit(TENANT).alias("business_id"), F.concat(F.lit("https://"), host).alias("source_url"), "url", "html",
        F.lit("website").alias("category"), F.timestamp_seconds(F.lit(NOW) + F.col("page_id")).alias("captured_at"),
    )
    captures.write.parquet(landing)
    arriving = spark.readStream.schema(ingest.CAPTURE).parquet(landing)
    ingest.stream_ingest(store, arriving, "captures", scratch_path(spark, "progress"), max_tokens=200, counter="word").awaitTermination()
    return store.sources().select("source_url", "status", "entry_count", "error_message")


# ---- events -------------------------------------------------------------------------------------

KEPT = 20
CTE_KEPT = f"""ranked AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events),
kept AS (SELECT event_id, user_id, r FROM ranked WHERE r <= {KEPT})"""


def _stream_rows(rows):
    return rows.select(
        F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").cast("string").alias("event_id"),
        F.col("event_id").alias("seq"), F.col("props").alias("message"),
    )


def _kept(spark, folder):
    return events.last_n(_stream_rows(table(spark, folder, "events")), KEPT)


@query("events_last_n", f"WITH {CTE_KEPT} SELECT CAST(user_id AS VARCHAR) AS stream_id, CAST(event_id AS VARCHAR) AS event_id FROM kept")
def events_last_n(spark, folder):
    return _kept(spark, folder).select("stream_id", "event_id")


@query(
    "event_replay",
    f"""
WITH {CTE_KEPT}
SELECT CAST(a.event_id AS VARCHAR) AS last_event_id, CAST(a.user_id AS VARCHAR) AS stream_id, CAST(b.event_id AS VARCHAR) AS event_id, b.event_id AS seq
FROM kept a JOIN kept b ON a.user_id = b.user_id AND b.event_id > a.event_id
""",
)
def event_replay(spark, folder):
    """Replay after every event; evicted ones give nothing."""
    return events.replay(_kept(spark, folder), _stream_rows(table(spark, folder, "events")).select("event_id"))


@query(
    "event_replay_streams",
    f"""
WITH {CTE_KEPT}
SELECT CAST(e.event_id AS VARCHAR) AS last_event_id, CAST(k.user_id AS VARCHAR) AS stream_id, coalesce(k.r - 1, 0) AS n_after
FROM events e LEFT JOIN kept k ON e.event_id = k.event_id
""",
)
def event_replay_streams(spark, folder):
    return events.replay_streams(_kept(spark, folder), _stream_rows(table(spark, folder, "events")).select("event_id"))


#: Files, and so triggers, that the events arrive in.
TRIGGERS = 3


@query("stream_last_n", f"WITH {CTE_KEPT} SELECT CAST(user_id AS VARCHAR) AS stream_id, CAST(event_id AS VARCHAR) AS event_id FROM kept")
def stream_last_n(spark, folder):
    """The same history kept by a stream over the events in several files, one in each trigger."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    rows, landed = table(spark, folder, "events"), scratch_path(spark, "landed")
    rows.repartition(TRIGGERS, "event_id").write.parquet(landed)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    path = scratch_path(spark, "history")
    spark.conf.set(setting, history.ROCKSDB)
    try:
        kept = history.stream_last_n(_stream_rows(arriving), KEPT)
        history.write_history(kept, path, scratch_path(spark, "progress")).awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return history.read_history(spark.read.parquet(path)).select("stream_id", "event_id")
