"""Loading: from listed sources and a crawl snapshot to published entries."""

from __future__ import annotations

import uuid as uuidlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lorekeep.functions import ids
from lorekeep.functions import text as tx
from lorekeep.functions import titles as mx
from lorekeep.functions import urls as ux
from lorekeep.operators import chunking, crawl, embed, html, quality
from lorekeep.operators import store as st
from lorekeep.session import cut_lineage, spread
from lorekeep.sources.lists import parse_sources, route

LISTED = ["seq", "business_id", "source_url"]
# What a page row carries of its source from the start, so that no wide row is joined for it later.
CARRIED = [*LISTED, "category", "source_id"]
# Source types that no reader here decodes.
QUARANTINED = ("pdf", "document")


@dataclass
class LoadReport:
    version: int
    results: DataFrame  # source_url, source_id, source_type, status, entry_count, error_message
    totals: DataFrame  # one row


def announce(store: st.Store, listed: DataFrame, as_of: Column, base: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The source table with the listed sources marked as loading, and the listing with source ids.

    Both are narrow, used many times and of a size worth knowing to the planner: they are staged.
    """
    announced = cut_lineage(st.source_upsert(store.sources(base), listed, as_of))
    known = announced.select(F.col("id").alias("source_id"), *st.SOURCE_KEY)
    return announced, cut_lineage(listed.join(known, st.SOURCE_KEY))


def source_pages(listed: DataFrame, pages: DataFrame | None, max_depth: int = crawl.MAX_DEPTH, max_urls: int | None = crawl.MAX_URLS) -> DataFrame:
    """Pages each announced source covers: itself, plus, given a snapshot to crawl, what a crawl from it
    collects within ``max_depth`` and ``max_urls``."""
    own = listed.select(*CARRIED, F.col("source_url").alias("page_url"))
    if pages is None:
        return own
    starts = listed.filter((F.col("route") == "html") & F.coalesce("crawl_internal", F.lit(True)))
    roots = starts.select(F.col("source_url").alias("root")).distinct()
    edges = crawl.build_edges(crawl.pages_to_read(pages.select("url", "html"), roots, max_depth))
    found = crawl.reachable(roots, edges, max_depth, max_urls)
    further = found.filter("url <> root").select(F.col("root").alias("source_url"), F.col("url").alias("page_url"))
    return own.unionByName(starts.select(*CARRIED).join(further, "source_url").select(*own.columns))


def one_capture(snapshot: DataFrame) -> DataFrame:
    """One row per page_url: of several captures the one whose html has the smallest hash, a missing one last."""
    order = F.struct(F.col("html").isNull(), F.xxhash64("html"))
    return snapshot.groupBy("page_url").agg(F.min_by("html", order).alias("html"))


def extract(covered: DataFrame, pages: DataFrame | None, files: DataFrame | None, max_words: int = html.MAX_DOCUMENT_WORDS) -> DataFrame:
    """Documents of the covered pages: listing columns, page_url, blocks. PDF and Word files are not read."""
    parts = []
    covered = covered.filter(~ux.source_type(F.col("page_url")).isin(*QUARANTINED))
    if pages is not None:
        wanted = covered.filter(ux.is_http(F.col("page_url")))
        snapshot = spread(pages.select(F.col("url").alias("page_url"), "html"))
        captured = one_capture(snapshot.join(wanted.select("page_url").distinct(), "page_url", "left_semi"))
        # parsed once, however many sources cover the page
        parts.append(html.read_documents(captured, max_words).join(wanted, "page_url").select(*CARRIED, "page_url", "blocks"))
    if files is not None:
        texts = spread(files.select(F.col("url").alias("page_url"), "text"))
        read = covered.filter(~ux.is_http(F.col("page_url"))).join(texts, "page_url")
        sized = html.size_gate(read.filter(tx.has_words(F.col("text"))), tx.word_count(F.col("text")), max_words)
        parts.append(sized.withColumn("blocks", html.text_blocks(F.col("text"))).select(*CARRIED, "page_url", "blocks"))
    docs = parts[0]
    for part in parts[1:]:
        docs = docs.unionByName(part)
    return docs


def entry_rows(
    numbered: DataFrame,
    load_id: str,
    as_of: Column,
    model: Callable | None = None,
    on_error: str = "abort",
    simple: bool = False,
) -> DataFrame:
    """Numbered chunks (carried columns, page_url, chunk columns) to entries.

    ``simple`` gives the plainer form: the first heading as title, and the source id in the metadata.
    """
    c = F.col
    name = ux.file_name(c("page_url"))
    extra = {"source_id": c("source_id")} if simple else {}
    hierarchical = mx.title_hierarchical(c("headings"), name, c("text"))
    titled = numbered.withColumns(
        {
            "title": mx.title_simple(c("headings"), name) if simple else hierarchical,
            "metadata": mx.metadata_json(
                c("source_url"), name, c("page_nos"), c("headings"), c("chunk_index"), c("total_chunks"),
                page_url=c("page_url"), loaded_at=as_of.cast("double"), **extra,
            ),
            "id": ids.stable_id(F.lit(load_id), c("business_id"), c("source_url"), c("seq"), c("chunk_index")),
            "content": c("text"),
        }
    )
    # Placed while rows are narrow, so the task that makes vectors also writes them. Ranges keep a small
    # tenant in one task and split a large one over many, since the id is part of the range.
    narrow = titled.select("id", "business_id", "category", "title", "content", "metadata", "source_id")
    placed = narrow.repartitionByRange("business_id", "source_id", "id")
    return st.with_entry_defaults(embed.embed_chunks(placed, model, text="content", on_error=on_error), as_of)


def load_listed(
    store: st.Store,
    listed: DataFrame,
    announced: DataFrame,
    docs: DataFrame,
    as_of: Column,
    load_id: str,
    base: dict | None = None,
    max_tokens: int = chunking.MAX_TOKENS,
    min_chunk_words: int = chunking.MIN_CHUNK_WORDS,
    counter="token",
    model: Callable | None = None,
    mode: str = "append",
    on_source_error: str = "abort",
    on_embed_error: str = "abort",
    simple: bool = False,
    businesses: DataFrame | None = None,
    batch: tuple[str, int] | None = None,
    business_uuid: bool = False,
) -> LoadReport:
    """Chunks, embeds and publishes documents of listed sources, of any number of businesses.

    ``listed`` and ``announced`` come from ``announce`` on the manifest ``base``; ``docs`` has the
    ``CARRIED`` columns, page_url and blocks. Everything is computed and written before the one
    manifest that makes it visible.
    """
    base = base or store.manifest()
    chunks = chunking.pack_blocks(F.col("blocks"), max_tokens, True, counter, min_chunk_words)
    packed = docs.withColumn("chunks", chunks).drop("blocks")
    # one row per document: texts are read once more below, the counts from their own column
    staged = cut_lineage(packed.withColumns({"n": F.coalesce(F.size("chunks"), F.lit(0)), "_doc": F.monotonically_increasing_id()}))
    counts = staged.groupBy("source_id", "seq").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chunks"))
    tally = listed.join(counts, ["source_id", "seq"], "left").withColumns(
        {
            "error_message": F.when(
                (F.coalesce("n_docs", F.lit(0)) == 0) & F.col("source_type").isin(*QUARANTINED), "Unsupported document type"
            )
            .when(F.coalesce("n_docs", F.lit(0)) == 0, "No documents extracted")
            .when(F.col("n_chunks") == 0, "No chunks created"),
            "n_chunks": F.coalesce("n_chunks", F.lit(0)),
        }
    )
    tally = cut_lineage(tally)
    if on_source_error == "abort":
        failed = tally.filter(F.col("error_message").isNotNull()).select("source_url", "error_message").take(5)
        if failed:
            raise ValueError(f"load aborted, nothing was stored: {[tuple(r) for r in failed]}")

    chunks = staged.select(*CARRIED, "page_url", "_doc", "chunks")
    numbered = chunking.number_chunks(chunks, ["source_id", "seq"], "page_url", "_doc")
    numbered = numbered.select(*CARRIED, "page_url", "chunk.*", "chunk_index", "total_chunks")
    entries = entry_rows(numbered, load_id, as_of, model, on_embed_error, simple)
    seen = Observation("entries")  # counted by the job that writes, not by reading again
    part = store.write_entries(st.counted(entries, seen, "entries", store.width, business_uuid), base["version"] + 1, placed=True)
    st.require_unbroken(seen, "entries break constraints")
    written = store.entries({**base, "entries": [part], "tombstones": []})

    at = F.col("seq")
    outcome = tally.groupBy("source_id").agg(
        F.max_by("n_chunks", at).alias("entry_count"), F.max_by(F.struct("error_message"), at)["error_message"].alias("error_message")
    )
    if on_embed_error == "skip":
        stored = written.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_stored"))
        outcome = outcome.join(stored, "source_id", "left").select("source_id", F.coalesce("n_stored", F.lit(0)).alias("entry_count"), "error_message")
    loaded = st.source_mark_loaded(announced, outcome, as_of)
    st.require_none(st.constraint_violations(loaded, "sources"), "sources break constraints")
    st.require_none(st.duplicate_keys(loaded), "sources are not unique")
    if businesses is not None:
        st.require_none(st.fk_violations(written, loaded, businesses), "foreign keys without a parent")
    deleted = listed.select("source_id") if mode == "replace" else None
    version = store.publish(loaded, parts=[part], deleted=deleted, base=base, batch=batch)

    final = store.sources(store.manifest(version)).select(F.col("id").alias("source_id"), "status", "error_message")
    results = tally.select("seq", "source_url", "source_id", "source_type", F.col("n_chunks").cast("int").alias("entry_count"))
    results = results.join(final, "source_id").select("seq", "source_url", "source_id", "source_type", "status", "entry_count", "error_message")
    return LoadReport(version, results, quality.load_totals(results))


def load_documents(
    store: st.Store,
    business_id: str,
    sources: list[str] | str,
    pages: DataFrame | None = None,
    files: DataFrame | None = None,
    max_tokens: int = chunking.MAX_TOKENS,
    crawl_internal: bool = True,
    category: str = "website",
    description: str | None = None,
    as_of: Column | None = None,
    load_id: str | None = None,
    max_depth: int = crawl.MAX_DEPTH,
    max_urls: int | None = crawl.MAX_URLS,
    max_words: int = html.MAX_DOCUMENT_WORDS,
    **options,
) -> LoadReport:
    """Loads the sources of one business. ``pages`` is a crawl snapshot (url, html) and ``files`` a
    text scan (url, text). ``max_depth`` and ``max_urls`` bound the crawl, documents of more than ``max_words`` words
    are left out; see ``load_listed`` for the options."""
    try:
        business_id = str(uuidlib.UUID(business_id))
    except (ValueError, AttributeError, TypeError):
        raise ValueError(f"business_id must be a UUID, got {business_id!r}") from None
    if pages is None and files is None:
        raise ValueError("a page snapshot or a file scan is needed")
    listed = route(parse_sources(store.spark, sources)).withColumns(
        {
            "business_id": F.lit(business_id),
            "category": F.lit(category),
            "description": F.lit(description).cast("string"),
            "crawl_internal": F.lit(crawl_internal),
        }
    )
    when = F.current_timestamp() if as_of is None else as_of
    base = store.manifest()
    announced, listed = announce(store, listed, when, base)
    covered = source_pages(listed, pages if crawl_internal else None, max_depth, max_urls)
    docs = extract(covered, pages, files, max_words)
    return load_listed(store, listed, announced, docs, when, load_id or uuidlib.uuid4().hex, base, max_tokens=max_tokens, business_uuid=True, **options)


def load_sitemap(store: st.Store, business_id: str, sitemaps: DataFrame, pages: DataFrame, **options) -> LoadReport:
    """Loads the pages that sitemaps (base_url, status, xml) list, each sitemap one source."""
    from lorekeep.sources.sitemap import crawlable, sitemap_urls

    wanted = crawlable(sitemap_urls(sitemaps)).distinct()
    listed = sitemaps.select(F.col("base_url").alias("source_url")).distinct().withColumns(
        {
            "seq": F.lit(0),
            "business_id": F.lit(str(uuidlib.UUID(business_id))),
            "source_type": ux.source_type(F.col("source_url")),
            "category": F.lit(options.pop("category", "website")),
            "description": F.lit(options.pop("description", None)).cast("string"),
            "crawl_internal": F.lit(False),
        }
    )
    when = options.pop("as_of", F.current_timestamp())
    base = store.manifest()
    announced, listed = announce(store, listed, when, base)
    covered = listed.select(*CARRIED).join(
        wanted.select(F.col("base_url").alias("source_url"), F.col("url").alias("page_url")), "source_url"
    )
    docs = extract(covered.select(*CARRIED, "page_url"), pages, None)
    return load_listed(store, listed, announced, docs, when, options.pop("load_id", uuidlib.uuid4().hex), base, business_uuid=True, **options)
