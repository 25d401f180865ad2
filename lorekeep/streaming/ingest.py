"""Incremental loading: new page captures arriving in a landing folder become entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import urls as ux
from lorekeep.operators import html
from lorekeep.operators import store as st
from lorekeep.plans.load import CARRIED, QUARANTINED, announce, load_listed

CAPTURE = "business_id string, source_url string, url string, html string, category string, captured_at timestamp"


def capture_listing(captures: DataFrame) -> DataFrame:
    """Sources of a batch of captures, each once."""
    once = captures.groupBy("business_id", "source_url").agg(F.max("category").alias("category"))
    return once.withColumns(
        {
            "seq": F.lit(0),
            "source_type": ux.source_type(F.col("source_url")),
            "description": F.lit(None).cast("string"),
            "crawl_internal": F.lit(False),
        }
    )


def capture_documents(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """Documents of the newest capture of each page; the listing of one batch is small and AQE broadcasts it."""
    read = captures.filter(~ux.source_type(F.col("url")).isin(*QUARANTINED))
    newest = F.max_by("html", F.struct("captured_at", F.xxhash64("html"))).alias("html")
    pages = read.groupBy("business_id", "source_url", F.col("url").alias("page_url")).agg(newest)
    known = listed.select(*CARRIED)
    return html.read_documents(pages.join(known, ["business_id", "source_url"])).select(*CARRIED, "page_url", "blocks")


def ingest_batch(store: st.Store, name: str, batch: DataFrame, batch_id: int, **options) -> None:
    """Loads one micro-batch exactly once: the manifest records the last batch of each query, and a
    batch that is delivered again after its manifest was written is left alone."""
    base = store.manifest()
    if batch_id <= base.get("batches", {}).get(name, -1) or batch.isEmpty():
        return
    as_of = F.lit(batch.agg(F.max("captured_at")).first()[0])
    announced, listed = announce(store, capture_listing(batch), as_of, base)
    load_listed(
        store,
        listed,
        announced,
        capture_documents(batch, listed),
        as_of,
        f"{name}-{batch_id}",
        base,
        on_source_error="record",
        batch=(name, batch_id),
        **options,
    )


def stream_ingest(store: st.Store, captures: DataFrame, name: str, checkpoint: str, trigger: dict | None = None, **options):
    """Starts the query that loads a streaming frame of ``CAPTURE`` rows into the store."""
    return (
        captures.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: ingest_batch(store, name, batch, batch_id, **options))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
