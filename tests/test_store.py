"""Checks, upsert, delete, publishing, and whole loads."""

import pytest
from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.operators import store as st
from lorekeep.plans import ask, load
from lorekeep.sources import lists

BIZ = "12345678-1234-5678-1234-567812345678"
INCOMING = "seq int, business_id string, source_url string, source_type string, category string, crawl_internal boolean, description string"


def at(second):
    return F.timestamp_seconds(F.lit(second))


def known(spark, **changes):
    row = {
        "id": "7", "business_id": "b1", "source_url": "u1", "source_type": "text", "category": "faq", "description": "old", "crawl_internal": False,
        "status": "failed", "error_message": "e", "entry_count": 9, "is_active": False, **changes,
    }
    df = spark.createDataFrame([tuple(row.get(f.name) for f in schemas.SOURCES)], schemas.SOURCES)
    return df.withColumns({"created_at": at(1), "updated_at": at(1)})


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, str(tmp_path / "store"))


def test_upsert(spark):
    incoming = spark.createDataFrame(
        [
            (0, "b1", "u1", "website", "website", True, None),
            (1, "b2", "u1", "website", "faq", True, "first"),
            (2, "b2", "u1", "website", "policy", None, None),
            (3, "b1", "u2", "pdf", "faq", False, "d"),
        ],
        INCOMING,
    )
    got = {(r.business_id, r.source_url): r for r in st.source_upsert(known(spark), incoming, at(100)).collect()}
    assert len(got) == 3
    old = got["b1", "u1"]
    assert (old.id, old.description, old.status, old.error_message, old.entry_count, old.is_active) == ("7", "old", "loading", None, 0, True)
    assert (old.category, old.source_type, old.crawl_internal) == ("website", "website", True)
    assert old.created_at.timestamp() == 1 and old.updated_at.timestamp() == 100
    twice = got["b2", "u1"]
    assert (twice.category, twice.description, twice.crawl_internal) == ("policy", "first", True)
    assert (got["b1", "u2"].entry_count, got["b1", "u2"].is_active, got["b1", "u2"].status) == (0, True, "loading")
    renamed = spark.createDataFrame([(0, "b1", "u1", "text", "faq", True, "new")], INCOMING)
    assert st.source_upsert(known(spark), renamed, at(100)).first().description == "new"
    none = spark.createDataFrame([], INCOMING)
    kept = st.source_upsert(known(spark), none, at(100)).first()
    assert (kept.status, kept.error_message, kept.entry_count, kept.is_active) == ("failed", "e", 9, False)


def test_mark_loaded(spark):
    sources = known(spark).unionByName(known(spark, id="8", status="loading")).unionByName(known(spark, id="9", status="pending"))
    outcomes = spark.createDataFrame([("7", 3, None), ("8", 0, "e")], "source_id string, entry_count int, error_message string")
    got = {r.id: r for r in st.source_mark_loaded(sources, outcomes, at(5)).collect()}
    assert (got["7"].status, got["7"].entry_count, got["7"].error_message) == ("loaded", 3, None)
    assert (got["8"].status, got["8"].error_message, got["8"].last_loaded_at.timestamp()) == ("failed", "e", 5)
    assert (got["9"].status, got["9"].last_loaded_at) == ("pending", None)


def test_cascade_delete(spark):
    entries = spark.createDataFrame([(1, "7"), (2, "8"), (3, None)], "id int, source_id string")
    gone = spark.createDataFrame([("7",), ("7",)], "id string")
    assert {r.id for r in st.cascade_delete(entries, gone).collect()} == {2, 3}


def test_constraints_and_keys(spark):
    bad = known(spark, source_type="word", category="news", status="gone").withColumn("business_id", F.lit(None).cast("string"))
    rules = {r.rule for r in st.constraint_violations(bad, "sources").collect()}
    assert rules == {"business_id_not_null", "source_type_allowed", "category_allowed", "status_allowed"}
    assert st.constraint_violations(known(spark), "sources").isEmpty()
    assert st.duplicate_keys(known(spark).unionByName(known(spark, id="8"))).count() == 1
    entries = spark.createDataFrame([("b1", "7"), ("b1", "9"), ("bx", None), ("bx", None)], "business_id string, source_id string")
    biz = spark.createDataFrame([("b1",)], "id string")
    found = {(r.rule, r.key, r.n_rows) for r in st.fk_violations(entries, known(spark), biz).collect()}
    assert found == {("entries.business_id", "bx", 2), ("entries.source_id", "9", 1)}
    with pytest.raises(ValueError, match="entries.source_id"):
        st.require_none(st.fk_violations(entries.filter("business_id = 'b1'"), known(spark), biz), "keys")


def test_uuid_quarantine(spark):
    rows = spark.createDataFrame([("{" + BIZ + "}",), ("x",), (None,)], "b string")
    good, bad = st.split_uuid(rows, "b")
    assert [r.b for r in good.collect()] == [BIZ] and bad.count() == 2


def test_empty_store(store):
    assert store.versions() == []
    assert store.sources().schema == schemas.SOURCES and store.sources().isEmpty()
    assert store.entries().schema == schemas.ENTRIES and store.entries().isEmpty()


def entry_frame(spark, rows):
    return spark.createDataFrame(
        [(i, b, s, [float(len(s or "")), 1.0] + [0.0] * (schemas.VECTOR_DIM - 2)) for i, b, s in rows], "id string, business_id string, source_id string, embedding array<float>"
    ).withColumns({"category": F.lit("faq"), "title": F.lit("t"), "content": F.lit("c"), "metadata": F.lit("{}")})


def test_append_versions_and_compaction(spark, store):
    st.entries_append(store, entry_frame(spark, [("1", "007", "7"), ("2", "b2", None)]), at(1))
    st.entries_append(store, entry_frame(spark, [("3", "007", "8")]), at(2))
    assert store.versions() == [1, 2]
    rows = {r.id: r for r in store.entries().collect()}
    assert rows["1"].business_id == "007" and rows["1"].is_active is True and rows["2"].source_id is None
    assert {r.id for r in store.entries(store.manifest(1)).collect()} == {"1", "2"}
    store.delete_sources(spark.createDataFrame([("7",)], "id string"))
    assert {r.id for r in store.entries().collect()} == {"2", "3"}
    st.entries_append(store, entry_frame(spark, [("4", "007", "7")]), at(3))
    assert {r.id for r in store.entries().collect()} == {"2", "3", "4"}, "a later load of the same source lives"
    store.compact()
    assert len(store.manifest()["entries"]) == 1 and store.manifest()["tombstones"] == []
    assert {r.id for r in store.entries().collect()} == {"2", "3", "4"}
    plan = store.entries().filter("business_id = '007'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(business_id" in plan


def test_sources_on_their_own(spark, store):
    listed = spark.createDataFrame([(0, "b1", "u1", "website", "faq", True, "d")], INCOMING)
    store.announce_sources(listed, at(1))
    row = store.sources().first()
    assert (row.status, row.entry_count) == ("loading", 0)
    assert st.source_lookup(store.sources(), source_id=row.id).count() == 1
    assert st.source_lookup(store.sources(), business_id="b1", source_url="u2").count() == 0
    store.mark_loaded(spark.createDataFrame([(row.id, 4, None)], "source_id string, entry_count int, error_message string"), at(2))
    assert (store.sources().first().status, store.sources().first().entry_count) == ("loaded", 4)
    store.delete_sources(store.sources().select("id"))
    assert store.sources().isEmpty()


def test_bad_entries_are_not_published(spark, store):
    broken = entry_frame(spark, [("1", "b", "7")]).withColumn("title", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="title_not_null"):
        st.entries_append(store, broken, at(1))
    assert store.versions() == []


def test_vectors_of_another_width_are_refused(spark, store):
    short = entry_frame(spark, [("1", "b", "7")]).withColumn("embedding", F.slice("embedding", 1, 3))
    with pytest.raises(ValueError, match="embedding_width"):
        st.entries_append(store, short, at(1))
    assert store.versions() == []
    st.entries_append(store, short.withColumn("embedding", F.lit(None).cast("array<float>")), at(1))
    assert store.entries().first().embedding is None


def test_second_writer_of_a_version_fails(spark, store):
    base = store.manifest()
    store.publish(known(spark), base=base)
    with pytest.raises(Exception, match="(?i)exist"):
        store.publish(known(spark), base=base)
    assert store.versions() == [1]


# ---- loads

LONG = " ".join(f"word{i}" for i in range(30))


def snapshot(spark):
    pages = [
        ("https://x.test/", f"<h1>Home</h1><p>{LONG}</p><a href='/about'>a</a><a href='/contact'>c</a><a href='https://y.test/z'>z</a>"),
        ("https://x.test/about", f"<h1>Home</h1><h2>About</h2><p>physio {LONG}</p><a href='/about/history'>h</a>"),
        ("https://x.test/contact", f"<p>{LONG}</p>"),
        ("https://x.test/empty", "<nav>only links</nav>"),
        ("https://x.test/short", "<p>too few words</p>"),
    ]
    return spark.createDataFrame(pages, "url string, html string")


def test_load_crawls_chunks_and_reports(spark, store):
    report = load.load_documents(store, BIZ.replace("-", ""), "https://x.test/ , ", pages=snapshot(spark), description="d", as_of=at(50), load_id="one")
    row = report.results.first()
    assert (row.source_url, row.source_type, row.status, row.entry_count) == ("https://x.test/", "website", "loaded", 2)
    assert report.totals.first().asDict() == {"total_entries": 2, "sources_processed": 1, "sources_successful": 1, "sources_failed": 0}
    entries = {r.title: r for r in store.entries().collect()}
    assert set(entries) == {"Home", "Home > About"}
    about = entries["Home > About"]
    assert about.business_id == BIZ and about.source_id == row.source_id and len(about.embedding) == 1536
    assert '"page_url":"https://x.test/about"' in about.metadata and '"source_url":"https://x.test/"' in about.metadata
    assert '"total_chunks":2' in about.metadata and '"loaded_at":50.0' in about.metadata

    answer = ask.query_knowledge_base(store.entries(), "physio " + LONG, BIZ, threshold=0.5, k=1)
    assert answer["context_count"] == 1 and answer["sources"][0]["title"] == "Home > About"
    assert answer["sources"][0]["created_at"] == "1970-01-01T00:00:50+00:00"
    assert ask.query_knowledge_base(store.entries(), "nothing alike", BIZ)["context_count"] == 0
    failed = ask.query_knowledge_base(store.entries().drop("embedding"), "q", BIZ)
    assert failed["sources"] == [] and failed["context_count"] == 0 and failed["error"]


def test_one_capture_of_a_page_and_no_pdf(spark, store):
    """Two captures of a page give the entries of one, a missing capture gives way, and a PDF is not read as a page."""
    page = "<h1>Home</h1><p>{}</p>"
    pages = [
        ("https://x.test/", page.format(LONG)),
        ("https://x.test/", page.format("again " + LONG)),
        ("https://x.test/", None),
        ("https://x.test/a.pdf", page.format(LONG)),
    ]
    found = spark.createDataFrame(pages, "url string, html string")
    wanted = ["https://x.test/", "https://x.test/a.pdf"]
    report = load.load_documents(store, BIZ, wanted, pages=found, crawl_internal=False, on_source_error="record")
    got = {r.source_url: (r.status, r.entry_count, r.error_message) for r in report.results.collect()}
    assert got == {wanted[0]: ("loaded", 1, None), wanted[1]: ("failed", 0, "Unsupported document type")}
    assert store.entries().count() == 1


def test_simple_entries_and_skipped_texts(spark, store):
    def picky():
        def model(texts):
            if any("physio" in t for t in texts):
                raise RuntimeError("no")
            return [[1.0] + [0.0] * (schemas.VECTOR_DIM - 1)] * len(texts)

        return model

    report = load.load_documents(
        store, BIZ, ["https://x.test/"], pages=snapshot(spark), as_of=at(1), simple=True, model=picky, on_embed_error="skip"
    )
    rows = store.entries().collect()
    assert [r.title for r in rows] == ["Home"] and f'"source_id":"{rows[0].source_id}"' in rows[0].metadata
    assert store.sources().first().entry_count == 1 and report.results.first().status == "loaded"


def test_reload_appends_or_replaces(spark, store):
    def run(load_id, **options):
        return load.load_documents(store, BIZ, ["https://x.test/about"], pages=snapshot(spark), crawl_internal=False, as_of=at(1), load_id=load_id, **options)

    run("a")
    run("b")
    assert store.entries().count() == 2 and store.sources().count() == 1
    run("c", mode="replace")
    run("c", mode="replace")
    assert store.entries().count() == 1 and store.sources().first().entry_count == 1


def test_source_listed_twice(spark, store):
    report = load.load_documents(store, BIZ, "https://x.test/about,https://x.test/about", pages=snapshot(spark), crawl_internal=False, as_of=at(1))
    assert report.totals.first().total_entries == 2
    assert store.entries().count() == 2 and store.entries().select("id").distinct().count() == 2
    assert store.sources().count() == 1 and store.sources().first().entry_count == 1


@pytest.mark.parametrize("source, why", [("https://x.test/empty", "No documents"), ("https://x.test/short", "No chunks"), ("https://x.test/none", "No documents")])
def test_failed_source_aborts_the_whole_load(spark, store, source, why):
    with pytest.raises(ValueError, match=why):
        load.load_documents(store, BIZ, ["https://x.test/about", source], pages=snapshot(spark), crawl_internal=False)
    assert store.versions() == []
    report = load.load_documents(store, BIZ, ["https://x.test/about", source], pages=snapshot(spark), crawl_internal=False, on_source_error="record")
    status = {r.source_url: (r.status, r.entry_count) for r in report.results.collect()}
    assert status == {"https://x.test/about": ("loaded", 1), source: ("failed", 0)}
    assert report.totals.first().sources_failed == 1


def test_failures_leave_tables_unchanged(spark, store):
    load.load_documents(store, BIZ, ["https://x.test/about"], pages=snapshot(spark), crawl_internal=False, as_of=at(1))

    def broken():
        def model(texts):
            raise RuntimeError("model down")

        return model

    with pytest.raises(Exception, match="model down"):
        load.load_documents(store, BIZ, ["https://x.test/"], pages=snapshot(spark), crawl_internal=False, model=broken)
    with pytest.raises(ValueError, match="category_allowed"):
        load.load_documents(store, BIZ, ["https://x.test/"], pages=snapshot(spark), crawl_internal=False, category="news")
    with pytest.raises(ValueError, match="business_id"):
        load.load_documents(store, BIZ, ["https://x.test/"], pages=snapshot(spark), crawl_internal=False, businesses=spark.createDataFrame([("b",)], "id string"))
    assert store.versions() == [1] and store.entries().count() == 1


def test_load_arguments(spark, store):
    for bad in ("test_business", "", None):
        with pytest.raises(ValueError, match="UUID"):
            load.load_documents(store, bad, ["a"], pages=snapshot(spark))
    for none in (" , ", []):
        with pytest.raises(ValueError, match="at least one source"):
            load.load_documents(store, BIZ, none, pages=snapshot(spark))


def test_files_and_sitemaps(spark, store, tmp_path):
    from lorekeep.sources.pages import text_scan

    (tmp_path / "notes.md").write_text(f"# Title\n{LONG}\n## Part\n{LONG}\n")
    files = text_scan(spark, str(tmp_path / "*.md"))
    url = files.first().url
    report = load.load_documents(store, BIZ, [url], files=files, as_of=at(1))
    assert report.results.first().entry_count == 2
    assert {r.title for r in store.entries().collect()} == {"Title", "Title > Part"}

    xml = "<urlset><url><loc>https://x.test/about</loc></url><url><loc>https://x.test/contact</loc></url></urlset>"
    maps = spark.createDataFrame([("https://x.test/", 200, xml)], "base_url string, status int, xml string")
    report = load.load_sitemap(store, BIZ, maps, snapshot(spark), as_of=at(2))
    assert [(r.source_url, r.entry_count) for r in report.results.collect()] == [("https://x.test/", 1)]


def test_scans_take_only_matching_files_and_readable_bytes(spark, tmp_path):
    from lorekeep.sources import pages

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "bad.txt").write_bytes(b"caf\xc3\xa9 \xff\xfe end\xc3")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "page.html").write_bytes(b"<p>\xe9</p>")
    texts = {r.url.rsplit("/", 1)[1]: r.text for r in pages.text_scan(spark, str(tmp_path), "*.txt").collect()}
    assert texts == {"bad.txt": "café  end"}  # Spark lists no file of 0 bytes
    assert [r.html for r in pages.binary_pages(spark, str(tmp_path), "*.html").collect()] == ["<p></p>"]
    assert pages.binary_pages(spark, str(tmp_path)).count() == 2


def test_rules_are_counted_by_the_writing_job(spark, tmp_path):
    from pyspark.sql import Observation

    rows = [(BIZ, "faq", "t", "c", [1.0, 2.0]), ("biz-1", "faq", "t", "c", [1.0]), (None, "faq", None, "c", None)]
    df = spark.createDataFrame(rows, "business_id string, category string, title string, content string, embedding array<float>")
    seen = Observation()
    st.counted(df, seen, "entries", 2, True).write.parquet(str(tmp_path / "rows"))
    want = {"business_id_not_null": 1, "category_not_null": 0, "title_not_null": 1, "content_not_null": 0, "business_id_uuid": 1, "embedding_width": 1}
    assert seen.get == want
    with pytest.raises(ValueError, match="business_id_uuid"):
        st.require_unbroken(seen, "entries")
    broken = st.constraint_violations(df.withColumn("id", F.lit(1)), "entries", width=2, uuid=True)
    assert sorted(r.rule for r in broken.collect()) == sorted(k for k, n in want.items() if n)


def test_load_passes_crawl_and_gate_parameters(spark, store):
    counts = {}
    for name, options in (("home", {"max_depth": 1}), ("crawled", {}), ("gated", {"max_words": 1})):
        report = load.load_documents(store, BIZ, ["https://x.test/"], pages=snapshot(spark), as_of=at(1), load_id=name, mode="replace", on_source_error="record", **options)
        counts[name] = report.results.first().entry_count
    assert counts["home"] < counts["crawled"] and counts["gated"] == 0


def test_source_lists(spark):
    assert [tuple(r) for r in lists.parse_sources(spark, " a, ,b ,").collect()] == [(0, "a"), (1, "b")]
    rows = spark.createDataFrame([("x", []), ("y", ["a"])], "k string, l array<string>")
    with pytest.raises(Exception, match="at least one source"):
        lists.require_rows(rows, "l").collect()
    routes = lists.route(spark.createDataFrame([("https://a/x.pdf",), ("https://a/x",), ("n.txt",), ("b.docx",)], "source_url string"))
    assert [r.route for r in routes.collect()] == ["quarantine", "html", "file", "quarantine"]
