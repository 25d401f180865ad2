"""Search, crawl, sitemap, fetch log, quality reports and streaming on literal inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import vectors as vx
from lorekeep.operators import crawl, events, html, quality, search
from lorekeep.operators import store as stores
from lorekeep.sources import pages as scans
from lorekeep.sources import sitemap
from lorekeep.streaming import history, ingest

# ---- search

ENTRY = "id int, business_id string, is_active boolean, embedding array<float>"
ROWS = [
    (1, "b1", True, [0.8, 0.6]),
    (2, "b1", True, [2.0, 0.0]),
    (3, "b1", False, [1.0, 0.0]),
    (4, "b2", True, [1.0, 0.0]),
    (5, "b1", True, None),
    (6, "b1", True, [0.0, 0.0]),
    (7, "b1", True, [0.0, 1.0]),
]
QUESTION = "question_id string, business_id string, embedding array<float>"


def test_single_question(spark):
    hits = search.search(spark.createDataFrame(ROWS, ENTRY), "b1", F.lit([1.0, 0.0]), 0.6, 2).collect()
    assert [(r.id, round(r.similarity, 6)) for r in hits] == [(2, 1.0), (1, 0.8)]


def test_batch_agrees_and_counts_contexts(spark):
    entries = spark.createDataFrame(ROWS, ENTRY)
    asked = spark.createDataFrame(
        [("q1", "b1", [1.0, 0.0]), ("q2", "b2", [0.0, 1.0]), ("q3", "b1", [0.0, 0.0]), ("q4", "b9", [1.0, 0.0]), ("q5", "b1", None)], QUESTION
    )
    hits = search.search_batch(entries, asked, 0.6, 2)
    assert {(r.question_id, r.id, round(r.similarity, 6), r.hit_rank) for r in hits.collect()} == {("q1", 2, 1.0, 1), ("q1", 1, 0.8, 2)}
    counts = {r.question_id: r.context_count for r in search.context_count(asked, hits).collect()}
    assert counts == {"q1": 2, "q2": 0, "q3": 0, "q4": 0, "q5": 0}
    assert search.search_batch(entries, asked.filter("question_id = 'none'")).count() == 0


def _random_corpus(spark, n=400, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dim)).astype("float32")
    vectors[n // 2 :: 7] = vectors[0]  # a group of exact copies
    tenants = ["hot" if i % 3 else f"t{i % 4}" for i in range(n)]
    rows = [(i, tenants[i], i % 11 != 0, vectors[i].tolist()) for i in range(n)]
    return rows, vectors, tenants


def _brute(rows, asked, threshold, k):
    out = {}
    for qid, tenant, q in asked:
        scored = []
        for i, t, active, v in rows:
            if t == tenant and active:
                a, b = np.array(v, dtype=np.float64), np.array(q, dtype=np.float64)
                s = round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9)
                if s >= threshold:
                    scored.append((-s, i))
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            out[qid, rank] = (i, -s)
    return out


@pytest.mark.parametrize("block_rows", [search.BLOCK_ROWS, 7])
def test_batch_equals_brute_force(spark, monkeypatch, block_rows):
    """In one block per scope and batch and in many."""
    monkeypatch.setattr(search, "BLOCK_ROWS", block_rows)
    rows, vectors, tenants = _random_corpus(spark)
    asked = [(f"q{i}", tenants[i], vectors[i].tolist()) for i in range(0, len(rows))]
    entries = spark.createDataFrame(rows, ENTRY).repartition(5)
    hits = search.search_batch(entries, spark.createDataFrame(asked, QUESTION), 0.2, 4)
    got = {(r.question_id, r.hit_rank): (r.id, r.similarity) for r in hits.collect()}
    want = _brute(rows, asked, 0.2, 4)
    assert {key: hit[0] for key, hit in got.items()} == {key: hit[0] for key, hit in want.items()}
    assert max(abs(got[key][1] - want[key][1]) for key in want) < 1e-8


def test_a_vector_is_sent_once_for_each_block_of_the_other_side(spark, monkeypatch):
    """What goes to Python grows with entries plus questions, and no pair of blocks carries both sides whole."""
    monkeypatch.setattr(search, "BLOCK_ROWS", 50)
    monkeypatch.setattr(search, "ENTRY_ROWS", 100)
    entries = spark.range(1_000).selectExpr("id", "'t' AS business_id", "array(1.0f, cast(id AS float)) AS embedding")
    for n, blocks in ((40, 1), (400, 8)):
        asked = spark.range(n).selectExpr("id AS question_id", "'t' AS business_id", "array(1.0f, cast(id AS float)) AS embedding")
        met = search._met(asked, entries, ["business_id"])
        assert met.count() == 1_000 * blocks + n * 10
        first = met.groupBy("_e", "_q").agg(F.count_if(F.col("id").isNull()).alias("asked")).agg(F.max("asked")).first()[0]
        assert first <= 100


@pytest.mark.parametrize("kind, element", [("float", "<f4"), ("double", "<f8")])
def test_vectors_are_packed_on_the_way(spark, kind, element):
    """Mostly zero vectors leave as the values that are not zero; what is unpacked is what went in."""
    sparse = [0.0] * 1536
    sparse[3], sparse[1500] = 0.5, -2.0
    vectors = [sparse, [1.0, 0.0, 3.0], [0.0, 0.0, 2.0], [0.0] * 8, None]
    entries = spark.createDataFrame([(i, "t", v) for i, v in enumerate(vectors)], f"id long, business_id string, embedding array<{kind}>")
    asked = entries.withColumnRenamed("id", "question_id").filter("question_id = 0")
    met = search._met(asked, entries, ["business_id"]).filter("id is not null").select("id", "packed.*").orderBy("id").toArrow()
    size = np.dtype(element).itemsize
    assert [len(v) for v in met["values"].to_pylist()] == [2 * size, 3 * size, size, 0]
    for i, width in enumerate(met["width"].to_pylist()):
        row = met.slice(i, 1).combine_chunks()
        found = vx.unpacked(row["places"].chunk(0), row["values"].chunk(0), width, element)
        assert found.tolist() == [vectors[i]]


def test_embedded_texts_leave_in_small_batches(spark):
    """One batch of texts comes in; its vectors, which are far wider, go out in several."""
    from lorekeep.operators import embed

    rows = spark.range(2 * embed.OUT_ROWS + 1).coalesce(1).selectExpr("id", "if(id = 5, null, concat('word', id)) AS text")
    out = embed.embed_chunks(rows).selectExpr("id", "text is null AS no_text", "embedding is null AS no_vector", "size(embedding) AS n").collect()
    assert [r.id for r in out] == list(range(2 * embed.OUT_ROWS + 1))
    assert all(r.no_text == r.no_vector and (r.no_text or r.n == 1536) for r in out)


def test_blocks_are_written_once_however_many_meet(spark, monkeypatch, tmp_path):
    """Of 8 blocks of questions and 10 of entries, 80 pairs meet; no row is multiplied on its way, and each vector is stored once."""
    monkeypatch.setattr(search, "BLOCK_ROWS", 50)
    monkeypatch.setattr(search, "ENTRY_ROWS", 100)
    monkeypatch.setattr(search, "scratch_path", lambda *_: str(tmp_path / "blocks"), raising=False)
    entries = spark.range(1_000).selectExpr("id", "'t' AS business_id", "array(1.0f, cast(id AS float)) AS embedding")
    asked = spark.range(400).selectExpr("id AS question_id", "'t' AS business_id", "array(1.0f, cast(id AS float)) AS embedding")
    met = search._met(asked, entries, ["business_id"])
    assert "Generate" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 1_000 * 8 + 400 * 10
    # A vector of two floats is 8 bytes, and each of 18 blocks is a stream with a schema of its own.
    assert sum(f.stat().st_size for f in (tmp_path / "blocks").iterdir()) < 1_400 * 80 + 18 * 2_000


def test_hits_of_a_question_leave_few_tasks(spark, monkeypatch):
    """What leaves the scoring grows with the questions, not with the entry blocks that they meet."""
    monkeypatch.setattr(search, "ENTRY_ROWS", 10)
    entries = spark.range(1_000).selectExpr("id", "'t' AS business_id", "array(1.0f, cast(id AS float)) AS embedding")
    asked = spark.range(40).selectExpr("id AS question_id", "'t' AS business_id", "array(1.0f, cast(id AS float)) AS embedding")
    scored = search._score(asked, entries, ["business_id"], -1.0, 3).groupBy("question_id").agg(F.count("id").alias("n")).collect()
    assert len(scored) == 40 and all(3 <= r.n <= 16 * 3 for r in scored)


def test_mostly_zero_questions_equal_brute_force(spark, monkeypatch):
    """Places that many questions hold, places that few hold, none at all, equal and zero vectors; in several steps of a block."""
    monkeypatch.setattr(search, "STEP", 64)
    monkeypatch.setattr(search, "FIRST", 16)
    rng = np.random.default_rng(3)
    vectors = np.zeros((300, 240), np.float32)
    for row in vectors:
        places = np.concatenate([rng.choice(12, 4, replace=False), 12 + rng.choice(228, 8, replace=False)])
        row[places] = rng.integers(-2, 4, len(places))
    vectors[200::9], vectors[7], vectors[8] = vectors[0], 0, np.eye(1, 240, 239)
    rows = [(i, f"t{i % 2}", i % 11 != 0, v.tolist()) for i, v in enumerate(vectors)]
    asked = [(f"q{i}", f"t{i % 2}", v.tolist()) for i, v in enumerate(vectors)]
    hits = search.search_batch(spark.createDataFrame(rows, ENTRY), spark.createDataFrame(asked, QUESTION), 0.2, 4)
    got = {(r.question_id, r.hit_rank): (r.id, r.similarity) for r in hits.collect()}
    want = _brute([r for r in rows if any(r[3])], [q for q in asked if any(q[2])], 0.2, 4)
    assert {key: hit[0] for key, hit in got.items()} == {key: hit[0] for key, hit in want.items()}
    assert max(abs(got[key][1] - want[key][1]) for key in want) < 1e-8


def test_ties_at_the_floor_and_in_many_blocks(spark, monkeypatch):
    """Equal vectors tie; the smallest ids win wherever their blocks end."""
    rows = [(i, "t", True, [1.0, 0.0] if i % 2 else [0.6, 0.8]) for i in range(300)]
    entries = spark.createDataFrame(rows, "id long, business_id string, is_active boolean, embedding array<double>")
    asked = spark.createDataFrame([("a", "t", [1.0, 0.0]), ("b", "t", [0.6, 0.8]), ("c", "t", [0.0, 1.0])], "question_id string, business_id string, embedding array<double>")
    for size in (2048, 16):
        monkeypatch.setattr(search, "ENTRY_ROWS", size)
        hits = search.search_batch(entries, asked, 0.6, 3).collect()
        got = sorted((r.question_id, r.hit_rank, r.id, round(r.similarity, 9)) for r in hits)
        assert got == [("a", 1, 1, 1.0), ("a", 2, 3, 1.0), ("a", 3, 5, 1.0), ("b", 1, 0, 1.0), ("b", 2, 2, 1.0), ("b", 3, 4, 1.0), ("c", 1, 0, 0.8), ("c", 2, 2, 0.8), ("c", 3, 4, 0.8)]


def test_saved_centroids_give_new_vectors_the_same_cells(spark, tmp_path):
    rows, _, _ = _random_corpus(spark)
    entries = spark.createDataFrame(rows, ENTRY)
    celled, index = search.ann_build(entries, lists=6)
    index.save(spark, str(tmp_path / "centroids"))
    again = search.CellIndex.load(spark, str(tmp_path / "centroids"))
    assert np.allclose(again.centroids, index.centroids)
    first = {r.id: r.cell for r in celled.collect()}
    later = entries.limit(50).withColumn("cell", again.assign(F.col("embedding")))
    assert all(first[r.id] == r.cell for r in later.collect())


def test_cells(spark):
    rows, vectors, tenants = _random_corpus(spark)
    entries = spark.createDataFrame([*rows, (9999, "hot", True, None)], ENTRY)
    asked = spark.createDataFrame([(f"q{i}", tenants[i], vectors[i].tolist()) for i in range(60)], QUESTION)
    celled, index = search.ann_build(entries, lists=6)
    assert celled.filter("cell is null").count() == 1
    exact = search.search_batch(entries, asked, 0.2, 3)
    every = search.search_batch(celled, asked, 0.2, 3, index=index, nprobe=6)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    shares = [search.recall(search.search_batch(celled, asked, 0.2, 3, index=index, nprobe=n), exact).first().recall for n in (1, 3, 6)]
    assert shares[0] <= shares[1] <= shares[2] == 1.0 and shares[1] > 0.5


def test_keywords_and_metadata(spark):
    rows = spark.createDataFrame([(1, "The cat sat", '{"k":1}'), (2, "A cat", '{"k":2}'), (3, "the dog", None)], "id int, content string, metadata string")
    posted = search.postings(rows)
    assert [r.id for r in search.keyword_search(posted, ["CAT", "the", "cat"]).collect()] == [1]
    assert search.keyword_search(posted, ["cow"]).count() == 0
    assert [r.id for r in search.metadata_filter(rows, "metadata", "k", 2, "int").collect()] == [2]


def _scan(df):
    """The partition filters of all scans."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(part.split("]")[0] for part in plan.split("PartitionFilters")[1:])


def test_saved_indexes_prune_their_scans(spark, tmp_path):
    rows, vectors, tenants = _random_corpus(spark)
    texts = spark.createDataFrame([(i, f"the word{i % 9} of entry {i}") for i in range(200)], "id int, content string")
    posted = search.save_by(search.postings(texts), str(tmp_path / "postings"), "shelf")
    found = search.keyword_search(posted, ["word3", "the"])
    assert {r.id for r in found.collect()} == {i for i in range(200) if i % 9 == 3}
    assert "shelf" in _scan(found)

    celled, index = search.ann_build(spark.createDataFrame(rows, ENTRY), lists=6)
    saved = search.save_by(celled, str(tmp_path / "cells"), "cell")
    spark.createDataFrame([(f"q{i}", tenants[i], vectors[i].tolist()) for i in range(3)], QUESTION).write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked"))
    one = search.search_batch(saved, asked, 0.2, 3, index=index, nprobe=1)
    assert "dynamicpruningexpression(cell" in _scan(one)
    full = search.search_batch(saved, asked, 0.2, 3, index=index, nprobe=6)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, search.search_batch(saved.drop("cell"), asked, 0.2, 3).collect()))


def test_search_is_one_lazy_plan_at_every_size(spark, tmp_path):
    rows, _, _ = _random_corpus(spark)
    stored = str(tmp_path / "entries")
    spark.createDataFrame([(*r, "f", "t", "c", None) for r in rows], ENTRY + ", category string, title string, content string, metadata string").withColumns(
        {"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    ).write.partitionBy("business_id").parquet(stored)
    entries, plans = spark.read.parquet(stored), []
    tracker = spark.sparkContext.statusTracker()
    for n in (10, 100_000):
        path = str(tmp_path / f"asked-{n}")
        spark.range(n).selectExpr("cast(id AS string) AS question_id", "'t1' AS business_id", "array_repeat(1.0f, 8) AS embedding").write.parquet(path)
        asked = spark.read.parquet(path)
        spark.sparkContext.setJobGroup(f"plan-{n}", "planning")
        hits = search.search_batch(entries, asked, 0.2, 3)
        full = search.with_entries(hits, entries)
        plan = full._jdf.queryExecution().executedPlan().toString()
        assert not tracker.getJobIdsForGroup(f"plan-{n}")
        scans = [line for line in plan.splitlines() if "FileScan" in line and ("is_active" in line or "category" in line)]
        assert len(scans) >= 2 and all("dynamicpruning" in line for line in scans)
        logical = full._jdf.queryExecution().optimizedPlan().toString()
        plans.append([line.strip(" +-:").split()[0] for line in logical.splitlines() if line.strip()])
    assert plans[0] == plans[1]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_vectors_of_another_length_match_nothing(spark):
    mixed = spark.createDataFrame([*ROWS, (8, "b1", True, [1.0, 0.0, 0.0]), (9, "b1", True, [])], ENTRY).coalesce(1)
    asked = spark.createDataFrame([("q", "b1", [1.0, 0.0]), ("r", "b1", [1.0, 0.0, 0.0])], QUESTION)
    hits = search.search_batch(mixed, asked, 0.6, 5).collect()
    assert {(r.question_id, r.id) for r in hits} == {("q", 1), ("q", 2), ("r", 8)}
    assert {r.id for r in search.search(mixed, "b1", F.lit([1.0, 0.0, 0.0]), 0.6, 5).collect()} >= {8}


def test_the_same_id_in_two_businesses_stays_apart(spark):
    wide = ENTRY + ", category string, title string, content string, metadata string"
    rows = [(1, "b1", True, [1.0, 0.0], "f", "t", "mine", None), (1, "b2", True, [0.0, 1.0], "f", "t", "theirs", None)]
    entries = spark.createDataFrame(rows, wide).withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    asked = spark.createDataFrame([("q", "b1", [1.0, 0.0])], QUESTION)
    assert [r.text for r in search.with_entries(search.search_batch(entries, asked), entries).collect()] == ["mine"]


def test_fixed_vector_similarity_is_the_pairwise_one(spark):
    df = spark.createDataFrame([(r[0], r[3]) for r in ROWS], "id int, v array<float>")
    pairs = df.select(search.vx.similarity_to(F.col("v"), [0.6, 0.8]).alias("a"), search.vx.cosine_similarity(F.col("v"), F.lit([0.6, 0.8])).alias("b"))
    for a, b in pairs.collect():
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    assert df.select(search.vx.similarity_to(F.col("v"), [0.0, 0.0])).distinct().collect() == [(None,)]


# ---- crawl

BASE = "https://x.test/"
LINKED = [
    (BASE, ["/", "/about", "/contact", "https://www.x.test/team", "https://y.test/z", "mailto:a@x.test"]),
    ("https://x.test/about", ["/about/history"]),
    ("https://www.x.test/team", ["/blog/one"]),
]


def _edges(spark, linked=LINKED):
    pages = [(url, "".join(f'<a href="{h}">x</a>' for h in hrefs)) for url, hrefs in linked]
    return crawl.build_edges(spark.createDataFrame(pages, "url string, html string"))


def _crawl(spark, edges, **options):
    found = crawl.reachable(spark.createDataFrame([(BASE,)], "root string"), edges, **options)
    return {r.url for r in found.collect()}


def test_default_crawl(spark):
    edges = _edges(spark)
    want = {BASE, "https://x.test", "https://x.test/about", "https://www.x.test/team"}
    assert _crawl(spark, edges) == want
    assert _crawl(spark, edges, max_urls=2) == want
    assert _crawl(spark, edges, max_urls=1) == {BASE}
    assert _crawl(spark, edges, dedupe="canonical") == want - {"https://x.test"}
    assert _crawl(spark, edges, max_depth=3) == want | {"https://x.test/about/history", "https://www.x.test/blog/one"}


@pytest.mark.parametrize("depth, read", [(2, {BASE}), (3, {url for url, _ in LINKED})])
def test_only_pages_of_the_crawl_are_parsed(spark, depth, read):
    linked = [*LINKED, ("https://other.test/", ["/x"])]
    pages = spark.createDataFrame([(u, "".join(f'<a href="{h}">x</a>' for h in hs)) for u, hs in linked], "url string, html string")
    picked = crawl.pages_to_read(pages, spark.createDataFrame([(BASE,)], "root string"), depth)
    assert {r.url for r in picked.collect()} == read
    assert _crawl(spark, crawl.build_edges(picked), max_depth=depth) == _crawl(spark, _edges(spark, linked), max_depth=depth)


def test_a_level_is_never_cut(spark):
    edges = _edges(spark, [(BASE, [f"/p{i}" for i in range(60)])])
    assert len(_crawl(spark, edges)) == 61


def test_crawl_is_breadth_first_search(spark):
    rng = random.Random(11)
    names = [f"https://x.test/n{i}" for i in range(40)] + [BASE]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(90)} | {(BASE, names[i]) for i in range(3)}
    edges = spark.createDataFrame(sorted(p for p in pairs if p[0] != p[1]), "src string, dst string")
    depth = {BASE: 0}
    for level in range(1, 5):
        for a, b in sorted(pairs):
            if depth.get(a) == level - 1 and b not in depth:
                depth[b] = level
    found = crawl.reachable(spark.createDataFrame([(BASE,)], "root string"), edges, max_depth=5, max_urls=None)
    assert {r.url: r.depth for r in found.collect()} == depth


def test_link_preview(spark):
    rows = [("u", 0, "a"), ("u", 1, "b"), ("u", 2, "c"), ("u", 3, "d"), ("v", 0, "e")]
    got = html.link_preview(spark.createDataFrame(rows, "url string, link_ix int, target string")).collect()
    assert {(r.url, r.first_links, r.more) for r in got} == {("u", "a b c", 1), ("v", "e", 0)}


# ---- sitemaps and fetch logs

NS = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


def _locs(spark, status, xml):
    df = spark.createDataFrame([("https://x.test/", status, xml)], "base_url string, status int, xml string")
    return [r.url for r in sitemap.sitemap_urls(df).collect()]


def test_sitemaps(spark):
    assert _locs(spark, 200, NS + "<url><loc>a</loc></url><url><loc>b</loc></url></urlset>") == ["a", "b"]
    assert _locs(spark, 200, "<urlset><url><loc>a&amp;b</loc></url></urlset>") == ["a&b"]
    assert _locs(spark, 200, "<sitemapindex><sitemap><loc>m.xml</loc></sitemap></sitemapindex>") == ["m.xml"]
    assert _locs(spark, 404, None) == ["https://x.test"]
    assert _locs(spark, 200, "<urlset></urlset>") == []
    with pytest.raises(Exception):
        _locs(spark, 200, "<urlset><url>")
    with pytest.raises(Exception, match="failed to fetch"):
        _locs(spark, 500, None)
    at = sitemap.sitemap_location(spark.createDataFrame([("https://x.test/a/b",)], "base_url string")).first()
    assert at.sitemap_url == "https://x.test/a/sitemap.xml"


def test_fetch_outcomes(spark):
    log = [
        ("u1", 1, 500, None), ("u1", 2, 200, None), ("u2", 1, 403, None), ("u2", 2, 200, None), ("u3", 1, None, "timeout"), ("u3", 2, None, "timeout"),
        ("u4", 1, 500, None), ("u4", 2, 502, None), ("u4", 3, 200, None), ("u5", 1, None, "dns"), ("u6", 1, 200, None),
    ]
    df = spark.createDataFrame(log, "url string, attempt int, status int, error string")
    got = {r.url: (r.outcome, r.status, r.attempts) for r in scans.fetch_outcome(df, ["url"]).collect()}
    assert got == {
        "u1": ("ok", 200, 2), "u2": ("bot_protected", 403, 1), "u3": ("timeout", None, 2),
        "u4": ("http_error", 502, 2), "u5": ("error", None, 1), "u6": ("ok", 200, 1),
    }
    assert spark.range(1).select(scans.retry_delay(F.lit(1)), scans.retry_delay(F.lit(2))).first()[:] == (1.0, 2.0)


# ---- quality


def test_grades(spark):
    rows = [(1, 1, a) for a in (29.9, 30.0, 49.9, 50.0, 99.9, 100.0)] + [(0, 0, None), (2, 0, None)]
    df = spark.createDataFrame(rows, "d int, c int, a double")
    got = [r[0] for r in df.select(quality.grade(F.col("d"), F.col("c"), F.col("a"))).collect()]
    assert got == ["POOR", "FAIR", "FAIR", "GOOD", "GOOD", "EXCELLENT", "FAILED", "POOR"]


def test_site_counts_and_report(spark):
    words = [19, 20, 29, 30, 200, 201]
    chunks = spark.createDataFrame([("s", "w " * n, ["A", "B"] if n > 100 else ["A"]) for n in words], "site string, text string, headings array<string>")
    sites = spark.createDataFrame([("s", 0), ("t", 1), ("v", 2)], "site string, seq int")
    docs = spark.createDataFrame([("s",), ("s",), ("t",)], "site string")
    got = {r.site: r for r in quality.site_quality(sites, docs, chunks).collect()}
    assert (got["s"].tiny_chunks, got["s"].quality_chunks, got["s"].avg_words, got["s"].hierarchical_pct) == (1, 2, 83.2, 33.3)
    assert (got["t"].status, got["t"].error, got["v"].status, got["v"].error) == ("POOR", "No chunks created", "FAILED", "No documents extracted")
    all_sites = quality.site_quality(sites, docs, chunks)
    assert quality.site_summary(all_sites).first()[:2] == (1, 2)
    best = quality.site_best_worst(all_sites).first()
    assert (best.best, best.worst) == ("s", None)


def test_full_report(spark):
    texts = [("s", 0, "Physio team service " + "w " * 60, ["A", "B"]), ("s", 1, "ten years", ["A"]), ("s", 2, "see right TXT here", None)]
    chunks = spark.createDataFrame(texts, "source string, ix int, text string, headings array<string>")
    row = quality.full_report(chunks, ["source"], ["ix"]).first()
    assert (row.total_chunks, row.min_words, row.max_words, row.avg_words) == (3, 2, 63, 23.0)
    assert (row.has_physio_content, row.has_team_info, row.has_services) == (True, True, True)
    assert (row.hierarchical_titles, row.unique_titles, row.examples) == (1, 3, ["A > B"])
    assert row.issues == ["chunks too small", "right txt artifacts", "fragmented stats"]


def test_recall_writes_and_sends_no_texts(spark, monkeypatch):
    from oracle import DATA

    from lorekeep.plans.catalog import search_q

    written, write = [], search_q.cut_lineage

    def noted(df):
        written.append(set(df.columns))
        return write(df)

    monkeypatch.setattr(search_q, "cut_lineage", noted)
    shares = {r.probes: (r.exact_hits, r.recall) for r in search_q.ann_recall(spark, f"{DATA}/sf0.001").collect()}
    assert written and not any(columns & {"content", "title"} for columns in written)
    exact = search_q._hits(spark, f"{DATA}/sf0.001").count()
    assert {n for n, _ in shares.values()} == {exact} and shares[10][1] == 1.0


def test_crawl_tasks_grow_with_the_rows(spark, monkeypatch):
    """Links and reached pages are dealt out by their number: no task holds more because the session has few shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = spark.range(400).selectExpr("concat('https://s', id % 4, '.test/p', id) AS src", "concat('https://s', id % 4, '.test/p', id + 4) AS dst")
    roots = spark.range(4).selectExpr("concat('https://s', id, '.test/p', id) AS root")
    few = crawl.reachable(roots, edges, max_depth=5, max_urls=None)
    monkeypatch.setattr(crawl, "TASK_ROWS", 10)
    many = crawl.reachable(roots, edges, max_depth=5, max_urls=50)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    assert crawl._tasks(few, 400) > least
    wide = spark.range(10 * least + 5).selectExpr("'r' AS root", "cast(id AS string) AS url", "1 AS depth")
    listed = crawl.listing(wide)
    assert listed.rdd.getNumPartitions() > least
    assert [r.url for r in listed.collect()] == sorted(str(i) for i in range(10 * least + 5))
    assert crawl.accepted_edges(edges, 3 * least).rdd.getNumPartitions() == 3 * least
    assert crawl.new_links(edges.select("dst"), edges.selectExpr("src AS dst"), ["dst"], 3 * least).count() == 4


# ---- events

STORED = [("s", f"e{i}", i, "m") for i in range(1, 6)] + [("t", "f1", 9, "m")]
EVENT = "stream_id string, event_id string, seq long, message string"


def test_history_and_replay(spark):
    kept = events.last_n(spark.createDataFrame(STORED, EVENT), 3)
    assert {r.event_id for r in kept.collect()} == {"e3", "e4", "e5", "f1"}
    asked = spark.createDataFrame([("e3",), ("e5",), ("e1",), ("zzz",)], "event_id string")
    later = events.replay(kept, asked).orderBy("last_event_id", "seq").collect()
    assert [(r.last_event_id, r.event_id) for r in later] == [("e3", "e4"), ("e3", "e5")]
    streams = {r.last_event_id: (r.stream_id, r.n_after) for r in events.replay_streams(kept, asked).collect()}
    assert streams == {"e3": ("s", 2), "e5": ("s", 0), "e1": (None, 0), "zzz": (None, 0)}


def test_first_and_last_n_are_cut_before_the_shuffle(spark):
    """A group holding most rows leaves at most n rows per map task."""
    rows = spark.range(10).selectExpr("cast(id % 2 AS string) AS stream_id", "cast(id % 2 AS string) AS root", "cast(id % 2 AS string) AS url", "id AS seq", "id AS link_ix", "1 AS depth", "'t' AS target", "'x y' AS text", "array('a', 'b') AS headings")
    plans = {
        "last_n": events.last_n(rows, 3),
        "budget": crawl.budget(rows, 3),
        "samples": quality.chunk_samples(rows, ["stream_id"], ["seq"]),
        "titles": quality.title_examples(rows, ["stream_id"], ["seq"]),
        "links": html.link_preview(rows),
    }
    for name, df in plans.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_history_state_holds_rows_not_frames():
    """A trigger of a stream is plain rows, one read and one write of its state; doubled events count once, as first delivered."""

    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    state = history._History(2)
    state.kept = Value()

    def trigger(*events):
        rows = iter([history.Row(stream_id="s", event_id=e, seq=n, message=m) for e, n, m in events])
        return [(r["event_id"], r["seq"], r["message"], r["kept"]) for r in state.handleInputRows(("s",), rows, None)]

    assert trigger(("a", 1, "é"), ("b", 2, None), ("b2", 2, "x")) == [("a", 1, "é", True), ("b", 2, None, True)]
    assert state.kept.calls == 2
    assert trigger(("b", 2, None), ("old", 0, "m")) == []
    assert trigger(("c", 3, "m")) == [("c", 3, "m", True), ("a", 1, None, False)]


def test_stream_history_over_batches_and_restart(spark, tmp_path):
    rng = random.Random(2)
    seqs = list(range(300))
    rows = [("hot" if rng.random() < 0.5 else f"s{rng.randrange(6)}", f"e{i}", i, f"m{i}") for i in seqs]
    source, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    for part in (rows[:100], rows[100:120], rows[120:]):
        spark.createDataFrame(part, EVENT).coalesce(3).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 2).parquet(source)
        # each round is a restart from the same progress folder
        history.write_history(history.stream_last_n(arriving, 7), out, progress).awaitTermination()
    changes = spark.read.parquet(out)
    kept, left = (changes.filter(x).count() for x in ("kept", "not kept"))
    assert kept <= len(rows) and left <= kept, "a change is stored once, what stays is not stored again"
    assert changes.filter("kept").groupBy("stream_id", "seq").count().filter("count > 1").count() == 0
    got = {r.event_id for r in history.read_history(changes).collect()}
    assert kept - left == len(got)
    assert got == {r.event_id for r in events.last_n(spark.createDataFrame(rows, EVENT), 7).collect()}


def test_stream_ingest_is_idempotent(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(20))
    biz = "12345678-1234-5678-1234-567812345678"
    store = stores.Store(spark, str(tmp_path / "store"))
    landing, progress = str(tmp_path / "in"), str(tmp_path / "progress")

    def land(*urls):
        rows = [(biz, "https://x.test", u, f"<h1>{u}</h1><p>{text}</p>", "website") for u in urls]
        df = spark.createDataFrame(rows, "business_id string, source_url string, url string, html string, category string")
        df.withColumn("captured_at", F.timestamp_seconds(F.lit(7))).coalesce(1).write.mode("append").parquet(landing)

    def run():
        arriving = spark.readStream.schema(ingest.CAPTURE).parquet(landing)
        ingest.stream_ingest(store, arriving, "captures", progress).awaitTermination()

    land("https://x.test/a", "https://x.test/b")
    run()
    land("https://x.test/c")
    run()
    run()
    assert store.entries().count() == 3 and store.sources().count() == 1
    batch = spark.read.schema(ingest.CAPTURE).parquet(landing)
    ingest.ingest_batch(store, "captures", batch, 1)
    assert store.entries().count() == 3, "a batch delivered again is left alone"
    assert store.manifest()["batches"] == {"captures": 1}
