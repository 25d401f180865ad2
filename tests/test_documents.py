"""HTML reading, chunking and embedding on literal documents."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import packing
from lorekeep.functions.markup import PageReader
from lorekeep.operators import chunking, embed, html
from lorekeep.operators.numbering import running_sums
from lorekeep.schemas import BLOCKS_DDL

PAGES = [
    ('<nav><a href="/t">N</a></nav><p>a</p><p>b</p>', "ab", ["/t"]),
    ("<p>a </p><script>x</script><style>y</style><noscript>z</noscript>b", "a b", []),
    ('<div class="Big-Cookie">c</div><div class="ad">d</div>', "d", []),
    ('<div style="display:none">h</div><div style="display: none">v</div>', "v", []),
    ('<div><p class="popup">gone<b>too</b></div>kept', "kept", []),
    ("<p>x &amp; y</p><!-- c -->", "x & y", []),
    ("<nav>a<nav>b</nav>c</nav>d", "d", []),
    ("<nav>never closed<p>x", "", []),
    ("</nav>x</div>y", "xy", []),
    ('<a name="n">x</a><a HREF=/q?a=1&amp;b=2>y</a><a data-href="/z">w</a>', "xyw", ["/q?a=1&b=2"]),
    ('<!-- <a href="/no">x</a> --><script>"<a href=\'/no\'>"</script>t', "t", []),
    ('<img class="modal" src=x>a<br class="popup">b', "ab", []),
    ("a<div class='popup'/>b", "ab", []),
    ("x &amp<b>y</b> &copy2 &nope; &#8364;&#x41; & z &lt;b&gt;", "x &y &copy2 &nope €A & z <b>", []),
    ("<template>no</template><ruby>k<rt>r</rt></ruby>", "k", []),
]


@pytest.mark.parametrize("source, text, links", PAGES)
def test_page_text_and_links(source, text, links):
    page = PageReader(source, blocks=True)
    assert "".join(page.text) == text
    assert page.links == links


def test_cleaning_keeps_source_text_outside_the_cuts():
    page = PageReader('<DIV  Class=x>a&nbsp;<b>\n<nav>n</nav> c<div style="visibility:hidden">h<p>i</div>&lt;', blocks=False)
    assert "".join(page.kept) == "<DIV  Class=x>a&nbsp;<b>\n c&lt;"


def test_blocks():
    page = (
        "<title>T</title><h1>Home</h1><p>intro <b>bold</b> end<h2>Services</h2><ul><li>a<li>b</ul>"
        "<table><tr><th>Name<th>Role<th>Dept</tr><tr><td>John</td><td>Physio</td><td>Sports</td></tr></table><h1>Z</h1>tail<h3>deep</h3>x"
    )
    blocks = PageReader(page, blocks=True).blocks
    assert [(b["kind"], b["headings"], b["text"]) for b in blocks] == [
        ("heading", ["Home"], "Home"),
        ("paragraph", ["Home"], "intro bold end"),
        ("heading", ["Home", "Services"], "Services"),
        ("list_item", ["Home", "Services"], "a"),
        ("list_item", ["Home", "Services"], "b"),
        ("table", ["Home", "Services"], "John, Role = Physio. John, Dept = Sports"),
        ("heading", ["Z"], "Z"),
        ("paragraph", ["Z"], "tail"),
        ("heading", ["Z", "deep"], "deep"),
        ("paragraph", ["Z", "deep"], "x"),
    ]


def test_html_blocks_and_markdown(spark):
    rows = spark.createDataFrame([("u", "<h2>A</h2><ul><li>b</ul>c")], "url string, html string")
    out = html.html_blocks(rows).select(html.markdown(F.col("blocks")).alias("m")).first()
    assert out.m == "## A\n\n- b\n\nc"


def test_gates(spark):
    pages = spark.createDataFrame(
        [("at", "<p>" + "w " * 10 + "</p>"), ("over", "w " * 11), ("empty", "<nav>x</nav>"), ("glued", "<p>a</p>" * 50)],
        "url string, html string",
    )
    assert {r.url for r in html.read_documents(pages, max_words=10).collect()} == {"at"}
    # glued words count once in the first gate, singly in the second
    n = {r.url: r.n for r in pages.select("url", html.read_page(F.col("html"), "n_words")["n_words"].alias("n")).collect()}
    assert n == {"at": 10, "over": 11, "empty": 0, "glued": 1}


def test_page_is_parsed_once_under_filters(spark):
    pages = spark.createDataFrame([("u", "<p>a")], "url string, html string")
    plan = html.read_documents(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_document_is_packed_once(spark):
    docs = spark.createDataFrame([("d", "a\nb")], "id string, text string").select("id", html.text_blocks(F.col("text")).alias("blocks"))
    plan = chunking.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan


def test_table_sentences(spark):
    rows = spark.createDataFrame(
        [("t", 1, ["John Smith", "Senior Physiotherapist", "Sports Medicine"]), ("t", 2, ["Solo"]), ("t", 3, ["A", "b", "c", "extra"])],
        "t string, row_ix int, cells array<string>",
    )
    header = F.array(*[F.lit(x) for x in ("Name", "Role", "Department")])
    said = html.table_sentences(rows, ["t"], "row_ix", "cells", header).orderBy("row_ix", "column_ix")
    assert [r.sentence for r in said.collect()] == [
        "John Smith, Role = Senior Physiotherapist", "John Smith, Department = Sports Medicine", "A, Role = b", "A, Department = c",
    ]


def test_parts_of_one_file_are_many_tasks(spark, tmp_path, monkeypatch):
    from lorekeep.plans.catalog import pages_q

    part = "id AS p_partkey, concat('n', id) AS p_name, 'b' AS p_brand, 't' AS p_type, cast(id AS int) AS p_size, 1.5D AS p_retailprice"
    spark.sql(f"SELECT {part} FROM range(0, 100, 1, 1)").write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(pages_q, "PAGE_ROWS", 5)
    said = pages_q.table_sentences(spark, str(tmp_path))
    assert said.rdd.getNumPartitions() == 20
    assert said.count() == 400
    assert said.filter("p_partkey = 7 AND column_ix = 3").first().sentence == "n7, Size = 7"


# ---- chunking


def _chunks(blocks, limit, merge=True):
    shaped = [("paragraph", 0, [h], None, t) for h, t in blocks]
    return [(c.headings[0], " ".join(c.texts)) for c in packing.pack(shaped, limit, merge, packing.word_tokens)]


def test_packing_cases():
    rows = [("A", "1 2"), ("A", "3 4"), ("A", "5 6"), ("B", "7")]
    assert _chunks(rows, 5) == [("A", "1 2 3 4"), ("A", "5 6"), ("B", "7")]
    assert _chunks([("A", "1 2 3 4 5 6 7")], 5) == [("A", "1 2 3 4 5"), ("A", "6 7")]
    assert _chunks([("A", "1 2 3 4 5 6 7"), ("A", "8")], 5) == [("A", "1 2 3 4 5"), ("A", "6 7 8")]
    assert _chunks(rows, 5, merge=False) == [("A", "1 2"), ("A", "3 4"), ("A", "5 6"), ("B", "7")]


def test_packing_properties():
    rng = random.Random(7)
    for _ in range(200):
        blocks = []
        for _ in range(rng.randrange(0, 12)):
            words = ["w" * rng.randrange(1, 4) + rng.choice(["", ",", "-x"]) for _ in range(rng.randrange(1, 30))]
            blocks.append(("paragraph", 0, [rng.choice("AB")], None, " ".join(words)))
        chunks = packing.pack(blocks, 8, True, packing.symbol_tokens)
        said = [w for c in chunks for t in c.texts for w in t.split()]
        assert said == [w for b in blocks for w in b[4].split()]
        for c in chunks:
            size = sum(packing.symbol_tokens(t) for t in c.texts)
            assert c.tokens == size and size <= 8
        for a, b in zip(chunks, chunks[1:]):
            first = packing.symbol_tokens(b.texts[0])
            assert a.headings != b.headings or a.tokens + first > 8, "the merge is maximal"


def test_heading_trail_is_reset_by_higher_headings(spark):
    text = "# A\nx\n## B\ny\n# C\nz\n### D\nw"
    docs = spark.createDataFrame([("d", text)], "id string, text string").select("id", html.text_blocks(F.col("text")).alias("blocks"))
    rows = chunking.chunk_documents(docs, min_chunk_words=1).orderBy("chunk_ix").collect()
    assert [(r.headings, r.text) for r in rows] == [(["A"], "x"), (["A", "B"], "y"), (["C"], "z"), (["C", "D"], "w")]

    page = "<h1>A</h1><p>x</p><h2>B</h2><p>y</p><h1>C</h1><p>z</p><h3>D</h3><p>w</p>"
    read = html.html_blocks(spark.createDataFrame([("d", page)], "id string, html string")).select(F.inline("blocks"))
    trail = read.filter("kind = 'paragraph'").orderBy("ix").collect()
    assert [(r.headings, r.text) for r in trail] == [(r.headings, r.text) for r in rows]


def test_tiny_filter_and_bad_documents(spark):
    def fragile(text):
        if "boom" in text:
            raise ValueError("boom")
        return len(text.split())

    texts = [("a", "w " * 14), ("b", "w " * 15), ("c", "boom " * 20), ("d", "")]
    docs = spark.createDataFrame(texts, "id string, text string").select("id", html.text_blocks(F.col("text")).alias("blocks"))
    assert [r.id for r in chunking.chunk_documents(docs, counter=fragile).collect()] == ["b"]
    null = spark.createDataFrame([("n", None)], f"id string, blocks {BLOCKS_DDL}")
    assert chunking.chunk_documents(null).count() == 0


def test_page_numbers_survive_packing(spark):
    block = "struct<ix:int,kind:string,level:int,headings:array<string>,page_no:int,text:string>"
    rows = [("d", [(0, "paragraph", 0, ["H"], 2, "a"), (1, "paragraph", 0, ["H"], 1, "b")])]
    docs = spark.createDataFrame(rows, f"id string, blocks array<{block}>")
    got = chunking.chunk_documents(docs, min_chunk_words=1).first()
    assert (got.text, got.page_nos, got.n_tokens) == ("a\nb", [2, 1], 2)


def test_native_and_python_token_counts_agree(spark):
    from lorekeep.functions import text as tx

    texts = ["a b, c!", "don't stop", "x_y-z 1.5", "é—ü", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.token_count(F.col("t")), tx.token_count(F.col("t"), "word"))
    assert [tuple(r) for r in df.collect()] == [(packing.symbol_tokens(t), packing.word_tokens(t)) for t in texts]


def test_numbering_matches_one_big_window(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(5)}", f"u{rng.randrange(40)}", i, list(range(rng.randrange(5)))) for i in range(300)]
    rows += [(None, "u", 9998, [0, 1]), (None, None, 9999, [0]), ("g1", "u", 9997, None)]
    df = spark.createDataFrame(rows, "g string, u string, d int, chunks array<int>").repartition(6)
    got = chunking.number_chunks(df, ["g"], "u", "d").collect()
    spot = lambda u: ("", "") if u is None else (hashlib.md5(u.encode()).hexdigest()[:4], u)
    want = []
    for g in {r[0] for r in rows}:
        held = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, spot(r[1]), r[2]))
        flat = [(g, r[1], r[2], c) for r in held for c in r[3] or []]
        want += [(*x, i + 1, len(flat)) for i, x in enumerate(flat)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_running_sums_of_a_group_over_many_ranges(spark):
    """One group holds all rows but few; ties and repeated rows each count once."""
    rng = random.Random(5)
    rows = [("hot", rng.randrange(50), rng.randrange(9)) for _ in range(2_000)] + [("a", 1, 7), ("b", 1, 0), ("b", 1, 3)]
    df = spark.createDataFrame(rows, "g string, o int, n int")
    got = running_sums(df, ["g"], ["o", "n"], "n", total="whole").collect()
    for g in ("hot", "a", "b"):
        held = sorted((r.o, r.n, r.before, r.whole) for r in got if r.g == g)
        sums = [sum(n for _, n, *_ in held[:i]) for i in range(len(held))]
        assert sorted(b for *_, b, _ in held) == sorted(sums) and {w for *_, w in held} == {sum(n for _, n, *_ in held)}
    assert running_sums(df.where("false"), ["g"], ["o"], "n").count() == 0


def test_no_window_over_texts(spark):
    df = spark.createDataFrame([("g", "u", 1, ["text"])], "g string, u string, d int, chunks array<string>")
    plan = chunking.number_chunks(df, ["g"], "u", "d")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
    for part in plan.split("Window [")[1:]:
        assert "chunk" not in part.split("\n")[0]


# ---- embedding


def test_embedding_batches_and_skips(spark):
    def build():
        def model(texts):
            assert len(texts) <= 3
            if any(t == "bad" for t in texts):
                raise RuntimeError("bad text")
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

        return model

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "bad", "dddd", None, "f"])], "i int, text string").coalesce(1)
    vector = rows.withColumn("v", embed.embed(F.col("text"), build, batch=3, on_error="skip")).orderBy("i").collect()
    assert [r.v for r in vector] == [[1.0, 1.0], [2.0, 1.0], None, [4.0, 1.0], None, [1.0, 1.0]]
    with pytest.raises(Exception, match="bad text"):
        rows.select(embed.embed(F.col("text"), build, batch=3)).collect()


def test_hashing_embedder_is_deterministic_and_unit_length():
    model = embed.hashing_embedder(32)()
    a, b, none = model(["Physio team", "team PHYSIO", "  "])
    assert np.allclose(a, b) and np.isclose(np.linalg.norm(a), 1.0) and not none.any()
