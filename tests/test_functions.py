"""Literal cases of the Column functions."""

from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions import ids, titles
from lorekeep.functions import text as tx
from lorekeep.functions import urls as ux
from lorekeep.operators import search



@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://x.test", True),
        ("https://x.test/", True),
        ("https://x.test/a/b", True),
        ("https://x.test/a/b/", True),
        ("https://x.test/a//b", True),
        ("https://x.test/a/b/;p", True),
        ("https://x.test/a/b;p/c", False),
        ("https://x.test/a/b/c", False),
        ("https://x.test/a/b/c/about-us", True),
        ("https://x.test/Contact", False),
        ("https://x.test/cartoons", False),
        ("https://x.test/p?q=1", False),
        ("https://x.test/p#t", False),
        ("https://about.x.test/a/b/c", True),
        ("https://x.test/books", True),
        ("https://x.test/book-club", False),
        ("https://x.test/ a/b c", True),
        ("a/b/c/d", False),
        ("mailto:a@x.test", True),
    ],
)
def test_should_crawl(one, url, expected):
    assert one([(url,)], "u string", ux.should_crawl(F.col("u"))) == [expected]


def test_normalize_and_canonical(one):
    cases = [
        ("https://www.x.test/a/", "https://www.x.test/a", "https://x.test/a"),
        ("https://x.test/a/#t", "https://x.test/a/", "https://x.test/a"),
        ("https://x.test/a/?p=1", "https://x.test/a/", "https://x.test/a"),
        ("https://x.test//", "https://x.test", "https://x.test"),
        ("http://www.x.test:8080/a", "http://www.x.test:8080/a", "http://x.test:8080/a"),
        ("HTTPS://X.test/a;p=1", "HTTPS://X.test/a;p=1", "https://X.test/a"),
    ]
    rows = [(c[0],) for c in cases]
    assert one(rows, "u string", ux.normalize(F.col("u"))) == [c[1] for c in cases]
    assert one(rows, "u string", ux.canonical(F.col("u"))) == [c[2] for c in cases]


HREFS = [
    "c", "../c", "//y.test/z", "/team/", "?p=2", "#top", "", "/", "//y.test", "https://y.test", "https://y.test/a#", "https://y.test/a?#x",
    "/a/../b", "/./a", "/a;b", "mailto:a@x.test", "HTTPS://Y.test/A", "/a b", " /a", "/a?", "/a//b", "///a", "javascript:void(0)", "/a.b/c", "/.well",
    "http://[bad", "https:/a", "tel:1", "./d", "..", "a/./b/", "//y.test?x=1", "/a?x=/../y", "/a#/./b", "https://y.test/..",
]
BASES = ["https://x.test/a/b", "https://x.test/a/b/", "https://x.test", "https://x.test/a?q#f", "http://x.test:80/a;p/b", " https://x.test/a", "ftp://x.test/a"]


def test_resolve_is_urljoin(one):
    pairs = [(base, href) for base in BASES for href in HREFS]

    def want(base, href):
        try:
            return urljoin(base, href)
        except ValueError:
            return None

    got = one(pairs, "b string, h string", ux.resolve(F.col("b"), F.col("h")))
    wrong = [(p, g, want(*p)) for p, g in zip(pairs, got) if g != want(*p)]
    assert wrong == []


def test_resolve_plain_links_skip_python(one):
    plain = ["/team/", "//y.test/z", "https://y.test/a?b=c#d", "/", "/a?x=1"]
    odd = ["c", "../c", "/a/../b", "/./a", "/a;b", "/a?", "/a b"]
    assert one([(h,) for h in plain], "h string", F.col("h").rlike(ux._PLAIN_LINK)) == [True] * len(plain)
    assert one([(h,) for h in odd], "h string", F.col("h").rlike(ux._PLAIN_LINK)) == [False] * len(odd)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab/.?#;: @-%é", max_size=12), min_size=20, max_size=20))
def test_resolve_random(spark, hrefs):
    rows = spark.createDataFrame([(i, "https://x.test/a/b", h) for i, h in enumerate(hrefs)], "i int, b string, h string")
    got = rows.select("i", ux.resolve(F.col("b"), F.col("h")).alias("v")).collect()
    for i, value in got:
        try:
            assert value == urljoin("https://x.test/a/b", hrefs[i])
        except ValueError:
            assert value is None


def test_same_site(one):
    rows = [
        ("https://www.x.test/a", "http://x.test", True),
        ("https://x.test:8080/a", "https://x.test", False),
        ("https://X.test", "https://x.test", False),
        ("mailto:a@x.test", "https://x.test", False),
    ]
    assert one([r[:2] for r in rows], "a string, b string", ux.same_site(F.col("a"), F.col("b"))) == [r[2] for r in rows]


def test_source_type_and_route(one):
    rows = ["http://a/x.PDF", "https://a/x", "C:/a.docx", "https://a/x.doc", "notes.md", "HTTP://a/x", "a.pdf"]
    want = ["pdf", "website", "document", "website", "text", "website", "pdf"]
    assert one([(r,) for r in rows], "u string", ux.source_type(F.col("u"))) == want
    assert one([(r,) for r in rows], "u string", ux.is_http(F.col("u"))) == [True, True, False, True, False, False, False]


def test_word_count_is_str_split(one):
    texts = ["", " ", "a", " a  b\n\nc ", "a\u00a0b\u2003c\u3000d", "a\x1cb\x1dc\x1ed\x1fe", "a\u200bb", "x\u0085y\u2028z", "\u180e", "é ü", "😀 b"]
    assert one([(t,) for t in texts], "u string", tx.word_count(F.col("u"))) == [len(t.split()) for t in texts]
    assert one([(t,) for t in texts], "u string", tx.words(F.col("u"))) == [t.split() for t in texts]
    assert one([(t,) for t in texts], "u string", tx.strip(F.col("u"))) == [t.strip() for t in texts]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=15, max_size=15))
def test_word_count_random(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.word_count(F.col("t")), tx.char_count(F.col("t")))
    for i, words, chars in rows.collect():
        assert (words, chars) == (len(texts[i].split()), len(texts[i]))


def test_titles(one):
    rows = [
        (["Home", "Services", "Physio"], "f.html", "x"),
        (["Home"], "f.html", "x"),
        ([], "f.html", "x"),
        (None, None, " First line \nrest"),
        (None, None, "\nrest"),
        (["a" * 300], None, "x"),
        (None, "", "y" * 60),
    ]
    schema = "h array<string>, f string, t string"
    hier = one(rows, schema, titles.title_hierarchical(F.col("h"), F.col("f"), F.col("t")))
    assert hier == ["Services > Physio", "Home", "f.html", "First line", "Untitled Document", "a" * 255, "y" * 50]
    simple = one(rows, schema, titles.title_simple(F.col("h"), F.col("f")))
    assert simple == ["Home", "Home", "f.html", "Untitled Document", "Untitled Document", "a" * 255, "Untitled Document"]


def test_page_numbers(one):
    rows = [([3, 1, None, 3],), ([None],), ([],), (None,)]
    assert one(rows, "p array<int>", titles.page_numbers(F.col("p"))) == [[1, 3], [], None, None]


def test_metadata_round_trip(one):
    meta = titles.metadata_json(F.lit("u"), F.lit(None).cast("string"), F.array(F.lit(2), F.lit(1)), F.array(F.lit("T")), F.lit(1), F.lit(9), source_id=F.lit("s"))
    text = one([(1,)], "x int", meta)[0]
    assert text == '{"source_url":"u","filename":"unknown","page_numbers":[1,2],"original_title":"T","chunk_index":1,"total_chunks":9,"source_id":"s"}'
    assert one([(text,)], "m string", titles.metadata_read(F.col("m"))["page_numbers"]) == [[1, 2]]
    assert one([(None,)], "m string", titles.metadata_read(F.col("m"))["source_url"]) == [None]
    assert one([(text,), ("no json",), (None,)], "m string", titles.metadata_value(F.col("m"), "total_chunks", "int")) == [9, None, None]


def test_uuid(one):
    plain = "12345678-1234-5678-1234-567812345678"
    good = [plain, plain.replace("-", ""), "{" + plain + "}", "urn:uuid:" + plain, plain.upper()]
    bad = ["test_business", "", None, plain[:-1], plain + "0", "g" * 32]
    rows = [(v,) for v in good + bad]
    assert one(rows, "u string", ids.uuid_valid(F.col("u"))) == [True] * len(good) + [False] * len(bad)
    want = ["12345678-1234-5678-1234-567812345678"] * len(good) + [None] * len(bad)
    assert one(rows, "u string", ids.uuid_canonical(F.col("u"))) == want


def test_stable_id_is_unambiguous(one):
    rows = [("a", "bc"), ("ab", "c"), ("a", "bc")]
    got = one(rows, "a string, b string", ids.stable_id(F.col("a"), F.col("b")))
    assert got[0] == got[2] != got[1]


def test_iso_timestamp_is_utc_whatever_the_session(spark, one):
    rows = [(1_700_000_000_000_000,), (1_700_000_000_120_000,), (None,)]
    column = tx.iso_timestamp(F.timestamp_micros("m"))
    want = ["2023-11-14T22:13:20+00:00", "2023-11-14T22:13:20.120000+00:00", None]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert one(rows, "m long", column) == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rounding(one):
    assert one([(47.25,), (47.35,), (2.0,)], "x double", tx.round_half_even(F.col("x"))) == [47.2, 47.4, 2.0]
    assert one([(1, 4), (1, 0)], "a int, b int", tx.percentage(F.col("a"), F.col("b"))) == [25.0, 0.0]


def test_decode_drops_bad_bytes(one):
    raw = bytearray(b"\xffa\xc3\xa9\xc3 b\xf0\x9f")
    assert one([(raw,)], "b binary", tx.decode_utf8(F.col("b"))) == [bytes(raw).decode("utf-8", errors="ignore")]


def test_keywords(one):
    assert one([("The cat, the CAT; ein Übermaß 42!",)], "t string", search.keywords(F.col("t"))) == [["the", "cat", "ein", "übermaß", "42"]]
