import hashlib
import random

from pyspark.sql import functions as F

from lorekeep.llm import warc
from lorekeep.session import scratch_path


def test_url_key(one):
    rows = [("http://WWW.Example.org:80/a?b#c",), ("https://x.test",), ("no host",), (None,)]
    assert one(rows, "u string", warc.url_key(F.col("u"))) == ["org,example,www):80/a?b#c", "test,x)", ")no host", ""]


def test_round_trip(spark):
    rng = random.Random(12)
    bodies = ["x" * 999, "y" * 1000, "é" * 500, "<p>a</p>\r\n\r\nb" * 200, "", None]
    rows = [(i, f"http://h{i % 3}.test/{rng.random()} \n", rng.choice(bodies)) for i in range(300)]
    rows += [(None, "http://a.test/", "z" * 2000), (500, None, "z" * 2000), (501, "", "z" * 2000), rows[0], rows[1]]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    owners = {}
    for i, _, h in rows:
        owners.setdefault(h, []).append(i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        best = max((x for x in owners[h] if x is not None), default=None)
        other = best if len(data) >= 1000 and i != best else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if other is None else "revisit", other))
    assert sorted((tuple(r) for r in warc.archive(pages, 7).collect()), key=str) == sorted(want, key=str)
    assert warc.archive(pages.where("false"), 7).count() == 0


def test_blocks_and_search(spark):
    archives, index = scratch_path(spark, "w"), scratch_path(spark, "c")
    for f in (archives, index):
        files, root = warc._place(f)
        files.create_dir(root)
    pages = spark.createDataFrame([(i, f"http://h{i % 5}.test/{i % 40}", f"page {i}") for i in range(400)], "page_id long, url string, html string")
    shards = warc.write_index(warc.write_archives(pages, archives), index, 3, lines=7)
    some = pages.where("page_id % 9 = 0").select(warc.url_key(F.col("url")).alias("url_key"), "page_id")
    missing = spark.createDataFrame([("aa)", 1), ("zz)", 1), ("test,h1)/1", 77)], "url_key string, page_id long")
    got = warc.read_back(some.unionByName(missing), shards, archives, index, 2).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(i, f"page {i}".encode()) for i in range(0, 400, 9)]


def test_a_payload_of_half_the_pages(spark):
    rows = [(i, f"http://h{i % 7}.org/{i}", "e" * 1500 if i % 2 else f"page {i}") for i in range(400)]
    got = {r.page_id: r for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 400
    assert all(got[i].refers_to == (399 if i % 2 and i != 399 else None) for i in got)
    assert all(got[i].payload_bytes == (1500 if i % 2 else len(f"page {i}")) for i in got)
