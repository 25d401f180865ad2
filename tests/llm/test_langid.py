import re

import numpy as np

from lorekeep.llm import langid

DATA = "/root/testdata/sf0.01"


def test_pages_and_held_out_documents(spark):
    docs, pages = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "pages"))
    rows = langid.identify(pages, docs).collect()
    assert len(rows) == pages.count()
    assert np.mean([r.lang == r.declared for r in rows]) > 0.9
    held = docs.where("doc_id % 2 = 0").selectExpr("doc_id page_id", "concat('http://', source, '.test/') url", "concat('<html lang=xx>', text) html")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(held, docs.where("doc_id % 2 = 1")).collect()
    assert np.mean([truth[r.page_id] == r.lang for r in got]) > 0.95


def test_fused_numbers_by_hand(spark):
    """Posteriors rebuilt page by page in plain Python from text log shares, declarations, suffixes and hosts."""
    folder = "/root/testdata/sf0.001"
    docs, pages = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "pages"))
    langs, shares = langid.fit(docs)
    held = []
    for r in pages.collect():
        html = r.html or ""
        found = langid.trigrams(langid.visible(html))
        text = shares[:, found].sum(axis=1) * min(1.0, langid.EVIDENCE / max(1, len(found)))
        host = re.match(r"(?:[A-Za-z][\w+.-]*:)?//([^/?#:]*)", r.url or "")
        said = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", html)
        host = host.group(1).lower() if host else ""
        held.append((r.page_id, host, host.split(".")[-1], said.group(1).lower() if said else "", np.exp(text - np.logaddexp.reduce(text))))
    sums = [{}, {}, {}]
    for _, *keys, own in held:
        for table, key in zip(sums, keys, strict=True):
            table[key] = table.get(key, 0) + own
    total = sum(own for *_, own in held)
    share = (total + 1) / (total.sum() + len(langs))
    got = {r.page_id: r for r in langid.identify(pages, docs).collect()}
    assert len(got) == len(held)
    for page_id, *keys, own in held:
        at_host, at_suffix, declared = (np.maximum(table[key] - own, 0) for table, key in zip(sums, keys, strict=True))
        near = (at_suffix + share * langid.SUFFIX_TRUST) / (at_suffix.sum() + langid.SUFFIX_TRUST)
        near = (at_host + near * langid.HOST_TRUST) / (at_host.sum() + langid.HOST_TRUST)
        often = (declared.sum() + 1) / (total.sum() + 1)
        joint = own * near * (declared + often * langid.DECLARED_TRUST) / (total + langid.DECLARED_TRUST)
        assert abs(got[page_id].probability - joint.max() / joint.sum()) < 1e-6
        assert got[page_id].lang == langs[int(joint.argmax())] and got[page_id].text_lang == langs[int(own.argmax())]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the the the", "en"), (2, "der die das und", "de"), (None, "x", "fr"), (3, None, "de"), (4, "y", None)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, None, None, 1), (None, "http://a.de/", "", 1), (2, "bad url", "der das und", 1), (2, "bad url", "der das und", 1)], "page_id long, url string, html string, host int")
    rows = langid.identify(pages, docs).collect()
    assert len(rows) == 4 and all(0 < r.probability <= 1 for r in rows)
    assert {r.lang for r in rows if r.page_id == 2} == {"de"}
    assert langid.identify(pages.where("false"), docs).count() == 0
    assert [r.lang for r in langid.identify(pages, docs.where("false")).collect()] == [None] * 4
