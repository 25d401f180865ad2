import hashlib
import random

import pytest

from lorekeep.llm import prefix


def test_spans_and_extensions():
    rng, powers = random.Random(10), prefix.Powers()
    for _ in range(40):
        a, b = ("".join(rng.choice("ab🙂") for _ in range(rng.randint(1, 60))) for _ in range(2))
        p, q = prefix.Prefix(prefix.code_points(a), powers), prefix.Prefix(prefix.code_points(b), powers)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        assert p.common(i, q, j) == n
        assert (p.span(i, len(a)) == q.span(j, len(b))) == (a[i:] == b[j:])


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        take = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - take] + after[:take]).encode()).hexdigest(), after))
    return out


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_documents(spark, parts):
    rng = random.Random(11)
    rows = [(3, None), (9, ""), (9, "é"), (None, "zz"), (None, None)]
    rows += [(i * 7, "".join(rng.choice("abc é🙂") for _ in range(rng.choice([0, 1, 23, 24, 500])))) for i in range(20, 60)]
    rows += [rows[-1], (1000, rows[-1][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    got = prefix.fingerprints(docs, parts=parts).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted((x[:3] for x in plain(rows)), key=key)
    by_text = {}
    for r in got:
        by_text.setdefault(r.fingerprint, set()).add(r.n_chars)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.n_chars == 500:
            assert 0.3 < r.near_edited < 0.7 and r.shared_edited >= 250
    assert len(by_text) == len({t or "" for _, t in rows})
    assert prefix.fingerprints(docs.where("false"), parts=parts).count() == 0
    assert [r.near_next for r in prefix.fingerprints(docs.where("doc_id = 1000"), parts=parts).collect()] == [1.0]


def test_halves_show_at_every_length(spark):
    rng = random.Random(12)
    rows = [(n, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))) for n in range(2, 101)]
    rows.append((101, "x" * 200))
    got = [r for r in prefix.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), parts=3).collect() if r.doc_id < 101]
    assert len(got) == 99 and all(r.near_edited > r.near_next for r in got)
