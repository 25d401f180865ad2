import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import runindex


def plain(rows, length):
    """(id, bytes, removed bytes, spans, digest of the rest) of each row, by a table of all strings of ``length`` bytes."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = Counter()
    for i, data in texts:
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            if seen[data[at : at + length]] > 1:
                gone[at : at + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).size // 2
        rest = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[i, len(data), int(gone.sum()), edges, hashlib.sha256(rest).hexdigest()] += 1
    return out


def texts(rng, n):
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 150))) for _ in range(5)] + ["a" * 300, "ab" * 100]
    rows = [(0, None), (1, ""), (2, "é")]
    for i in range(3, n):
        parts = [rng.choice(base)[rng.randint(0, 60) :][: rng.randint(0, 140)] + "".join(rng.choice("xyz€") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 4))]
        rows.append((i, "".join(parts)))
    return rows + rows[5:9] + [(None, rows[7][1]), (8, "another text of that id " * 3)]


@pytest.mark.parametrize("length, gram, index_bytes, block", [(12, 4, 1 << 20, 1 << 20), (30, 16, 1 << 20, 64), (30, 2, 60, 1 << 20), (5, 128, 50, 64)])
def test_against_brute_force(spark, monkeypatch, length, gram, index_bytes, block):
    monkeypatch.setattr(runindex, "BLOCK", block)
    rows = texts(random.Random(length * gram), 50)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, removed string").repartition(4)
    got = runindex.long_matches(docs, length, gram=gram, index_bytes=index_bytes)
    assert Counter(tuple(r)[:5] for r in got.collect()) == plain(rows, length)


def test_one_passage_in_many_texts_is_split(spark):
    """More pieces of one anchor than an index takes, all unlike: the passage goes, what stands around it stays."""
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(450))
    around = lambda: "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, around() + passage + around()) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in runindex.long_matches(docs, index_bytes=4_000).collect()}
    assert Counter(tuple(got[i])[:5] for i, _ in rows) == plain(rows, 400)
    assert all(r.n_removed >= 450 and r.n_spans == 1 for r in got.values())


def test_very_long_and_uniform_texts(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, "z" * 200_000), (2, long + "!" + long[1000:1500]), (3, "z" * 400), (4, "z" * 399), (5, long[5000:5399])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in runindex.long_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (200_000, 200_000, 1), 2: (300_501, 1_000, 2), 3: (400, 400, 1), 4: (399, 0, 0), 5: (399, 0, 0)}


def test_empty_tables_and_the_rest(spark):
    docs = spark.createDataFrame([(1, "x" * 401 + "é"), (2, None)], "doc_id long, text string")
    none = docs.where("false")
    assert runindex.long_matches(none).count() == 0
    found = runindex.long_matches(docs, 10)
    kept = {r.doc_id: bytes(r.kept) for r in runindex.without_removed(docs, found).collect()}
    assert kept == {1: "é".encode(), 2: b""}


def plain_statistics(symbols):
    """The longest string from each position on that another position has."""
    text = symbols.tolist()
    out = []
    for i in range(len(text)):
        best = 0
        for j in range(len(text)):
            n = 0
            while i != j and max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


def test_run_index_on_repetitive_text():
    rng = random.Random(4)
    for _ in range(60):
        unit = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))]
        symbols = unit * rng.randint(1, 6) + [0] + unit[: rng.randint(0, 9)] + [rng.randint(1, 256) for _ in range(rng.randint(0, 9))]
        symbols = np.array([*symbols, 257], np.int64)
        index = runindex.RunIndex.of(symbols)
        order = sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        assert runindex.suffix_array(runindex.pack(symbols)).tolist() == order
        assert np.repeat(index.symbols, index.sizes).tolist() == [int(symbols[i - 1]) for i in order]
        assert (index.symbols[1:] != index.symbols[:-1]).all()
        assert index.statistics().tolist() == plain_statistics(symbols)
    long = np.array(([1, 2, 3, 5, 4] * 2_000) + [257], np.int64)
    assert len(runindex.RunIndex.of(long).sizes) < 20


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 4, 90, np.uint8)
    found = set()
    for before in (0, 3, 57):
        data = np.concatenate([rng.integers(0, 4, before, np.uint8), shared, rng.integers(0, 4, 20, np.uint8)])
        first, last, anchor, hashed = runindex.Anchors(40, 8).pieces(data, np.array([0, len(data)]))
        starts = {int(s): (int(a) - before, int(h)) for f, e, a, h in zip(first, last, anchor, hashed, strict=True) for s in range(f, e + 1)}
        assert sorted(starts) == list(range(len(data) - 39))
        found.add(tuple(starts[before + i] for i in range(51)))
    assert len(found) == 1
