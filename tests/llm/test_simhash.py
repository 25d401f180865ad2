import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorekeep.llm import simhash
from lorekeep.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", ["", "  \n", "one", "One TWO", "a b c", "É è Ü b c d e É", "x " * 500, "a\x0bb\x1cc d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_every_near_pair_meets_at_an_anchor():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << bit
        rows, keys, homes = simhash.anchors(np.array([x, y], np.uint64))
        assert np.bincount(rows).max() <= 34
        home = {(k, r) for r, k, h in zip(rows, keys, homes, strict=True) if h}
        assert any((k, 1 - r) in home for r, k in zip(rows, keys, strict=True))


@pytest.mark.parametrize("homes", [2, 4096])
def test_links_keep_components(spark, homes):
    rng = random.Random(2)
    fps = []
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.append(x)
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << bit
    low = rng.getrandbits(32)
    fps += [low | rng.getrandbits(32) << 32 for _ in range(60)]  # one crowded anchor
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), homes)
    root = {r.node: r.root for r in components(edges).collect()}
    got = defaultdict(set)
    for i, x in enumerate(signed):
        got[root.get(x, x)].add(i)
    want = defaultdict(set)
    for i, c in enumerate(plain_components(list(range(len(fps))), fps)):
        want[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "one", "One", "two words"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([5, 80, 400]))]
        texts += [" ".join(base)] * rng.randint(1, 3)
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    rows = [(i if i != 7 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want = plain_components([r[0] for r in rows], fps := [plain_fingerprint(t) for t in texts])
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(str, got)) == sorted(
        str(g) for g in spark.createDataFrame([(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True)], "doc_id long, fingerprint string, component_id long").collect()
    )
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    twice = simhash.near_duplicates(docs.unionByName(docs))
    assert twice.count() == 2 * len(rows)


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r.root for r in components(chain).collect()} == {0}
