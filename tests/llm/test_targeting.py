import hashlib
import math
import random
import re
import zlib
from collections import Counter

from lorekeep.llm import targeting

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, target, percent, least, longest, buckets, seed):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        grams = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    held = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for text in target for b in features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, n_words, f in held:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        u = (int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        out.append([i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[5] = rank
    return Counter((r[0], *r[2:]) for r in out)


def some(rng, n):
    words = ["Alpha", "beta", "ÉTÉ", "x1", "naïve", "中文", "gamma"]
    rows = [(None, None, "c"), (None, "", "c"), (1, " \n-", "c"), (2, "Word " * 300_000, "c")]
    for i in range(3, n):
        rows.append((i, rng.choice([" ", ", ", " ", "\x85"]).join(rng.choice(words) for _ in range(rng.randint(0, 12))), "c"))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(13)
    target = [("beta gamma", 1), (None, 2), ("x1 x1 beta", 3)]
    aim = spark.createDataFrame(target, "text string, rank int")
    for longest, buckets, percent in ((1, 10_000, 10), (3, 50, 40)):
        rows = some(rng, 300)
        docs = spark.createDataFrame(rows, "doc_id long, text string, weight string").repartition(7)
        got = targeting.resample(docs, aim, percent, 5, longest, buckets, 9)
        assert Counter(tuple(r) for r in got.collect()) == plain([r[:2] for r in rows], [t for t, _ in target], percent, 5, longest, buckets, 9)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_ranks_of_ties_and_repeated_rows(spark):
    rng = random.Random(14)
    rows = [(rng.choice([None, *range(40)]), rng.randint(0, 3)) for _ in range(2_000)] + [(5, 2)] * 1_000
    frame = spark.createDataFrame(rows, "id long, score long")
    want = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or 0))
    for parts in (1, 7):
        got = sorted(targeting.ranked(frame, "id", "score", parts).collect(), key=lambda r: r["rank"])
        assert [(r.id, r.score) for r in got] == want and [r["rank"] for r in got] == list(range(1, len(rows) + 1))
    names = spark.createDataFrame([("b", 1), ("ä", 1), (None, 1), ("B", 2)], "id string, score long")
    assert [r.id for r in targeting.ranked(names, "id", "score", 3).orderBy("rank").collect()] == ["B", None, "b", "ä"]


def test_segments_are_even_whatever_ties(spark, monkeypatch):
    sizes = {}
    cut = targeting.cut_lineage

    def kept(frame):
        out = cut(frame)
        if "_segment" in out.columns:
            sizes.update({r[0]: r[1] for r in out.groupBy("_segment").count().collect()})
        return out

    monkeypatch.setattr(targeting, "cut_lineage", kept)
    frame = spark.range(8_000).selectExpr("id % 3 as id", "cast(1 as long) as score")
    assert targeting.ranked(frame, "id", "score", 8).count() == 8_000
    assert len(sizes) == 8 and max(sizes.values()) <= 2 * 8_000 / 8


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = docs.where("false")
    assert targeting.resample(none, docs).count() == 0
    assert targeting.resample(docs, none, 100, 1).first().asDict()["rank"] == 1
    assert targeting.ranked(spark.createDataFrame([], "id long, score long"), "id", "score").count() == 0
