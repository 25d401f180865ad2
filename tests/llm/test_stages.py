"""The stages of the corpus pipeline and the pipeline itself, against brute force."""

import random

import corpus_pipeline
from test_bpe import PLAIN
from test_decontaminate import plain as plain_hits
from test_simhash import plain_components, plain_fingerprint
from test_substring import plain as plain_cut

from lorekeep.llm import quality, simhash, stages, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def plain_first(rows):
    """Of each component one row: of the smallest id, null ids last."""
    groups = {}
    for row, group in zip(rows, plain_components(list(range(len(rows))), [plain_fingerprint(r[1]) for r in rows]), strict=True):
        groups.setdefault(group, []).append(row)
    return [{r for r in rows if r[0] == min((x[0] for x in rows if x[0] is not None), default=None)} for rows in groups.values()]


def is_one_of_each(got, groups):
    return len(got) == len(groups) and all(sum(row in group for row in got) == 1 for group in groups)


def made(rng, n):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in words)


def corpus(rng):
    texts = [made(rng, rng.randint(60, 120)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, made(rng, 80)), (3, made(rng, 80)), (3, texts[4]), (None, made(rng, 80)), (None, made(rng, 80)), (None, texts[5]), (30, texts[6]), (31, None), (32, "")]
    return [(i, t, "en", "x", len(t or "")) for i, t in rows]


def test_keep_first_with_repeated_and_null_ids(spark):
    rng = random.Random(1)
    rows = corpus(rng)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in simhash.keep_first(docs).collect()]
    assert is_one_of_each(got, plain_first(rows))
    alike = docs.unionByName(docs)
    assert sorted(tuple(r) for r in simhash.keep_first(alike).fillna(-1).collect()) == sorted(tuple(r) for r in simhash.keep_first(docs).fillna(-1).collect())
    assert simhash.keep_first(docs.where("false")).count() == 0


def test_without_repeats(spark):
    rng = random.Random(2)
    shared = made(rng, 80)
    rows = [(i, made(rng, 20) + " " + shared + " " + made(rng, 20), "en", "x", 7) for i in range(4)] + [(9, made(rng, 50), "en", "x", 7), (10, None, "en", "x", None)]
    got = {r.doc_id: r for r in stages.without_repeats(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    want = plain_cut([r[:3] for r in rows], substring.MIN_WORDS)
    assert [got[r[0]].text for r in rows] == want
    assert [got[r[0]].n_chars for r in rows] == [r[4] if t == r[1] else len(t) for r, t in zip(rows, want, strict=True)]
    assert want[1] != rows[1][1]


def test_the_pipeline(spark, tmp_path):
    rng = random.Random(3)
    rows = corpus(rng)
    shared, leak = made(rng, 80), made(rng, 12)
    for i in range(3):
        rows.append((40 + i, made(rng, 30) + " " + shared, "en", "x", 1))
    rows.append((50, made(rng, 30) + " " + leak + " " + made(rng, 30), "en", "x", 1))
    labels = [(r[0], 1 if r[0] % 7 else 0, 0) for r in rows[:25]]
    items = [(1, leak), (2, made(rng, 20))]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, known = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    marks = quality.resample(docs, known)[0].where("kept").collect()
    good = [tuple(r) for r in stages.keep_good(spark, docs, str(tmp_path)).collect()]
    assert sorted(str(r.doc_id) for r in marks) == sorted(str(r[0]) for r in good) and len(good) > 10
    one = [tuple(r) for r in stages.one_of_each(spark, spark.createDataFrame(good, SCHEMA), str(tmp_path)).collect()]
    assert is_one_of_each(one, plain_first(good))
    cut = list(zip([r[0] for r in one], plain_cut([r[:3] for r in one], substring.MIN_WORDS), strict=True))
    clean = [(i, t) for i, t in cut if not plain_hits(t, items)[4]]
    assert 50 not in [i for i, _ in clean] or 50 not in [r[0] for r in good]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(PLAIN.encode_ordinary(t or ""))) for i, t in clean)
