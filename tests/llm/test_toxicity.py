import zlib

import numpy as np
import pytest

from lorekeep.llm import toxicity

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.classify(docs, labels)
    assert rows.count() == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in rows.collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    hit = np.array([(r.predicted, truth[r.doc_id]) for r in got])
    recall, wrong = hit[hit[:, 1] == 1, 0].mean(), hit[hit[:, 1] == 0, 0].mean()
    print("recall", recall, "false alarms", wrong)
    assert recall > 0.8 and wrong < 0.05


def test_risk_stays_non_negative():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    has = np.where(truth, rng.random(4000) < 0.9, rng.random(4000) < 0.02)
    positive = np.concatenate([np.ones(300, bool), np.zeros(4000, bool)])
    x = np.concatenate([rng.random(300) < 0.9, has])
    w, b = toxicity.nnpu(np.flatnonzero(x), np.zeros(x.sum(), int), positive, 1, 0.2)
    p = 1 / (1 + np.exp(-(w[0] * np.array([0, 1]) + b)))
    assert p[1] > 0.7 and p[0] < 0.2


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0)], [(None, 1), (1, None)], [(1, 1), (2, 0), (3, 1)]])
def test_odd_rows(spark, labels):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x"), (2, "x"), (3, "bad " * 9)], "doc_id long, text string")
    rows = toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert rows.count() == 5 and all(0 <= r.score <= 1 for r in rows.collect())
    assert toxicity.classify(docs.where("false"), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_small_tables_have_features_too(spark, size):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{size}/{n}.parquet") for n in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.classify(docs, labels).collect() if r.held_out and r.doc_id in truth]
    hit = np.array([(r.predicted, truth[r.doc_id]) for r in got])
    assert len({r.score for r in got}) > 1
    assert hit[hit[:, 1] == 1, 0].mean() >= 0.4 and hit[hit[:, 1] == 0, 0].mean() < 0.05


def test_chosen_features_against_brute_force(spark):
    rows = [(i, f"fine w{i} {'vile words' if i % 4 == 0 else 'good day'}", i % 4 == 0) for i in range(80)] + [(99, None, False)]
    chosen, n_p, n_u = toxicity._chosen(spark.createDataFrame(rows, "id long, text string, positive boolean").repartition(3), 4096)
    known, p, u = toxicity._Words(None), {}, {}
    for _, text, positive in rows:
        for f in toxicity.features(text or "", known):
            side = p if positive else u
            side[f] = side.get(f, 0) + 1
    assert (n_p, n_u) == (20, 61)
    want = set()
    for f in p:
        a, b = p[f], u.get(f, 0)
        lift = ((a + 0.5) / n_p) / ((b + 0.5) / n_u)
        g = 2 * sum(x * np.log(x / ((a + b) * n / (n_p + n_u))) for x, n in ((a, n_p), (b, n_u)) if x)
        if lift >= toxicity.LIFT and g >= toxicity.EVIDENCE:
            want.add(f)
    assert set(chosen) == want and zlib.crc32(b"=vile") % toxicity.BUCKETS in want


def test_blocks_of_unlabelled_rows(spark):
    docs = spark.createDataFrame([(i % 200 if i < 300 else 7, "vile words" if i % 5 == 0 else f"good day {i}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 100)], "doc_id long, toxic int")
    one, many = (toxicity.fit(docs, labels, sample=n) for n in (20_000, 60))
    assert set(one.weights) == set(many.weights) and one.weights
    assert all(many.weights[f] > 0 for f in many.weights)
