import numpy as np
from pyspark.sql import functions as F

from lorekeep.llm import quality

DATA = "/root/testdata/sf0.01"


def test_counts_by_hand():
    found = quality.counts(b"ab ab cd", quality._classes())
    assert found[: quality.ENDS[0]].sum() == 4 and found[quality.ENDS[0] : quality.ENDS[1]].sum() == 3
    assert found[quality.ENDS[1] :].tolist() == [1, 1]
    assert quality.counts(b"", quality._classes()).sum() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(9)
    for keys in (rng.normal(size=30_000), np.repeat([1.0, 2.0], 15_000), np.zeros(3)):
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(keys)], "id long, key double")
        for k in (1, len(keys) // 3, len(keys) - 1):
            assert quality.kth_largest(df, k) == np.sort(keys)[::-1][k - 1]
        assert quality.kth_largest(df, len(keys)) == -np.inf and quality.kth_largest(df, 0) == np.inf


def test_held_out_accuracy_and_exact_top_k(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    rows, _, least = quality.resample(docs, labels.where(~held))
    assert rows.count() == docs.count()
    scored = rows.join(labels.where(held), "doc_id").select("quality", "kept").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in scored]) > 0.95
    some, _, _ = quality.resample(docs, labels, k=100)
    keys = sorted((r.key for r in some.collect()), reverse=True)
    assert [r.key for r in some.where("kept").orderBy(F.desc("key")).collect()] == keys[:100]
    kept = quality.keep_good(docs.withColumn("key", F.lit("q")), labels.where(~held))
    assert kept.columns == [*docs.columns, "key"] and kept.count() == rows.where("kept").count()


def test_weights_by_hand(spark):
    """The log ratios rebuilt from plain counts of every text, and weights, keys and the kept rows from them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    rows, model, least = quality.resample(docs, labels)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    found = {i: quality.counts(t, quality._classes()) for i, t in texts.items()}

    def shares(ids):
        sums = sum(found[i] for i in ids) + 0.5
        return np.concatenate([np.log(part / part.sum()) for part in np.split(sums, quality.ENDS[:-1])])

    weights = shares([i for i in found if i in good]) - shares(found)
    np.testing.assert_allclose(model.weights, weights, atol=1e-9)
    got = {r.doc_id: r for r in rows.collect()}
    for i, n in found.items():
        parts = zip(np.split(n, quality.ENDS[:-1]), np.split(weights, quality.ENDS[:-1]))
        means = [a @ w / a.sum() if a.sum() else 0.0 for a, w in parts]
        assert abs(got[i].log_weight - (np.dot(means, model.slopes[:3]) + model.slopes[3])) < 1e-6
    k = sum(r.log_weight > 0 for r in got.values())
    first = sorted(got.values(), key=lambda r: -r.key)[:k]
    assert {r.doc_id for r in got.values() if r.kept} == {r.doc_id for r in first} and least == first[-1].key


def test_long_text(spark):
    long = "Some words of a very long text. " * 40_000
    docs = spark.createDataFrame([(1, long), (2, "Some words."), (3, "x")], "doc_id long, text string")
    rows, _, _ = quality.resample(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"), k=3)
    assert rows.where("kept").count() == 3


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "Some words."), (2, "Some words.")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    rows, _, _ = quality.resample(docs, labels, k=10)
    assert rows.where("kept").count() == 4
    assert quality.resample(docs.where("false"), labels)[0].count() == 0
