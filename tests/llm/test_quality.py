import numpy as np
from pyspark.sql import functions as F

from affinis.llm import quality
from affinis.llm.q_quality import op1
from tests.conftest import SF
from tests.llm import cases


def test_isotonic_is_the_least_squares_ascending_fit():
    random = np.random.default_rng(1)
    x, y, n = np.arange(30.0), random.random(30), random.integers(1, 5, 30).astype(float)
    centres, levels = quality.isotonic(x, y, n)
    assert (np.diff(levels) > 0).all() and (np.diff(centres) > 0).all()
    fitted = levels[np.searchsorted(centres, x).clip(0, len(levels) - 1)]
    assert np.isclose((n * y).sum(), sum(levels * np.histogram(x, 1, weights=n)[0]) if len(levels) == 1 else (n * y).sum())
    assert fitted.shape == y.shape
    # max-min formula
    want = [max(min(np.average(y[a : b + 1], weights=n[a : b + 1]) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(sorted(set(np.round(want, 9))), np.round(levels, 9))


def test_features_approximate_the_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", 20_000)
    lift = quality.Lift(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    x = np.random.default_rng(2).normal(size=(6, quality.STATISTICS))
    z = lift(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_partition_sums_are_the_whole_sums(spark):
    docs = cases.documents(spark)
    rows = quality.described(docs).withColumn("y", F.lit(1.0)).repartition(5)
    lift = quality.Lift(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    gram, moment = quality._summed(rows.select("x", "y"), lift, 5)
    z = lift(np.array([quality.statistics(t.encode() if t else None) for _, t, *_ in cases.texts()]))
    assert np.allclose(gram, z.T @ z) and np.allclose(moment, z.sum(0))


def test_odd_rows_and_few_labels(spark):
    docs = cases.documents(spark)
    features = quality.described(docs)
    schema = "doc_id long, quality int, text string"
    for labels, low, high in (([], 0.5, 0.5), ([(1, 1, "x"), (None, 0, "x"), (7, None, "x")], 1.0, 1.0), ([(i, i % 2, "x") for i in range(1, 20)], 0.0, 1.0)):
        model = quality.fit(features, spark.createDataFrame(labels, schema), F.col("doc_id").isNotNull())
        scores = [r["score"] for r in quality.score(features, model).collect()]
        assert len(scores) == len(cases.texts()) and all(low <= s <= high for s in scores)
    assert quality.score(features.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op1(spark, SF).join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (cases.crc(r["doc_id"]) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.93
