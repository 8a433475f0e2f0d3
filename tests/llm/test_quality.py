"""The classifier by held-out accuracy, and its parts on small inputs."""

import numpy as np
import pytest

from brindle.llm import quality

from .conftest import AWKWARD, sf


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in quality.op2_random_indexing_quality(spark, sf("sf0.01")).collect()}
    labels = spark.read.parquet(f"{sf('sf0.01')}/labels.parquet").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [(rows[r.doc_id], r.quality) for r in labels if rows[r.doc_id].held_out]
    assert sum(r.predicted == q for r, q in held) / len(held) > 0.94
    good, bad = [r.score for r, q in held if q], [r.score for r, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_labels_of_held_out_documents_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"word{i} good text" if i % 3 else "BAD!! BAD!!") for i in range(80)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(text not like 'BAD%') quality")
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    x = np.random.default_rng(0).normal(size=(5, 2 * quality.DIM + 2))
    assert np.allclose(a[1].predict(x), b[1].predict(x))


def test_context_sums_by_hand(spark):
    got = {r.bucket: np.array(r.v) for r in quality.context_sums(spark.createDataFrame([("one two one",), (None,), ("",)], "text string")).collect()}
    index = quality.index_vectors().astype(int)
    (w1, s), (w2, _) = quality.Items.of("one"), quality.Items.of("two")
    assert np.array_equal(got[w1], 2 * index[w2] + 2 * index[s])
    assert np.array_equal(got[s], 4 * index[s])


def test_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 1), (None, 1), (5, None), (4, 0)], "doc_id long, quality int")
    model = quality.fit(awkward, labels)
    rows = quality.score(awkward, model).collect()
    assert len(rows) == len(AWKWARD) + 2 and {r.score for r in rows} == {1.0}
    none = quality.fit(empty, labels.limit(0))
    assert quality.score(empty, none).count() == 0
    assert {r.score for r in quality.score(awkward, none).collect()} == {0.5}


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    p = 1 / (1 + np.exp(-x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    got = quality.Network(epochs=30).fit(x, y).predict(x)
    assert np.mean(np.abs(got - p)) < 0.1
    for low, high in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.0)):
        inside = (got >= low) & (got < high)
        assert got[inside].mean() == pytest.approx(y[inside].mean(), abs=0.06)


def test_repeated_ids_and_an_existing_score(spark):
    rows = [(i, f"text {i} of some words " * (i % 7 + 1), 5.0) for i in range(60) for _ in range(3 if i else 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == len(rows)
    assert all(0 <= r.score <= 1 for r in out.select("score").distinct().collect())
    assert quality.score(docs.limit(0), model).count() == 0
