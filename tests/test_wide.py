"""Fits without the Gram matrix, against plain numpy and against those with it."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import stats, wide
from brindle.operators.decomposition import PCA, TruncatedSVD
from brindle.operators.linear import ElasticNet, Lasso, LinearRegression, Ridge

from .test_estimators import column, frame


@pytest.fixture(scope="module")
def correlated():
    """Features of very different scale and offset, every second one like the one before."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 60))
    x[:, 1::2] = 0.7 * x[:, ::2] + rng.normal(size=(600, 30))
    x = (x + rng.uniform(-5, 5, 60)) * 10.0 ** rng.uniform(-3, 3, 60)
    x[:, 7] = 3.0
    w = np.where(rng.random(60) < 0.3, rng.normal(size=60), 0) / x.std(axis=0).clip(1e-9)
    w[7] = 0
    return x, x @ w + 5 + rng.normal(0, 0.5, 600)


@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("ratio", [1.0, 0.4])
def test_steps_end_where_descent_does(spark, correlated, intercept, ratio):
    """Predictions of 0.00001 of the label's deviation apart at most, the same features left out, the same least loss."""
    x, y = correlated
    if not intercept:
        x = x - x.mean(axis=0)
    df = frame(spark, x, y).coalesce(1).cache()
    model = ElasticNet(0.05, ratio, fit_intercept=intercept)
    coef, b = (kept := model.fit(df)).coef_, kept.intercept_
    found = model.set_params(method="passes", max_iter=300, tol=1e-7).fit(df)
    assert np.max(np.abs(x @ found.coef_ + found.intercept_ - x @ coef - b)) < 1e-5 * y.std()
    assert found.coef_[7] == 0 and ((found.coef_ != 0) == (coef != 0)).mean() > 0.95
    loss = lambda w, b: ((y - x @ w - b) ** 2).mean() / 2 + 0.05 * (ratio * np.abs(w).sum() + (1 - ratio) * (w @ w) / 2)
    assert loss(found.coef_, found.intercept_) <= loss(coef, b) * (1 + 1e-6)
    df.unpersist()


def test_smooth_models_by_passes(spark, correlated):
    x, y = correlated
    x = x[:, 10:30:2] / x[:, 10:30:2].std(axis=0)
    df = frame(spark, x, y).coalesce(1).cache()
    for model in (LinearRegression(), Ridge(25.0)):
        want = model.fit(df).coef_
        found = model.set_params(method="passes").fit(df)
        assert np.allclose(found.coef_, want, atol=1e-6) and found.n_iter_ < 1000
    df.unpersist()


def test_each_step_is_one_pass(spark, monkeypatch):
    """Passes are counted: as many as ``n_iter_`` says, and few where features are alike in scale."""
    rng = np.random.default_rng(4)
    x = rng.normal(5, 1, (800, 500))
    y = x[:, :5] @ [3.0, -2, 1, 4, 0.5] + rng.normal(0, 0.1, 800)
    passes, sums = [], stats.sums
    monkeypatch.setattr(stats, "sums", lambda *a: passes.append(1) or sums(*a))
    df = frame(spark, x, y)
    want = Lasso(0.1).fit(df).coef_
    passes.clear()
    m = Lasso(0.1, method="passes", tol=1e-8).fit(df)
    assert len(passes) == m.n_iter_ < 80
    assert np.allclose(m.coef_, want, atol=1e-6)


def test_an_end_short_of_the_tolerance_warns(spark, correlated):
    x, y = correlated
    with pytest.warns(UserWarning, match="before it came"):
        assert Lasso(1e-3, method="passes", max_iter=4).fit(frame(spark, x, y)).n_iter_ == 4
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        nothing = Lasso(1e9, method="passes").fit(frame(spark, x, y))
    assert not nothing.coef_.any() and nothing.intercept_ == pytest.approx(y.mean())


def test_a_hundred_thousand_features(spark):
    """Lasso at 100,000 features, where a Gram matrix would take 80 GB; "auto" goes without one, and predicts by one array."""
    d = 100_000
    noise = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.pmod(F.xxhash64("id", j), F.lit(2001)) / 1000.0 - 1.0)
    df = spark.range(0, 120, 1, 8).select("id", noise.alias("features"))
    df = df.withColumn("label", 4 * F.col("features")[10] - 3 * F.col("features")[77_777] + 2.0).persist()
    with warnings.catch_warnings():  # 20 passes find the two features, not yet their weights to the tolerance
        warnings.simplefilter("ignore")
        m = Lasso(0.3, max_iter=20).fit(df)
    assert set(np.argsort(-np.abs(m.coef_))[:2]) == {10, 77_777} and m.coef_[10] > 0 > m.coef_[77_777]
    x = np.array(df.where("id = 5").first().features)
    out = m.predict(df)
    assert out.columns == ["id", "features", "label", "prediction"]
    assert out.where("id = 5").first().prediction == pytest.approx(x @ m.coef_ + m.intercept_)
    df.unpersist()


@pytest.mark.parametrize("centred", [False, True])
def test_leading_directions(spark, centred):
    """Eight of 500 features within 1e-6 of the singular vectors of the whole matrix, over three partitionings."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 500)) * 0.05 + (rng.normal(size=(700, 12)) * np.linspace(6, 1, 12)) @ np.linalg.qr(rng.normal(size=(500, 12)))[0].T + rng.uniform(-1, 1, 500)
    data = x - x.mean(axis=0) if centred else x
    _, s, v = np.linalg.svd(data, full_matrices=False)
    for parts in (1, 4, 30):
        m = (PCA if centred else TruncatedSVD)(8, method="passes").fit(frame(spark, x).repartition(parts))
        assert np.allclose(m.singular_values_, s[:8], rtol=1e-10)
        assert np.allclose(np.abs(m.components_ @ v[:8].T), np.eye(8), atol=1e-6)
        assert np.allclose(m.explained_variance_ratio_, s[:8] ** 2 / ((x - x.mean(axis=0)) ** 2).sum(), rtol=1e-8)
    kept = (PCA if centred else TruncatedSVD)(8, method="gram").fit(frame(spark, x))
    assert np.allclose(kept.components_, m.components_, atol=1e-6)
    df = frame(spark, x)
    assert m.components_.size > wide.LITERALS
    moved = m.transform(df)
    assert np.allclose(column(moved, "features"), data @ m.components_.T) and moved.columns[0] == "id"
    back = data @ m.components_.T @ m.components_ + (x.mean(axis=0) if centred else 0)
    assert np.allclose(column(m.inverse_transform(moved), "features"), back)


def test_small_singular_values_keep_their_digits(spark):
    """A value a billionth of the largest, of which squares would leave nothing."""
    rng = np.random.default_rng(8)
    u, v = np.linalg.qr(rng.normal(size=(200, 4)))[0], np.linalg.qr(rng.normal(size=(30, 4)))[0]
    x = (u * [1.0, 1e-2, 1e-5, 1e-9]) @ v.T
    m = TruncatedSVD(4, method="passes").fit(frame(spark, x))
    assert np.allclose(m.singular_values_, [1.0, 1e-2, 1e-5, 1e-9], rtol=1e-4)


@pytest.mark.parametrize("x", [np.zeros((5, 3)), np.ones((4, 3)), np.arange(12.0).reshape(2, 6), np.eye(3)[:1]])
def test_few_rows_and_ranks(spark, x):
    """Ranks below the number of components, ties, a single row: values as of the whole matrix, orthonormal vectors."""
    m = TruncatedSVD(3, method="passes").fit(frame(spark, x))
    want = np.append(np.linalg.svd(x, compute_uv=False), np.zeros(3))[:3]
    assert np.allclose(m.singular_values_, want, atol=1e-9) and np.allclose(m.components_ @ m.components_.T, np.eye(3))


def test_refusals(spark):
    df = frame(spark, np.eye(4), np.arange(4.0))
    for bad in (PCA(method="passes"), PCA(0.5, method="passes"), TruncatedSVD(9, method="passes"), Lasso(method="other")):
        with pytest.raises(ValueError):
            bad.fit(df)
    with pytest.raises(Exception, match="features must be"):
        Lasso(method="passes").fit(spark.createDataFrame([([1.0, None], 1.0)], "features array<double>, label double"))
    with pytest.raises(ValueError, match="no rows"):
        TruncatedSVD(1, method="passes").fit(df.limit(0))


def test_rows_that_no_model_can_take_get_null(spark):
    m = LinearRegression()
    m.coef_, m.intercept_ = np.arange(3000.0), 1.0
    rows = [(0, [1.0] * 3000), (1, None), (2, [1.0]), (3, [None] + [1.0] * 2999), (4, [0.0] * 3000)]
    df = spark.createDataFrame(rows, "id long, features array<double>").withColumn("Prediction", F.lit("old")).coalesce(1)
    assert [r.prediction for r in m.predict(df).orderBy("id").collect()] == [m.coef_.sum() + 1, None, None, None, 1.0]
    assert m.predict(df.limit(0)).count() == 0
