"""Estimators against closed forms in numpy, invariants and edge cases."""

import os

import numpy as np
import pytest

from pyspark.sql import functions as F

import brindle
from brindle import config
from brindle.operators import stats
from brindle.operators.bayes import GaussianNB
from brindle.operators.cluster import DBSCAN, KMeans, assign
from brindle.operators.decomposition import PCA, TruncatedSVD
from brindle.operators.linear import ElasticNet, Lasso, LinearRegression, LogisticRegression, Ridge
from brindle.operators.neighbors import KNeighborsClassifier, KNeighborsRegressor, NearestNeighbors, pairwise
from brindle.operators.scale import MinMaxScaler, RobustScaler, StandardScaler
from brindle.operators.svm import SVC, SVR
from brindle.operators.trees import HistGradientBoostingClassifier, HistGradientBoostingRegressor


def frame(spark, x, y=None):
    rows = [(i, [float(v) for v in r], *([y[i].item()] if y is not None else [])) for i, r in enumerate(np.asarray(x, float))]
    kind = "" if y is None else ", label double" if np.asarray(y).dtype.kind == "f" else ", label long"
    return spark.createDataFrame(rows, "id long, features array<double>" + kind).repartition(3)


def column(df, name):
    return np.array([r[name] for r in df.orderBy("id").select(name).collect()])


@pytest.fixture(scope="module")
def regression():
    rng = np.random.default_rng(42)
    x = rng.normal(3, [1, 2, 5, 0.1], (400, 4))
    return x, x @ [1.5, -2.0, 0.0, 4.0] + 7 + rng.normal(0, 0.3, 400)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(1)
    c = rng.uniform(-10, 10, (3, 2))
    y = np.repeat([0, 1, 2], 60)
    return c[y] + rng.normal(0, 0.5, (180, 2)), y


def test_scalers(spark):
    x = np.array([[3.0, 8, 5], [1, 6, 5], [4, 9, 5], [0, 7, 5]])
    df = frame(spark, x)
    s = StandardScaler().fit(df)
    assert np.allclose(s.mean_, x.mean(axis=0)) and np.allclose(s.var_, x.var(axis=0)) and s.scale_[2] == 1
    assert np.allclose(column(s.transform(df), "features"), (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0)))
    m = MinMaxScaler((-1, 1)).fit(df)
    assert m.data_min_.tolist() == [0, 6, 5] and m.data_max_.tolist() == [4, 9, 5]
    assert np.allclose(column(m.transform(df), "features")[:, 2], -1)
    r = RobustScaler().fit(df)
    assert np.allclose(r.center_, np.median(x, axis=0))
    assert np.allclose(r.scale_[:2], np.subtract(*np.quantile(x, [0.75, 0.25], axis=0))[:2])
    for k in (s, m, r):
        assert np.allclose(column(k.inverse_transform(k.transform(df)), "features"), x)
    assert StandardScaler().fit(frame(spark, [[1.0], [3.0]])).var_ == 1


def test_validation(spark):
    for bad in ([[1.0, 2.0], [1.0]], [[1.0], None], [[float("nan")], [1.0]], [[None], [1.0]]):
        df = spark.createDataFrame([(b,) for b in bad], "features array<double>")
        with pytest.raises(ValueError):
            StandardScaler().fit(df)
    with pytest.raises(ValueError):
        StandardScaler().fit(spark.createDataFrame([], "features array<double>"))


def test_linear_models(spark, regression):
    x, y = regression
    df = frame(spark, x, y)
    one = np.c_[x, np.ones(len(x))]
    w = np.linalg.lstsq(one, y, rcond=None)[0]
    m = LinearRegression().fit(df)
    assert np.allclose([*m.coef_, m.intercept_], w)
    assert m.score(df) == pytest.approx(1 - np.var(y - one @ w) / np.var(y))
    assert np.allclose(LinearRegression(fit_intercept=False).fit(df).coef_, np.linalg.lstsq(x, y, rcond=None)[0])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    assert np.allclose(Ridge(10.0).fit(df).coef_, np.linalg.solve(xc.T @ xc + 10 * np.eye(4), xc.T @ yc))
    for model in (Lasso(0.3), ElasticNet(0.3, 0.4)):
        m = model.fit(df)
        ratio = m.l1_ratio
        slope = xc.T @ (yc - xc @ m.coef_) / len(x) - 0.3 * (1 - ratio) * m.coef_
        on = m.coef_ != 0
        assert np.allclose(slope[on], 0.3 * ratio * np.sign(m.coef_[on]), atol=1e-7)
        assert np.all(np.abs(slope[~on]) <= 0.3 * ratio + 1e-9)
    wide = np.random.default_rng(0).normal(size=(10, 50))
    assert np.allclose(column(LinearRegression().fit(frame(spark, wide, wide[:, 0])).predict(frame(spark, wide)), "prediction"), wide[:, 0], atol=1e-6)


@pytest.mark.parametrize("intercept", [True, False])
def test_logistic_gradient_is_zero(spark, intercept):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + 1
    y = (x @ [1, 0.1, -5] + rng.logistic(size=300) > 0.5).astype(int) + 1
    m = LogisticRegression(C=0.5, fit_intercept=intercept).fit(frame(spark, x, y))
    assert m.classes_ == [1, 2]
    p = 1 / (1 + np.exp(-(x @ m.coef_[0] + m.intercept_[0])))
    assert np.allclose(x.T @ (p - (y - 1)) + m.coef_[0] / 0.5, 0, atol=1e-4)
    assert (abs((p - (y - 1)).sum()) < 1e-4) if intercept else m.intercept_[0] == 0
    probs = column(m.predict_proba(frame(spark, x)), "probability")
    assert np.allclose(probs[:, 1], p)


def test_multinomial(spark, blobs):
    x, y = blobs
    df = frame(spark, x, y)
    m = LogisticRegression().fit(df)
    assert m.score(df) > 0.98
    z = x @ m.coef_.T + m.intercept_
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert np.allclose(x.T @ (p - np.eye(3)[y]) + m.coef_.T, 0, atol=0.05)
    assert np.allclose(column(m.predict_proba(df), "probability"), p)


def test_decompositions(spark, regression):
    x, _ = regression
    df = frame(spark, x)
    for model, data in ((TruncatedSVD(3), x), (PCA(3), x - x.mean(axis=0))):
        m = model.fit(df)
        _, s, v = np.linalg.svd(data, full_matrices=False)
        assert np.allclose(m.singular_values_, s[:3])
        assert np.allclose(np.abs(m.components_ @ v[:3].T), np.eye(3), atol=1e-6)
        assert np.allclose(m.components_ @ m.components_.T, np.eye(3))
        t = column(m.transform(df), "features")
        assert np.allclose(t, data @ m.components_.T)
    assert PCA(0.9).fit(df).n_components_ == 2
    full = PCA().fit(df)
    assert np.allclose(column(full.inverse_transform(full.transform(df)), "features"), x)
    assert full.explained_variance_ratio_.sum() == pytest.approx(1)


def test_naive_bayes(spark, blobs):
    x, y = blobs
    df = frame(spark, x, y)
    m = GaussianNB().fit(df)
    assert np.allclose(m.theta_, [x[y == c].mean(axis=0) for c in range(3)])
    assert m.epsilon_ == pytest.approx(1e-9 * x.var(axis=0).max())
    j = np.array([[np.log(1 / 3) - 0.5 * np.sum(np.log(2 * np.pi * v) + (r - t) ** 2 / v) for t, v in zip(m.theta_, m.var_, strict=True)] for r in x])
    assert np.array_equal(column(m.predict(df), "prediction"), j.argmax(axis=1))
    assert np.allclose(column(m.predict_proba(df), "probability").sum(axis=1), 1)


def test_distances_by_hand(spark):
    df = frame(spark, [[1.0, 0], [0, 1], [1, 1]])
    d = {(r.left_id, r.right_id): r.distance for r in pairwise(df, df, "sqeuclidean").collect()}
    assert len(d) == 9 and d[0, 1] == 2 and d[0, 2] == 1 and d[1, 1] == 0
    assert {(r.left_id, r.right_id) for r in pairwise(df, df, "manhattan", 1.0).collect()} == {(0, 0), (1, 1), (2, 2), (0, 2), (2, 0), (1, 2), (2, 1)}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_neighbors(spark, metric):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(90, 3)), 1) + 0.05
    x[10:20] = x[0]
    m = NearestNeighbors(7, metric).fit(frame(spark, x))
    got = {}
    for r in m.kneighbors().orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    for i in range(90):
        d = {"euclidean": np.sqrt(((x - x[i]) ** 2).sum(axis=1)), "manhattan": np.abs(x - x[i]).sum(axis=1), "cosine": 1 - x @ x[i] / np.sqrt((x * x).sum(axis=1) * (x[i] @ x[i]))}[metric]
        assert np.allclose(np.sort(d)[:7], d[got[i]], atol=1e-9)
    assert got[0] == [0, *range(10, 16)] or metric == "cosine"
    assert len(NearestNeighbors(50).fit(frame(spark, x[:4])).kneighbors().collect()) == 16


def test_knn_votes(spark, blobs):
    x, y = blobs
    for weights in ("uniform", "distance"):
        assert KNeighborsClassifier(5, weights).fit(frame(spark, x, y)).score(frame(spark, x, y)) > 0.98
        r = KNeighborsRegressor(3, weights).fit(frame(spark, x, x[:, 0]))
        p = column(r.predict(frame(spark, x)), "prediction")
        assert np.abs(p - x[:, 0]).max() < 0.7
        if weights == "distance":
            assert np.allclose(p, x[:, 0], atol=1e-6)
    shares = KNeighborsClassifier(5).fit(frame(spark, x, y)).predict_proba(frame(spark, x[:3])).groupBy("id").sum("share").collect()
    assert all(s[1] == pytest.approx(1) for s in shares)


def test_kmeans(spark, blobs):
    x, y = blobs
    df = frame(spark, x)
    assert assign(np.array([[0.0, 0], [1, 1], [10, 10], [9, 9]]), np.array([[0.0, 0], [10, 10]]))[0].tolist() == [0, 0, 1, 1]
    for init in ("k-means++", "random"):
        m = KMeans(3, init=init).fit(df)
        want = np.array([x[y == c].mean(axis=0) for c in range(3)])
        assert np.allclose(np.sort(m.cluster_centers_, axis=0), np.sort(want, axis=0), atol=1e-6)
        assert m.inertia(df) == pytest.approx(m.inertia_)
    p = column(m.predict(df), "prediction")
    assert len({(a, b) for a, b in zip(p, y, strict=True)}) == 3
    far = KMeans(3, init=np.array([x[0], x[60], [1e6, 1e6]])).fit(df)
    assert far.cluster_centers_[2].tolist() == [1e6, 1e6]
    assert np.allclose(column(m.transform(df), "distances").argmin(axis=1), p)
    with pytest.raises(ValueError):
        KMeans(3).fit(frame(spark, [[1.0], [1.0], [2.0]]))


def test_dbscan(spark, blobs):
    x, y = blobs
    x = np.vstack([x, [[100.0, 100], [100.3, 100]]])
    df = frame(spark, x)
    m = DBSCAN(0.8, 5).fit(df)
    got = m.labels_.orderBy("id").collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.8
    core = d.sum(axis=1) >= 5
    label = np.full(len(x), -1)
    n = 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = n
                    todo += np.flatnonzero(d[j] & core).tolist()
            n += 1
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(d[i] & core)
        label[i] = label[near[0]] if len(near) else -1
    assert [r.cluster for r in got] == label.tolist() and [r.is_core for r in got] == core.tolist()
    assert DBSCAN(0.1, 1).fit(frame(spark, [[0.0], [5.0]])).labels_.select("cluster").distinct().count() == 2


def test_svc_and_svr(spark, blobs):
    x, y = blobs
    df = frame(spark, x, y)
    m = SVC().fit(df)
    assert m.score(df) > 0.98 and len(m.pairs_) == 3
    ring = np.random.default_rng(3).normal(size=(300, 2))
    z = ((ring**2).sum(axis=1) > 1.3).astype(int)
    two = SVC(C=10.0).fit(frame(spark, ring, z))
    assert two.score(frame(spark, ring, z)) > 0.95
    assert abs(two.dual_coef_[0].sum()) < 1e-9 and np.abs(two.dual_coef_[0]).max() <= 10 + 1e-9
    assert two.gamma_ == pytest.approx(1 / (2 * ring.var()))
    cascade = SVC(C=10.0, block=120).fit(frame(spark, ring, z))
    a, b = (column(k.decision_function(frame(spark, ring)), "decision") for k in (two, cascade))
    assert np.mean((a > 0) == (b > 0)) > 0.97
    t = np.linspace(0, 6, 200)[:, None]
    r = SVR(C=10.0).fit(frame(spark, t, np.sin(t[:, 0])))
    assert r.score(frame(spark, t, np.sin(t[:, 0]))) > 0.97


def test_boosting(spark, regression, blobs):
    x, y = regression
    df = frame(spark, x, y)
    m = HistGradientBoostingRegressor(max_iter=12, learning_rate=0.3).fit(df)
    assert m.score(df) > 0.85
    short = HistGradientBoostingRegressor(max_iter=1, max_leaf_nodes=4, learning_rate=1.0, min_samples_leaf=5).fit(df)
    tree = short.trees_[0][0]
    leaf = tree.leaves(x)
    for n in set(leaf.tolist()):
        assert tree.value[n] == pytest.approx(y[leaf == n].mean() - y.mean()) and (leaf == n).sum() >= 5
    x, y = blobs
    c = HistGradientBoostingClassifier(max_iter=3, learning_rate=0.5).fit(frame(spark, x, y))
    assert c.score(frame(spark, x, y)) > 0.95
    b = HistGradientBoostingClassifier(max_iter=3).fit(frame(spark, x, (y > 0).astype(int)))
    assert b.score(frame(spark, x, (y > 0).astype(int))) > 0.95
    assert np.allclose(column(b.predict_proba(frame(spark, x)), "probability").sum(axis=1), 1)


def test_gram(spark, regression):
    x, y = regression
    g = stats.gram(frame(spark, x + 1e6, y), label=True)
    assert np.allclose(g["xx"], np.cov(x.T, bias=True) * len(x), rtol=1e-5)


def test_pipeline_registry_and_config(spark, blobs):
    x, y = blobs
    df = frame(spark, x, y)
    p = brindle.Pipeline([("scale", StandardScaler()), ("model", LogisticRegression())])
    with brindle.running("compact"):
        assert p.fit(df).score(df) > 0.98
    assert p.get_params()["model__C"] == 1.0 and p.set_params(model__C=0.5).named_steps["model"].C == 0.5

    class Ridge:  # a look-alike, told by its name
        def get_params(self):
            return {"alpha": 3.0, "solver": "auto"}

        def fit(self, x, y):
            raise AssertionError

    assert isinstance(brindle.distribute(Ridge()), brindle.REGISTRY["Ridge"]) and brindle.wrap(Ridge()).alpha == 3.0
    assert brindle.distribute(lambda: Ridge())().alpha == 3.0 and brindle.distribute(Ridge) is brindle.REGISTRY["Ridge"]
    with pytest.warns(UserWarning):
        assert brindle.wrap(3) == 3
    config.reset()
    with pytest.raises(ValueError):
        config.set_mode("gpu")
    config.set_mode("cluster")
    with config.running("auto"):
        assert config.get_config()["mode"] == "auto"
    assert config.get_config()["mode"] == "cluster"
    config.update_threshold("KMeans", 5)
    assert config.get_config()["thresholds"] == {"KMeans": 5}
    config.reset()
    assert len(brindle.REGISTRY) == 20 and brindle.cluster_info(spark)["parallelism"] >= 1


def test_streaming_scores(spark, regression, tmp_path):
    from brindle.streaming.scoring import score_to_parquet

    x, y = regression
    df = frame(spark, x, y)
    m = LinearRegression().fit(df)
    df.write.parquet(str(tmp_path / "in"))
    score_to_parquet(m, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    assert np.allclose(column(spark.read.parquet(str(tmp_path / "out")), "prediction"), column(m.predict(df), "prediction"))


class Like:
    """A look-alike of any name, with defaults of its own."""

    defaults: dict = {}

    def __init__(self, **given):
        self.given = given

    def get_params(self):
        return self.defaults | self.given

    def fit(self, x, y):
        raise AssertionError


def like(name, defaults, **given):
    return type(name, (Like,), {"defaults": defaults})(**given)


def test_every_parameter_is_taken_over():
    cases = [
        ("Ridge", {"alpha": 1.0, "solver": "auto"}, {"alpha": 5}, {"alpha": 5.0}),
        ("SVC", {"C": 1.0, "gamma": "scale", "kernel": "rbf", "max_iter": -1}, {"gamma": 0.5, "C": 10}, {"gamma": 0.5, "C": 10.0, "max_iter": 100_000}),
        ("LogisticRegression", {"C": 1.0, "penalty": "l2"}, {"C": 2}, {"C": 2.0}),
        ("KMeans", {"n_init": "auto", "random_state": None}, {"n_init": 10, "n_clusters": np.int64(3)}, {"n_init": 10, "n_clusters": 3, "random_state": 0}),
        ("KMeans", {}, {"init": [[0.0], [1.0]], "n_clusters": 2}, {"n_clusters": 2}),
        ("SVR", {}, {"C": 7, "gamma": 0.3, "epsilon": 0}, {"C": 7.0, "gamma": 0.3, "epsilon": 0.0}),
        ("PCA", {"n_components": None}, {"n_components": 0.5}, {"n_components": 0.5}),
        ("MinMaxScaler", {}, {"feature_range": [0, 2]}, {"feature_range": (0, 2)}),
        ("GaussianNB", {"priors": None}, {"priors": np.array([0.5, 0.5])}, {"priors": [0.5, 0.5]}),
        ("KNeighborsClassifier", {"metric": "minkowski", "p": 2}, {"p": 1, "n_neighbors": 7}, {"metric": "manhattan", "n_neighbors": 7}),
        ("HistGradientBoostingRegressor", {"max_depth": None}, {"max_depth": 3, "learning_rate": 1}, {"max_depth": 3, "learning_rate": 1.0}),
        ("StandardScaler", {"with_mean": True}, {"with_mean": False}, {"with_mean": False}),
        ("DBSCAN", {}, {"eps": 2, "min_samples": 3}, {"eps": 2.0, "min_samples": 3}),
    ]
    for name, defaults, given, want in cases:
        got = brindle.wrap(like(name, defaults, **given)).get_params()
        assert {k: got[k] for k in want} == want and all(type(got[k]) is type(v) for k, v in want.items())
    for name in brindle.REGISTRY:
        own = brindle.REGISTRY[name]().get_params()
        assert brindle.wrap(like(name, own)).get_params() == own and brindle.is_supported(like(name, own))
    for name, given in (("Ridge", {"alpha": "much"}), ("KMeans", {"n_clusters": 2.5}), ("SVC", {"kernel": "poly"}), ("NearestNeighbors", {"metric": "hamming"}), ("StandardScaler", {"with_std": 1})):
        with pytest.raises((TypeError, ValueError)):
            brindle.wrap(like(name, {}, **given))
        assert not brindle.is_supported(like(name, {}, **given))
    with pytest.warns(UserWarning, match="warm_start"):
        brindle.wrap(like("Lasso", {"warm_start": False}, warm_start=True))


def test_fits_are_routed(spark, regression):
    x, y = regression
    seen, real = [], config.routed
    config.routed = lambda df, name: seen.append(name) or real(df, name)
    try:
        brindle.Pipeline([("s", StandardScaler()), ("m", LinearRegression())]).fit(frame(spark, x, y))
        LinearRegression().fit(frame(spark, x, y))
        MinMaxScaler().fit(frame(spark, x, y))
    finally:
        config.routed = real
    assert seen == ["Pipeline", "LinearRegression", "MinMaxScaler"]


def test_support_vectors_by_working_sets(spark):
    """Overlapping classes, most rows support vectors: the same solution whatever the size of a working set."""
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(400, 2)), 1)
    y = (rng.random(400) < 0.5 + 0.2 * np.sign(x[:, 0])).astype(int)
    df = frame(spark, np.vstack([x, x[:50]]), np.append(y, y[:50]))
    whole, parts = SVC(tol=1e-5).fit(df), SVC(tol=1e-5, block=120).fit(df)
    assert whole.n_iter_ == 1 and parts.n_iter_ > 2 and parts.converged_
    a, b = (column(m.decision_function(frame(spark, x)), "decision") for m in (whole, parts))
    assert np.abs(a - b).max() < 1e-3
    assert whole.n_support_[0] > 150 and whole.n_features_in_ == 2
    # The conditions of the optimum: margin of free rows, and no row can do better.
    margin = np.where(y > 0, 1, -1) * a
    alpha = {tuple(v): abs(c) for v, c in zip(whole.support_vectors_[0], whole.dual_coef_[0], strict=True)}
    inside = np.array([alpha.get(tuple(v), 0.0) for v in x])
    assert np.all(margin[inside == 0] >= 1 - 1e-3) or len({tuple(v) for v in x}) < 400
    z = np.sin(3 * x[:, 0]) + 0.1 * rng.normal(size=400)
    r = [column(SVR(C=1.0, tol=1e-4, block=k).fit(frame(spark, x, z)).predict(frame(spark, x)), "prediction") for k in (2000, 200)]
    assert np.abs(r[0] - r[1]).max() < 1e-3
    with pytest.warns(UserWarning, match="rounds"):
        SVC(block=20, max_rounds=1).fit(df)


def test_probabilities_of_support_vectors(spark, blobs):
    x, y = blobs
    df = frame(spark, x, y)
    m = SVC(probability=True).fit(df)
    p = column(m.predict_proba(df), "probability")
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y).mean() > 0.97
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 1))
    true = 1 / (1 + np.exp(-2 * x[:, 0]))
    two = SVC(probability=True).fit(frame(spark, x, (rng.random(600) < true).astype(int)))
    assert np.abs(column(two.predict_proba(frame(spark, x)), "probability")[:, 1] - true).mean() < 0.12
    with pytest.raises(ValueError):
        SVC().fit(df).predict_proba(df)


def test_quantiles_of_ties_and_spikes(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 3, 1001), np.r_[np.full(1000, 1e-9), 1e12], rng.normal(size=1001), np.zeros(1001), np.r_[rng.normal(size=1000) * 1e-12 + 5, -1e300]])
    at = (0.0, 0.25, 0.5, 0.731, 1.0)
    assert np.allclose(stats.quantiles(frame(spark, x), at), np.quantile(x, at, axis=0), rtol=1e-14, atol=0)
    assert np.allclose(stats.quantiles(frame(spark, x[:2]), at), np.quantile(x[:2], at, axis=0))


def test_neighbours_over_many_blocks(spark, monkeypatch):
    from brindle.operators import blocks, metric, neighbors

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 3)), 1)
    df = frame(spark, x)
    whole = sorted(map(tuple, neighbors.kneighbors(df, df, 4).collect()))
    pairs = sorted(map(tuple, neighbors.pairwise(df, df, within=0.55).collect()))
    every = sorted(map(tuple, neighbors.pairwise(df, df).collect()))
    for name in ("LEFT", "RIGHT", "SHARE"):
        monkeypatch.setattr(blocks, name, 100)
    for name in ("LEFT", "RIGHT"):
        monkeypatch.setattr(metric, name, 100)
    monkeypatch.setattr(metric, "SHARE", 2)
    assert sorted(map(tuple, neighbors.pairwise(df, df).collect())) == every
    assert sorted(map(tuple, neighbors.kneighbors(df, df, 4).collect())) == whole
    assert sorted(map(tuple, neighbors.pairwise(df, df, within=0.55).collect())) == pairs
    near = {(r.id, r.other) for r in neighbors.radius_edges(df, 0.55).collect()}
    monkeypatch.setattr(neighbors, "CELL", 5)
    assert {(r.id, r.other) for r in neighbors.radius_edges(df, 0.55).collect()} == near == {(a, b) for a, b, _ in pairs if a != b}


def test_seeds_are_different_rows(spark):
    from brindle.operators.cluster import _drawn

    x = np.repeat(np.arange(40.0)[:, None], 30, axis=0)
    df = frame(spark, x).select("features").repartition(5)
    got = _drawn(df, 12, 7)
    assert len({tuple(r) for r in got}) == 12 and np.array_equal(got, _drawn(df.coalesce(1), 12, 7))
    far = _drawn(df, 100, 7, np.array([[0.0]]))
    assert len(far) == 39 and not (far == 0).any()
    m = KMeans(40).fit(frame(spark, x))
    assert m.inertia_ == 0 and m.n_features_in_ == 1 and m.labels_.select("prediction").distinct().count() == 40


def test_bad_features(spark):
    good = [[1.0, 2.0], [2.0, 1.0]]
    for rows in ([*good, [1.0]], [*good, [1.0, float("nan")]], [*good, [1.0, None]], [*good, None], [[1.0, float("inf")], *good]):
        df = spark.createDataFrame([(i, x, float(i)) for i, x in enumerate(rows)], "id long, features array<double>, label double")
        for m in (StandardScaler(), RobustScaler(), LinearRegression(), PCA(), KMeans(2), SVR()):
            with pytest.raises(ValueError):
                m.fit(df)


def test_routing_runs_nothing_and_narrows_nothing(spark):
    """A filtered input of 64 partitions keeps its tasks, whatever the mode; the decision takes no job."""
    big = spark.range(0, 64_000_000, 1, 64).where("id % 4000000 = 0").selectExpr("array(double(id), 1.0D) AS features")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("routing", "routing")
    try:
        for mode in ("auto", "cluster", "compact"):
            with brindle.running(mode):
                routed = config.routed(big, "KMeans")
            assert tracker.getJobIdsForGroup("routing") == () or not list(tracker.getJobIdsForGroup("routing"))
            if mode != "compact":
                assert routed.rdd.getNumPartitions() == 64
    finally:
        spark.sparkContext.setJobGroup("other", "other")
    with brindle.running("compact"):
        packed = config.routed(big, "KMeans")
    assert "RoundRobin" in packed._jdf.queryExecution().toString() or "SinglePartition" in packed._jdf.queryExecution().toString()
    assert "Coalesce 1" not in packed._jdf.queryExecution().toString() and packed.count() == 16
    assert config.estimated_rows(big) > 20_000 >= config.estimated_rows(spark.range(16).selectExpr("array(double(id)) AS features"))


def plain_moments(x):
    x = x.astype(np.longdouble)
    return [np.asarray(v, float) for v in (x.mean(axis=0), x.var(axis=0), x.min(axis=0), x.max(axis=0))]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_moments_of_large_numbers(spark, parts):
    """A column of 1e9 plus noise, a constant, and wide ranges, over one and several tasks."""
    rng = np.random.default_rng(3)
    x = np.column_stack([1e9 + rng.normal(size=5000), np.full(5000, 7.0), rng.normal(size=5000) * 1e-9, rng.exponential(1e6, 5000)])
    s = stats.describe(frame(spark, x).repartition(parts))
    mean, var, low, high = plain_moments(x)
    assert s["n"] == 5000 and (s["low"] == low).all() and (s["high"] == high).all()
    assert np.allclose(s["mean"], mean, rtol=1e-14) and np.allclose(s["m2"] / 5000, var, rtol=1e-9, atol=0)


def test_partial_results_meet_in_a_tree(spark, monkeypatch):
    """More tasks than one level takes: what each shuffle moves is a row for each task, then for each reducer."""
    monkeypatch.setattr(stats, "FAN", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 20))
    df = frame(spark, x).repartition(60)
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    try:
        assert np.allclose(stats.describe(df)["mean"], x.mean(axis=0))
        g = stats.gram(df)
        assert np.allclose(g["xx"], (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))
        s = stats.sums(df, lambda b: {"a": np.array([len(b)])} if len(b) > 1 else {}, ["a", "none"])
        assert s["a"].sum() <= 4000 and len(s["none"]) == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("bad", [[[1.0, 2.0], [1.0]], [[1.0], None], [[1.0], [None]], [[1.0], [float("nan")]], [[1.0], [float("inf")]]])
def test_unsound_features_are_refused(spark, bad):
    df = spark.createDataFrame([(b,) for b in bad], "features array<double>").repartition(2)
    for model in (StandardScaler(), MinMaxScaler(), RobustScaler()):
        with pytest.raises(ValueError):
            model.fit(df)
        with pytest.raises(ValueError):
            model.fit(df.limit(0))


def test_tidy_keeps_to_its_own_thread(spark):
    from threading import Barrier, Thread

    from brindle.operators import shared

    step, counts, firsts = Barrier(2), {}, []

    def run(k):
        with shared.tidy(spark):
            firsts.append(shared.stage(spark.range(5 + k), "first").inputFiles()[0])
            step.wait()
            out = shared.stage(spark.range(10 + k), "last")
            step.wait()
        counts[k] = out.count()

    threads = [Thread(target=run, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert counts == {0: 10, 1: 11} and len(firsts) == 2
    assert not any(os.path.exists(f.removeprefix("file://")) for f in firsts)


def test_streaming_goes_on_where_it_ended(spark, regression, tmp_path):
    from brindle.streaming.scoring import score_to_parquet

    x, y = regression
    df = frame(spark, x, y)
    m = LinearRegression().fit(df)
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        score_to_parquet(m, stream(), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(x)


def nearest_by_all(ids, x, other, y, k, metric):
    """query_id, rank, neighbor_id, distance by all distances; rows at no distance are left out."""
    from brindle.operators.metric import distances

    with np.errstate(invalid="ignore", divide="ignore"):
        d = distances(x, y, metric)
    out = []
    for i, row in zip(ids, d, strict=True):
        order = sorted((v, int(o)) for v, o in zip(row.tolist(), other, strict=True) if np.isfinite(v))[:k]
        out += [(int(i), n + 1, o, v) for n, (v, o) in enumerate(order)]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "manhattan", "cosine"])
@pytest.mark.parametrize("k", [1, 7, 60])
def test_nearest_by_a_metric_partition(spark, monkeypatch, metric, k):
    """Clusters, ties, repeated rows, a far row and a zero row, over many blocks, against all distances."""
    from brindle.operators import metric as m
    from brindle.operators.neighbors import kneighbors, pairwise

    rng = np.random.default_rng(k)
    centers = rng.normal(size=(9, 4)) * 20
    x = np.round(np.vstack([centers[rng.integers(0, 9, 400)] + rng.normal(size=(400, 4)), np.zeros((1, 4)), np.full((1, 4), 1e4)]), 1)
    x = np.vstack([x, x[:30]])
    y = np.round(np.vstack([x[::7], rng.normal(size=(20, 4)) * 30]), 1)
    monkeypatch.setattr(m, "LEFT", 80)
    monkeypatch.setattr(m, "RIGHT", 60)
    monkeypatch.setattr(m, "SHARE", 3)
    train, queries = frame(spark, x).repartition(3), frame(spark, y).repartition(2)
    got = sorted(map(tuple, kneighbors(train, queries, k, metric).collect()))
    want = sorted(nearest_by_all(range(len(y)), y, range(len(x)), x, k, metric))
    # Products of other shapes round otherwise, so rows of one direction may change places.
    known = 2 if metric == "cosine" else 3
    assert [g[:known] for g in got] == [w[:known] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    radius = {"euclidean": 2.0, "sqeuclidean": 4.0, "manhattan": 3.0, "cosine": 0.01}[metric]
    with np.errstate(invalid="ignore", divide="ignore"):
        d = m.distances(y, x, metric)
    assert {(r.left_id, r.right_id) for r in pairwise(queries, train, metric, radius).collect()} == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= radius), strict=True)}


def test_only_surviving_pairs_of_blocks_are_moved(spark, monkeypatch):
    """On clustered vectors the pairs of blocks that are brought together grow with the blocks, not with their square."""
    from brindle.operators import metric as m
    from brindle.operators.neighbors import kneighbors

    monkeypatch.setattr(m, "LEFT", 16 * 40)
    monkeypatch.setattr(m, "RIGHT", 16 * 40)
    seen, real = [], m.together
    monkeypatch.setattr(m, "together", lambda q, data, pairs, *a: seen.append((q.count(), data.count(), pairs.count())) or real(q, data, pairs, *a))
    for clusters in (10, 40):
        rng = np.random.default_rng(clusters)
        x = (rng.normal(size=(clusters, 16)) * 50)[np.repeat(np.arange(clusters), 80)] + rng.normal(size=(80 * clusters, 16))
        df = frame(spark, x)
        assert kneighbors(df, df, 5).count() == 5 * len(x)
    for blocks, rings, pairs in seen:
        assert rings >= 20 and pairs <= 4 * blocks and pairs < blocks * rings / 4
    assert seen[1][2] <= 6 * seen[0][2]


def dbscan_by_all(x, eps, least):
    """(cluster, is_core) of each row by all distances."""
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    root = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.where(core, np.where(near & core[None], root[None], len(x)).min(axis=1), -1)
        if (new == root).all():
            break
        root = new
    names = {r: i for i, r in enumerate(sorted(set(root[core].tolist())))}
    out = []
    for i in range(len(x)):
        mates = np.flatnonzero(near[i] & core)
        out.append((names[root[mates[0] if not core[i] else i]] if core[i] or len(mates) else -1, bool(core[i])))
    return out


@pytest.mark.parametrize("d,eps,least", [(1, 0.3, 4), (2, 0.5, 5), (2, 0.25, 3), (3, 0.8, 8), (5, 1.2, 5), (6, 1.5, 12), (2, 0.4, 1)])
def test_dbscan_by_cells_equals_all_pairs(spark, monkeypatch, d, eps, least):
    """Blobs, a thin bridge, repeated points and far noise; cells over several tasks."""
    from brindle.operators import density

    monkeypatch.setattr(density, "PART", 30)
    rng = np.random.default_rng(d * 10 + least)
    x = np.vstack([rng.normal(size=(150, d)) * 0.4, rng.normal(size=(120, d)) * 0.2 + 2.0, np.linspace(0, 1, 25)[:, None] * np.full(d, 2.0), rng.uniform(-6, 6, size=(60, d)), np.full((20, d), -3.0)])
    want = dbscan_by_all(x, eps, least)
    assert len({c for c, _ in want}) > 2
    m = DBSCAN(eps, least).fit(frame(spark, x).repartition(3))
    got = {r.id: (r.cluster, r.is_core) for r in m.labels_.collect()}
    assert [got[i] for i in range(len(x))] == want
    ids = {r.id for r in m.core_sample_indices_.collect()}
    assert ids == {i for i, (_, c) in enumerate(want) if c} == {r.id for r in m.components_.collect()}


def test_dense_blobs_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Two blobs of many points: what is sent to cells and joined is in proportion to cells; close blobs that touch nowhere stay apart."""
    from brindle.operators import density

    sizes, real = [], density.stage
    monkeypatch.setattr(density, "stage", lambda df, name: sizes.append((name, (out := real(df, name)).count())) or out)
    rng = np.random.default_rng(7)
    r, a = np.sqrt(rng.random(40_000)), rng.random(40_000) * 2 * np.pi
    blob = np.column_stack([r * np.cos(a), r * np.sin(a)])
    x = np.vstack([blob[:20_000], blob[20_000:] + [2.15, 0.0]])
    found = DBSCAN(0.1, 10).fit(frame(spark, x)).labels_.groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in found if r.cluster >= 0}.keys() == {0, 1}
    cells = dict(sizes)["cells"]
    assert cells < 2500 and all(n <= 25 * cells for name, n in sizes if name not in ("filed-points", "dbscan"))


def boosted_by_hand(x, y, gradients, baseline, rounds, rate, most, least):
    """Raw scores of a booster that tries every split of every leaf by all rows, the best leaf first; NaN goes to the better side."""
    raw = np.full(len(y), baseline)
    score = lambda g, h: g.sum() ** 2 / (h.sum() + 1e-12)
    for _ in range(rounds):
        g, h = gradients(raw, y)

        def best(rows, g=g, h=h):
            found = (1e-12, None)
            for side in (False, True):
                for j in range(x.shape[1]):
                    v = x[rows, j]
                    gone = np.isnan(v)
                    if side and not gone.any():
                        continue
                    for t in [*np.unique(v[~gone]), *([] if side or not gone.any() else [np.inf])]:
                        left = np.where(gone, side, v <= t)
                        if min(left.sum(), (~left).sum()) >= least:
                            a, b = rows[left], rows[~left]
                            gain = score(g[a], h[a]) + score(g[b], h[b]) - score(g[rows], h[rows])
                            if gain > found[0] * (1 + 1e-9):
                                found = (gain, (a, b))
            return found

        leaves = [(best(np.arange(len(y))), np.arange(len(y)))]
        while len(leaves) < most:
            i = max(range(len(leaves)), key=lambda i: leaves[i][0][0] if leaves[i][0][1] else -1)
            if not leaves[i][0][1]:
                break
            (_, parts), _ = leaves.pop(i)
            leaves += [(best(p), p) for p in parts]
        for _, rows in leaves:
            raw[rows] -= rate * g[rows].sum() / (h[rows].sum() + 1e-12)
    return raw


@pytest.mark.parametrize("missing", [0.0, 0.15])
def test_boosted_trees_equal_every_split_tried(spark, monkeypatch, missing):
    """31 leaves on four features, three iterations: predictions as by a plain booster, in far fewer passes than splits."""
    from brindle.operators import trees

    monkeypatch.setattr(trees, "KEPT", 2)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, size=(900, 4)).astype(float)
    y = x[:, 0] * x[:, 1] - 3 * (x[:, 2] > 5) * x[:, 3] + rng.normal(size=900)
    x[rng.random(x.shape) < missing] = np.nan
    if missing:
        y += 5 * np.isnan(x[:, 1])
    passes, real = [], stats.sums
    monkeypatch.setattr(stats, "sums", lambda *a: passes.append(1) or real(*a))
    m = HistGradientBoostingRegressor(max_iter=3, learning_rate=0.5, min_samples_leaf=5).fit(frame(spark, x, y))
    assert all(sum(f < 0 for f in t.feature) == 31 for row in m.trees_ for t in row) and len(passes) <= 3 * 16
    want = boosted_by_hand(x, y, lambda raw, y: (raw - y, np.ones(len(y))), y.mean(), 3, 0.5, 31, 5)
    got = column(m.predict(frame(spark, x)), "prediction")
    assert np.allclose(got, want, rtol=1e-8)
    # As nested conditions, a tree gives the same.
    t = m.trees_[0][0]
    assert np.allclose(column(frame(spark, x).withColumn("p", t.expression(F.col("features"))), "p"), t.predict(x))
    label = (y > np.median(y)).astype(int)
    c = HistGradientBoostingClassifier(max_iter=2, learning_rate=0.5, max_leaf_nodes=9, min_samples_leaf=5).fit(frame(spark, x, label))

    def two(raw, y):
        p = 1 / (1 + np.exp(-raw))
        return p - y, p * (1 - p)

    raw = boosted_by_hand(x, label, two, np.log(label.mean() / (1 - label.mean())), 2, 0.5, 9, 5)
    assert np.allclose(column(c.predict_proba(frame(spark, x)), "probability")[:, 1], 1 / (1 + np.exp(-raw)), rtol=1e-8)


def test_boosting_refuses_infinities_and_ragged_rows(spark):
    for bad in ([[1.0], [float("inf")]], [[1.0], [1.0, 2.0]], [[1.0], None]):
        with pytest.raises(Exception, match="features must be"):
            HistGradientBoostingRegressor(max_iter=1).fit(spark.createDataFrame([(b, 1.0) for b in bad], "features array<double>, label double").coalesce(1))


def test_many_centres_are_one_matrix(spark):
    """500 centres of 64 features: assigned and measured as by numpy, without an expression for each."""
    rng = np.random.default_rng(13)
    x, centers = rng.normal(size=(2000, 64)), rng.normal(size=(500, 64))
    centers[7] = centers[3]
    m = KMeans(500, init=centers, max_iter=1)
    m.cluster_centers_, m.n_features_in_ = centers, 64
    df = frame(spark, x)
    d = np.sqrt(((x[:, None] - centers[None]) ** 2).sum(axis=2))
    assert (column(m.predict(df), "prediction") == d.argmin(axis=1)).all()
    assert np.allclose(np.array(column(m.transform(df), "distances").tolist()), d) and m.predict(df.limit(0)).count() == 0
    assert "zip_with" not in m.predict(df)._jdf.queryExecution().toString()
    assert np.isclose(m.inertia(df), (d.min(axis=1) ** 2).sum())
