"""Components within a radius without a list of pairs, DBSCAN of single points, kernels by products."""

import numpy as np

from brindle.operators import density, svm
from brindle.operators.metric import distances
from brindle.plans import catalog


def test_kernel_by_products():
    rng = np.random.default_rng(0)
    for offset in (0.0, 1e3, 1e7):
        a = rng.normal(size=(50, 5)) + offset
        b = np.vstack([rng.normal(size=(30, 5)) + offset, a[:3]])
        want = np.exp(-0.3 * distances(a, b, "sqeuclidean"))
        assert np.allclose(svm.kernel(a, b, 0.3), want, atol=1e-13)
    wide = rng.normal(size=(20, 5)) * 1e6
    assert np.array_equal(svm.kernel(wide, wide, 1.0), np.eye(20))


def test_kernel_takes_no_distances(monkeypatch):
    monkeypatch.setattr(svm, "distances", None)
    x = np.random.default_rng(1).normal(size=(20, 64))
    assert svm.kernel(x, x, 1 / 64).shape == (20, 20)


def test_components_within_a_radius(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.random((150, 2)), [[0.5, 0.5]] * 3])
    df = spark.createDataFrame([(i + 10, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    near = distances(x, x, "sqeuclidean") <= 0.05 * 0.05
    reach = near
    while not np.array_equal(wider := (reach.astype(int) @ near.astype(int)) > 0, reach):
        reach = wider
    want = {i + 10: int(reach[i].argmax()) + 10 for i in range(len(x)) if near[i].sum() > 1}
    monkeypatch.setattr(catalog, "radius_edges", None)
    monkeypatch.setattr(catalog, "embeddings", lambda spark, sf, dims: df)
    monkeypatch.setattr(catalog, "EPS", 0.05)
    assert {r.id: r.component for r in catalog.QUERIES["connected_components"](spark, "").collect()} == want


def test_dbscan_sends_no_single_points_about(spark, monkeypatch):
    x = np.random.default_rng(3).random((120, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    sent, meet = [], density._meet
    monkeypatch.setattr(density, "_meet", lambda s, *a: sent.append(s.count()) or meet(s, *a))
    found = {r.id: (r.cluster, r.is_core) for r in density.clusters(df, 0.3, 4).collect()}
    near = distances(x, x, "sqeuclidean") <= 0.3 * 0.3
    core = near.sum(axis=1) >= 4
    label, n = np.full(120, -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = n
                    todo += np.flatnonzero(near[j] & core).tolist()
            n += 1
    for i in np.flatnonzero(~core):
        if len(c := np.flatnonzero(near[i] & core)):
            label[i] = label[c.min()]
    assert found == {i: (int(label[i]), bool(core[i])) for i in range(120)} and n > 0 and (label < 0).any()
    assert not any(sent)


def test_boosting_stores_rows_alike_once(spark, monkeypatch):
    from brindle.operators import trees

    rng = np.random.default_rng(5)
    x = np.where(rng.random((4000, 2)) < 0.1, np.nan, rng.integers(0, 6, (4000, 2)).astype(float))
    y = np.nan_to_num(x[:, 0]) * 2 + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(size=4000)
    rows = [([float(v) for v in r], float(t), int(t // 10)) for r, t in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "features array<double>, y double, class int")
    monkeypatch.setattr(trees, "KEPT", 1)
    stored, stage = [], trees.stage
    monkeypatch.setattr(trees, "stage", lambda df, name, *a: (lambda s: stored.append(s.count()) or s)(stage(df, name, *a)))
    for model, label in ((trees.HistGradientBoostingRegressor, "y"), (trees.HistGradientBoostingClassifier, "class"), (trees.HistGradientBoostingClassifier, "int(class > 0)")):
        found = []
        for repeats in (4, 10_000):
            monkeypatch.setattr(trees, "REPEATS", repeats)
            stored.clear()
            m = model(max_iter=2, max_leaf_nodes=3).fit(df.selectExpr("features", f"{label} as label"))
            found.append([t for row in m.trees_ for t in row])
            assert len(stored) == 2 and all(n == 4000 if repeats > 4 else n < 500 for n in stored)
        for a, b in zip(*found, strict=True):
            assert (a.feature, a.threshold, a.left, a.missing_left) == (b.feature, b.threshold, b.left, b.missing_left)
            assert np.allclose(a.value, b.value, atol=1e-9)
