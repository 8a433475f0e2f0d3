"""All pairs without copies of blocks, each pair of one table measured once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import blocks, neighbors
from brindle.operators.metric import distances
from brindle.plans import catalog


def frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", neighbors.METRICS)
def test_all_pairs_of_one_table_and_of_two(spark, monkeypatch, metric):
    monkeypatch.setattr(blocks, "RIGHT", 60)
    x = np.random.default_rng(0).normal(size=(101, 3))
    df, other = frame(spark, x), frame(spark, x[:37] + 0.5, 1000)
    for right, y, first in ((df, x, 0), (other, x[:37] + 0.5, 1000)):
        found = neighbors.pairwise(df, right, metric)
        # Blocks are neither dealt out again nor broadcast.
        assert "CartesianProduct" in plan(found) and "Exchange" not in plan(found)
        rows = [(r.left_id, r.right_id - first, r.distance) for r in found.collect()]
        got = np.full((len(x), len(y)), np.nan)
        for i, j, d in rows:
            got[i, j] = d
        assert len(rows) == got.size and np.allclose(got, distances(x, y, metric), rtol=0, atol=1e-12)


def test_a_pair_of_blocks_is_measured_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEFT", 60)
    monkeypatch.setattr(blocks, "RIGHT", 60)
    df = frame(spark, np.random.default_rng(1).normal(size=(120, 3)))
    calls = spark.sparkContext.accumulator(0)
    step = lambda ids, x, own, y, turned: calls.add(len(ids) * len(own)) or iter(())
    assert blocks.meet(df, df, 3, step, "id long").count() == 0
    # Less than all 14,400: half, and what blocks have with themselves.
    assert 120 * 121 / 2 <= calls.value < 0.8 * 120 * 120


def test_tiles_hold_every_pair_twice():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (8, 8), (9, 23), (16, 5), (3, 40)):
        ids, own, dist = np.arange(n), np.arange(100, 100 + m), rng.random((n, m))
        rows = [t for cols in neighbors._turned(ids, own, dist) for t in zip(*(c.ravel().tolist() for c in cols), strict=True)]
        want = [(i, 100 + j, dist[i, j]) for i in range(n) for j in range(m)]
        assert sorted(rows) == sorted(want + [(j, i, d) for i, j, d in want])


def test_quick_rounding_is_that_of_decimals(spark):
    rng = np.random.default_rng(3)
    values = [0.0, -0.0, -1e-16, 5e-7, 0.0078125, 1.0078125, 2.5, 1e-300, 123456.0078125, 1e8 + 1 / 128, 5e9, 1e300, -3.0078125, float("inf"), float("nan"), None, *rng.gamma(2, 1, 1000).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(catalog.quick(F.col("v")).alias("a"), catalog.r("v").alias("b")).collect()
    assert all(repr(r.a) == repr(r.b) for r in got)


def test_working_sets_are_solved_beside_each_other(spark):
    from brindle.operators import shared
    from brindle.operators.svm import SVC

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(400, 8)), (rng.random(400) < 0.5).astype(int)
    df = frame(spark, x).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "id long, label int"), "id")
    staged = len(shared._staged)
    parts, whole = SVC(tol=1e-4, block=40).fit(df), SVC(tol=1e-4).fit(df)
    # 35 rounds of one set each before; a round's tables don't outlive it, but for the support vectors.
    assert parts.converged_ and parts.n_iter_ < 25 and whole.n_iter_ == 1 and len(shared._staged) == staged + 2
    z = [np.array([r.decision for r in m.decision_function(df).orderBy("id").collect()]) for m in (parts, whole)]
    assert np.abs(z[0] - z[1]).max() < 1e-3
    assert np.all(np.abs(np.concatenate(parts.dual_coef_)) <= 1.0 + 1e-9) and abs(sum(c.sum() for c in parts.dual_coef_)) < 1e-8


def by_all(x, eps, min_samples):
    near = distances(x, x, "sqeuclidean") <= eps * eps
    core = near.sum(axis=1) >= min_samples
    label, n = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        todo = [i] if label[i] < 0 else []
        while todo:
            if label[j := todo.pop()] < 0:
                label[j] = n
                todo += np.flatnonzero(near[j] & core).tolist()
        n = label.max() + 1
    for i in np.flatnonzero(~core):
        if (near[i] & core).any():
            label[i] = label[np.flatnonzero(near[i] & core)[0]]
    return [(i, int(label[i]), bool(core[i])) for i in range(len(x))]


@pytest.mark.parametrize(("min_samples", "first", "sparse"), [(4, 10, 4), (4, 10**6, 0.5), (1, 10, 4)])
def test_points_alone_in_cells_are_joined_without_a_list_of_pairs(spark, monkeypatch, min_samples, first, sparse):
    from brindle.operators import density, metric

    monkeypatch.setattr(density, "FIRST", first)
    monkeypatch.setattr(density, "SOME", 3)
    monkeypatch.setattr(metric, "RIGHT", 200)
    monkeypatch.setattr(metric, "EDGES", 50)
    monkeypatch.setattr(metric, "SPARSE", sparse)
    monkeypatch.setattr(metric, "within", None)
    x = np.random.default_rng(6).random((200, 5)) * np.array([2.0, 1, 1, 1, 1])
    found = density.clusters(frame(spark, x), 0.33, min_samples)
    assert sorted((r.id, r.cluster, r.is_core) for r in found.collect()) == by_all(x, 0.33, min_samples)


@pytest.mark.parametrize(("min_samples", "first"), [(4, 10), (2, 10**6), (1, 10)])
def test_cells_of_a_few_points_send_nothing_about(spark, monkeypatch, min_samples, first):
    from brindle.operators import density, metric

    monkeypatch.setattr(density, "FIRST", first)
    monkeypatch.setattr(density, "SOME", 3)
    monkeypatch.setattr(metric, "RIGHT", 200)
    sent, meet = [], density._meet
    monkeypatch.setattr(density, "_meet", lambda s, *a: sent.append(s.where("of is not null").count() if a[-1] != "u long, v long" else 0) or meet(s, *a))
    rng = np.random.default_rng(8)
    x = rng.random((150, 5)) * np.array([2.0, 1, 1, 1, 1])
    x = np.vstack([x, x[:30] + 1e-6, np.repeat(x[40:43], 6, axis=0), x[41] + rng.normal(size=(8, 5)) * 0.01, np.full((3, 5), 9.0)])
    found = density.clusters(frame(spark, x), 0.33, min_samples)
    assert sorted((r.id, r.cluster, r.is_core) for r in found.collect()) == by_all(x, 0.33, min_samples) and not any(sent)


def test_stars_reach_what_edges_reach():
    from brindle.operators.metric import stars

    rng = np.random.default_rng(7)
    for n in (0, 1, 30, 60, 200):
        u, v = rng.integers(0, 60, (2, n)) * 10
        least = {int(i): int(i) for i in {*u.tolist(), *v.tolist()}}
        for _ in range(60):
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                least[a] = least[b] = min(least[a], least[b])
        got = dict(zip(*stars(u, v).tolist(), strict=True))
        assert got == {a: b for a, b in least.items() if a != b}
