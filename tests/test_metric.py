"""The screen by which most pairs of a metric search are ruled out in single precision."""

import numpy as np
import pytest

from brindle.operators import metric as M

METRICS = ("euclidean", "sqeuclidean", "manhattan", "cosine")


def _all(x, y, metric):
    """Every distance in double precision, in the order in which pairs are measured."""
    return M._between(np.repeat(x, len(y), axis=0), np.tile(y, (len(x), 1)), metric).reshape(len(x), len(y))


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize(("offset", "scale"), [(0, 1), (1e6, 1), (0, 1e-20), (0, 1e20), (3, 1e-3)])
def test_a_screen_loses_no_pair(metric, offset, scale):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 7)) * scale + offset
    y = np.vstack([rng.normal(size=(500, 7)) * scale + offset, x[:50]])
    d = _all(x, y, metric)
    tenth = np.sort(d, axis=1)[:, 9]
    given = np.where(np.arange(60) < 5, np.inf, tenth)
    i, j, found = M.Screen(x, metric).close(np.arange(60), y, given, 10)
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    assert set(zip(*(c.tolist() for c in np.nonzero(d <= tenth[:, None])), strict=True)) <= got
    assert np.array_equal(found, d[i, j]) or np.allclose(found, d[i, j], rtol=1e-15)


@pytest.mark.parametrize("metric", METRICS)
def test_few_pairs_are_measured_in_double_precision(metric, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2000, 64)), rng.normal(size=(8000, 64))
    measured = []
    between, full = M._between, M.distances
    monkeypatch.setattr(M, "_between", lambda a, b, m: measured.append(len(a)) or between(a, b, m))
    at = M.Space(x[:1], metric)
    best = M._Best(at, 5, np.arange(2000), x, np.full(2000, np.inf), None)
    r = at.away(y)[:, 0]
    order = np.argsort(r)
    monkeypatch.setattr(M, "distances", lambda a, b, m: measured.append(len(a) * len(b) if len(b) > 1 else 0) or full(a, b, m))
    best.meet(0, order.astype(np.int64), y[order], r[order])
    assert sum(measured) < 0.02 * 2000 * 8000
    some = _all(x[:50], y, metric)
    assert np.array_equal(best.i[:50], np.argsort(some, axis=1, kind="stable")[:, :5])


def test_manhattan_by_bytes(monkeypatch):
    """Near rows are found by codes without single precision, none is lost, whatever the ranges, outliers and offsets."""
    rng = np.random.default_rng(11)

    def check(x, y, worst):
        i, j, dist = M.Screen(x, "manhattan").close(np.arange(len(x)), y, worst)
        want = M.distances(x, y, "manhattan")
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(c.tolist() for c in np.nonzero(want <= worst[:, None])), strict=True))
        assert np.array_equal(dist, want[i, j])

    for d in (1, 3, 64, 1100):
        for scale, offset in ((1.0, 0.0), (1e-3, 1e6), (1e20, 0.0), (10.0 ** rng.integers(-6, 6, d), 0.0)):
            x, y = (rng.normal(size=(n, d)) * scale + offset for n in (70, 90))
            y[:5], y[5:8], x[3] = x[:5], x[:3] + np.asarray(scale) * 1e-9, x[3] * 1e3
            every = np.sort(M.distances(x, y, "manhattan"), axis=1)
            for rank in (0, 2, 89):
                check(x, y, every[:, rank])
            check(x, y, every[:, 2] * (1 - 1e-15))
    check(np.ones((1, 4)), np.ones((3, 4)), np.zeros(1))
    x, y = (rng.normal(size=(n, 64)) for n in (100, 3000))
    monkeypatch.setattr(M.Screen, "_scores", None)
    check(x, y, np.sort(M.distances(x, y, "manhattan"), axis=1)[:, 4])
