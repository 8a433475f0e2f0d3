"""Blocks of data go to groups of query blocks, not to each of them: a table has as many of those as cells."""

import numpy as np
import pytest

from brindle.operators import metric as M
from brindle.operators.neighbors import kneighbors


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_a_data_block_is_sent_to_groups(spark, monkeypatch, metric):
    monkeypatch.setattr(M, "RIGHT", 1_600)
    staged, stage = {}, M.stage
    monkeypatch.setattr(M, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    monkeypatch.setattr(M, "_groups", lambda q, d, cores, whole=M._groups: whole(q, d, 2))
    x = np.random.default_rng(4).normal(size=(1_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = sorted((r.query_id, r["rank"], r.neighbor_id) for r in kneighbors(df, df, 3, metric).collect())
    near = np.argsort(M.distances(x, x, metric), axis=1, kind="stable")[:, :3]
    assert got == [(i, k + 1, int(near[i, k])) for i in range(1_000) for k in range(3)]
    lefts, blocks, sent = staged["queries"].count(), staged["rings"].count(), staged["block-pairs"].count()
    assert lefts > 8 and sent <= 3 * blocks < lefts * blocks / 2
