"""Dual-tree top-k against all inner products, on clustered vectors with ties."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from brindle.llm import topk

from .conftest import sf


def brute(ids, v, k):
    out = set()
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        by = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out |= {(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(by)}
    return out


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf()}/embeddings.parquet'")
    got = {tuple(r) for r in topk.op7_dual_tree_top_k(spark, sf()).collect()}
    assert got == set(con.sql(topk.OP7_SQL).fetchall())


def test_clusters_ties_and_pruning():
    rng = np.random.default_rng(0)
    centers = rng.normal(0, 30, (12, 8))
    v = np.floor(centers[rng.integers(0, 12, 1500)] + rng.normal(0, 1, (1500, 8)))
    v[200:500] = v[0]
    ids = rng.permutation(1500)
    tree = topk.CoverTree.build(ids, v)
    assert len(tree.radius) > 12
    for i in range(len(tree.radius)):
        d = np.sqrt(((tree.vectors[tree.first[i] : tree.last[i]] - tree.centers[i]) ** 2).sum(axis=1))
        assert d.max() <= tree.radius[i] + 1e-9
    q = ids % 20 == 0
    best = topk.Best(topk.CoverTree.build(ids[q], v[q]), 20)
    seen, pruned, done = topk.search(best, tree)
    assert seen > pruned > 0 and done < 0.7 * q.sum() * 1500
    got = {(int(a), r + 1, int(b), int(s)) for a, row, sc in zip(best.queries.ids, best.ids, best.scores, strict=True) for r, (b, s) in enumerate(zip(row, sc, strict=True))}
    assert got == brute(ids, v, 20)


def test_every_node_is_split(spark):
    """On the real table, whose vectors are spread evenly: centres further apart than what they cover, and real levels."""
    rows = topk.quantized(spark.read.parquet(f"{sf('sf0.1')}/embeddings.parquet"))
    blocks = topk.index(topk.placed(rows, topk.pivots(rows))).collect()
    assert sum(len(b.ids) for b in blocks) == 2000 and max(len(b.radius) for b in blocks) > 20
    for b in blocks:
        v = np.frombuffer(b.vectors).reshape(len(b.ids), b.dim)
        for i in range(len(b.radius)):
            assert b.children[i] or b.last[i] - b.first[i] <= topk.LEAF or b.radius[i] == 0
            under = range(b.child[i], b.child[i] + b.children[i])
            assert all(b.radius[j] <= b.radius[i] + 1e-9 for j in under)
            centers = v[[b.center[j] for j in under]]
            apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2))
            assert not len(centers) or apart[~np.eye(len(centers), dtype=bool)].min() >= max(b.radius[j] for j in under) - 1e-9


def test_large_components(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (90, 5)) * 10.0 ** rng.integers(0, 13, (90, 1))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    whole = [[int(np.floor(64 * x)) for x in r] for r in v.tolist()]
    want = set()
    for q in range(0, 90, 20):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in enumerate(whole) if i != q)[:20]
        want |= {(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scores)}
    got = {tuple(r) for r in topk.top_k(topk.quantized(df), F.col("id") % 20 == 0, 20).collect()}
    assert {g[:2] + g[3:] for g in got} == {w[:2] + w[3:] for w in want}
    small = {w for w in want if abs(w[3]) < 2**63 - 1}
    assert small <= got


def test_pairs_of_blocks_are_pruned(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 1, (8, 8))
    v = centers[rng.integers(0, 8, 6000)] * rng.uniform(0.9, 1.1, (6000, 1)) + rng.normal(0, 0.02, (6000, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK", 128)
    met, real = [], topk._searched
    monkeypatch.setattr(topk, "_searched", lambda pairs, *a: met.append(pairs.count()) or real(pairs, *a))
    rows = topk.quantized(df)
    monkeypatch.setattr(topk, "WAVE", 1)
    got = {tuple(r) for r in topk.top_k(rows, F.col("id") % 2 == 0, 20).collect()}
    blocks = -(-3000 // 128), -(-6000 // 128)
    assert len(met) == 2 and sum(met) < 0.6 * blocks[0] * blocks[1]
    assert {g for g in got if g[0] % 20 == 0} == brute(np.arange(6000), np.floor(64 * v), 20)


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(0))
    got = sorted(map(tuple, topk.top_k(topk.quantized(df), F.col("id") % 20 == 0, 20).collect()))
    assert [g[:3] for g in got] == [(0, 1, 5), (0, 2, 5), (0, 3, 20), (20, 1, 0), (20, 2, 5), (20, 3, 5), (40, 1, 7)]
    assert topk.top_k(topk.quantized(df.limit(0)), F.col("id") % 20 == 0, 20).count() == 0


def test_several_waves(spark, monkeypatch):
    rows = topk.quantized(spark.read.parquet(f"{sf()}/embeddings.parquet"))
    whole = sorted(map(tuple, topk.top_k(rows, F.col("id") % 2 == 0, 5).collect()))
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "WAVE", 2)
    assert sorted(map(tuple, topk.top_k(rows.repartition(3), F.col("id") % 2 == 0, 5).collect())) == whole


def test_nodes_that_no_bound_tells_apart_are_multiplied_as_a_whole(monkeypatch):
    """Evenly spread vectors: a few large products, not one for each pair of small leaves; the results are those of all pairs."""
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(4000, 64)) * 64)
    queries = topk.CoverTree.build(np.arange(500), x[:500])
    best, steps, real = topk.Best(queries, 5), [], topk.Best.offer
    monkeypatch.setattr(topk.Best, "offer", lambda self, *a: steps.append(1) or real(self, *a))
    for at in range(0, len(x), 1000):
        before = len(steps)
        topk.search(best, topk.CoverTree.build(np.arange(at, at + 1000), x[at : at + 1000]))
        assert not at or len(steps) - before <= 20
    ids, others, scores = (np.concatenate(c) for c in zip(*best.results(), strict=True))
    got = {}
    for q, o, s in zip(ids.tolist(), others.tolist(), scores.tolist(), strict=True):
        got.setdefault(q, []).append((-s, o))
    products = x[:500] @ x.T
    for q in range(500):
        assert got[q] == sorted((-int(products[q, o]), o) for o in range(len(x)) if o != q)[:5]
