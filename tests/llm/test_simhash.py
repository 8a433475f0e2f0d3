"""Golay linking against all pairs, fingerprints against a plain loop."""

import random

import numpy as np
import pytest
import xxhash

from brindle.llm import simhash

from .conftest import AWKWARD, sf


def plain(text, k=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(prints):
    """{id: smallest id reachable} over {id: fingerprint}."""
    ids = sorted(prints, key=lambda i: (i is None, i))
    f = np.array([prints[i] for i in ids], np.uint64)
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= 3).tolist():
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return {ids[i]: ids[label[i]] for i in range(len(ids))}


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf('sf0.01')}/documents.parquet").collect()}
    rows = simhash.op5_golay_simhash(spark, sf("sf0.01")).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for i in list(texts)[:150]:
        assert prints[i] == plain(texts[i])
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints)


def test_links_between_random_close_fingerprints(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        prints.add(f)
        for _ in range(rng.choice([1, 2, 30])):
            g = f
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 5])):
                g ^= 1 << b
            prints.add(g)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in prints], "node long")
    got = simhash.connected_components(simhash.link_exact(df)).collect()
    number = {int(np.uint64(f).view(np.int64)): i for i, f in enumerate(prints)}
    expected = brute_components(dict(enumerate(prints)))
    groups = {}
    for r in got:
        groups.setdefault(r.component, []).append(number[r.id])
    found = {i: min(g) for g in groups.values() for i in g}
    assert all(found.get(i, i) == c for i, c in expected.items())


def test_golay_keys():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 2000)
    keys, more = simhash.golay_keys(x)
    assert abs(more.mean() - 1771 / 2048) < 0.04
    y = x ^ (1 << rng.integers(0, 23, 2000))
    other, also = simhash.golay_keys(y)
    for i in range(2000):
        assert keys[i, 0] in (other[i] if also[i] else other[i, :1])


def test_long_run_is_searched_in_steps():
    rng = np.random.default_rng(3)
    f = np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 20, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 400).astype(np.uint64))
    f = np.unique(f)
    a, b = simhash._links(np.zeros(len(f), np.int64), np.arange(len(f)), f[:, None], 3)
    label = brute_components(dict(enumerate(f.tolist())))
    assert len(a) == len(f) - len(set(label.values()))
    assert np.bincount(np.concatenate([a, b])).max() <= 3


def test_awkward(awkward, empty):
    assert simhash.components(empty).count() == 0
    rows = simhash.components(awkward).collect()
    assert len(rows) == len(AWKWARD) + 2
    by = {r.id: r.component_id for r in rows}
    assert by[0] == by[1] == by[2] == 0 and by[4] == by[5] == 4 and by[None] is None
    kept = {r.doc_id for r in simhash.keep_one(awkward).collect()}
    assert kept == {None, 0, 3, 4, 6, 7, 8}
    assert simhash.simhash([b"a b c d " * 200_000], 3)[0, 0] == simhash.simhash([b"a b c d " * 200_000], 3, 2)[0, 0]


def test_similar_texts_are_found(spark):
    rng = random.Random(8)
    rows, pairs = [], 60
    for i in range(pairs):
        w = [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(400)]
        v = list(w)
        for k in rng.sample(range(400), 3):
            v[k] = "changed"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.similar_components(docs).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(pairs)) >= 0.95 * pairs
    assert all(c in (i, i - 1) for i, c in got.items())


def cosine(a, b):
    return len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else float(a == b)


def test_similar_components_against_all_pairs(spark):
    """Every document of the small table against every other: no wrong join, nine in ten of the links between different texts at least."""
    docs = spark.read.parquet(f"{sf('sf0.01')}/documents.parquet")
    sets = {r.doc_id: set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in docs.collect()}
    ids, holders = sorted(sets), {}
    for i in ids:
        for h in sets[i]:
            holders.setdefault(h, []).append(i)
    near = {(a, b) for x in holders.values() for b in x for a in x if a < b and cosine(sets[a], sets[b]) >= 0.8}
    label = {i: i for i in ids}
    for a, b in sorted(near):
        if label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if c == high else c for i, c in label.items()}
    got = {r.id: r.component_id for r in simhash.similar_components(docs).collect()}
    blank = {i for i in ids if not sets[i]}
    assert all(label[got[i]] == label[i] for i in set(ids) - blank) and len({got[i] for i in blank}) <= 1
    different = [(a, b) for a, b in near if sets[a] != sets[b]]
    assert len(different) > 20 and sum(got[a] == got[b] for a, b in different) >= 0.9 * len(different)
    assert all(got[a] == got[b] for a, b in near if sets[a] == sets[b])


def passages(rng, n, words=200, cut=14):
    """A base text and ``n`` texts with one passage of it replaced: each is near the base, hardly any two are near each other."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    texts = [" ".join(base)]
    for i in range(n):
        at = rng.randrange(words - cut)
        texts.append(" ".join([*base[:at], *(f"n{i}x{k}" for k in range(cut)), *base[at + cut :]]))
    return texts


def test_large_group_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DEALT", 64)
    texts = passages(random.Random(5), 1500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    calls, real = [], simhash._across
    monkeypatch.setattr(simhash, "_across", lambda *a: calls.append(a) or real(*a))
    got = [r.component_id for r in simhash.similar_components(docs, hot=4).collect()]
    assert calls and got.count(0) >= 0.97 * len(texts)
    # Few edges for each member, never all pairs.
    edges = simhash._proposals(np.zeros(len(texts), np.int64), np.arange(len(texts)), simhash.simhash([t.encode() for t in texts], 5, simhash.LANES, distinct=True), simhash.bits_for(0.8))
    assert len(edges[0]) <= (1 + simhash.HUBS) * len(texts)


def test_hot_keys_lose_no_exact_link(spark):
    rng = np.random.default_rng(9)
    base = np.uint64(0x0123456789ABCDEF)
    f = [base]
    for _ in range(4000):
        g = f[rng.integers(0, len(f))]
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            g = g ^ (np.uint64(1) << np.uint64(b))
        f.append(g)
    f = np.unique(np.array(f, np.uint64))[::2]
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "node long")
    assert simhash._hot(df, lambda x: simhash._exact_keys(x[:, 0]), ["node"], 2) is not None
    number = {int(x): i for i, x in enumerate(f.view(np.int64))}
    expected = brute_components(dict(enumerate(f.tolist())))
    for hot in (2, 10**9):
        groups = {}
        for r in simhash.connected_components(simhash.link_exact(df, hot)).collect():
            groups.setdefault(r.component, []).append(number[r.id])
        found = {i: min(g) for g in groups.values() for i in g}
        assert all(found.get(i, i) == c for i, c in expected.items())


def test_filing_runs_in_as_many_tasks_as_a_shuffle(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = spark.range(50_000).selectExpr("xxhash64(id) AS node").distinct()
    filed = simhash._file(nodes, lambda f: simhash._exact_keys(f[:, 0]), ["node"], [])
    assert filed.rdd.getNumPartitions() == n


def templated(rng, pairs, shared, own, replaced):
    """Pairs of texts near 0.8, all with one template in common that makes any two of them nearly as alike."""
    template = [f"t{k}" for k in range(shared)]
    texts = []
    for i in range(pairs):
        w = [*template, *(f"o{i}x{k}" for k in range(own))]
        at = rng.randrange(len(w) - replaced + 1)
        texts += [" ".join(w), " ".join([*w[:at], *(f"r{i}x{k}" for k in range(replaced)), *w[at + replaced :]])]
    return texts


def linked(texts, similarity=0.8):
    """Components over all pairs of shingle sets, by an index of shingles; and the pairs."""
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    label, near = list(range(len(texts))), []
    for a in range(len(texts)):
        for b in range(a):
            if cosine(sets[a], sets[b]) >= similarity - 1e-12:
                near.append((b, a))
                x, y = sorted((label[a], label[b]))
                if x != y:
                    label = [x if c == y else c for c in label]
    return label, near


@pytest.mark.parametrize("shared,own,replaced,hot", [(150, 50, 33, simhash.HOT), (27, 13, 3, simhash.HOT), (140, 60, 33, simhash.HOT), (150, 50, 33, 4)])
def test_pairs_of_one_template(spark, monkeypatch, shared, own, replaced, hot):
    """However many texts share a template, pairs within are found, and no two texts are joined that links don't join."""
    monkeypatch.setattr(simhash, "DEALT", 64)
    pairs = 200
    texts = templated(random.Random(shared + hot), pairs, shared, own, replaced)
    label, near = linked(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.id: r.component_id for r in simhash.similar_components(docs, hot=hot).collect()}
    assert len(near) >= 0.6 * pairs and all(label[got[i]] == label[i] for i in got)
    assert sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near)


def test_prefixes_meet_every_pair(spark):
    """Sets of many sizes over a template, at several similarities: no pair of different components is missing, and few others come."""
    rng = random.Random(11)
    common_ = list(range(1, 60))
    sets = [sorted({*rng.sample(common_, rng.randrange(5, 59)), *rng.sample(range(100, 400), rng.randrange(0, 60))}) for _ in range(250)]
    sets += [sorted({*x[: len(x) - rng.randrange(0, len(x) // 3)], 1000 + i}) for i, x in enumerate(sets[:120])]
    df = spark.createDataFrame([(i, i // 2, x) for i, x in enumerate(sets)], "node long, component long, shingles array<long>")
    for similarity in (0.6, 0.8, 0.95, 1.0):
        met = {tuple(sorted((r.a, r.b))) for r in simhash._met(df, similarity).collect()}
        near = {(b, a) for a in range(len(sets)) for b in range(a) if a // 2 != b // 2 and cosine(set(sets[a]), set(sets[b])) >= similarity - 1e-12}
        assert near <= met and (similarity < 0.95 or len(met) <= 5 * len(sets))
        assert all(a // 2 != b // 2 for a, b in met)


def test_a_group_of_copies_makes_no_pairs_by_shingles(spark):
    """One component shares its shingles with itself only: nothing is met, whatever its size."""
    df = spark.createDataFrame([(i, 0, list(range(i % 3, 100))) for i in range(3000)], "node long, component long, shingles array<long>")
    assert simhash._met(df, 0.8).count() == 0


def test_a_long_run_makes_no_more_rows_than_it_has(spark):
    """A row of a long run gives one row: its parent in a tree that joins what is close, or none. Short runs give their close pairs."""
    rng, limit = np.random.default_rng(3), 40
    base = rng.integers(0, 2**63, (3, 4)).astype(np.uint64)
    f = np.repeat(base, (400, 100, 1), axis=0)
    for row in f:
        row[rng.integers(4)] ^= np.uint64(1) << np.uint64(rng.integers(64))
        row[rng.integers(4)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    chain = np.zeros((60, 4), np.uint64)
    for i in range(1, 60):
        chain[i] = chain[i - 1]
        chain[i, i % 4] ^= np.uint64((2**30 - 1) << 10 * (i // 4 % 3))
    f = np.concatenate([f, chain])
    f = f[rng.permutation(len(f))]
    rows = [(5, 5, i, *map(int, x)) for i, x in enumerate(f.view(np.int64))] + [(6, 6, i, *map(int, f.view(np.int64)[i])) for i in range(4)]
    df = spark.createDataFrame(rows, "run long, key long, node long, l0 long, l1 long, l2 long, l3 long")
    got = simhash._searched(df, ["l0", "l1", "l2", "l3"], limit).collect()
    long = [r for r in got if r.key is not None]
    assert sorted(r.a for r in long) == list(range(len(f))) and len(got) <= len(rows) + 6
    up = {r.a: r.b for r in long if r.b is not None}
    assert all(int(np.bitwise_count(f[a] ^ f[b]).sum()) <= limit for a, b in up.items())
    label = {}
    for m in simhash._component_trees(f, limit):
        label |= dict.fromkeys(m.tolist(), int(m[0]))
    roots = {}
    for i in range(len(f)):
        at, steps = i, 0
        while at in up:
            at, steps = up[at], steps + 1
            assert steps <= len(f)
        roots.setdefault(at, set()).add(label.get(i, i))
    assert all(len(x) == 1 for x in roots.values()) and len(roots) == len({label.get(i, i) for i in range(len(f))})
