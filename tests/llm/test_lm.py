"""Scores against a plain trie and plain counts; probabilities add up to one."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from brindle.llm import lm

from .conftest import AWKWARD, sf


def words(t):
    return (t or "").encode().lower().split()


class PlainTrie:
    """Prediction by partial matching, one byte at a time."""

    def __init__(self, docs, order, least):
        self.order = order
        full = [defaultdict(Counter) for _ in range(order + 1)]
        for w in docs:
            s = lm.END * order + b" ".join(w) + lm.END
            for i in range(order, len(s)):
                for k in range(order + 1):
                    full[k][s[i - k : i]][s[i]] += 1
        self.total = [{c: sum(x.values()) for c, x in level.items()} for level in full]
        self.kept = [{c: y for c, x in level.items() if (y := {b: n for b, n in x.items() if n >= least})} for level in full]

    def log10(self, context, byte):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            c = context[len(context) - k :]
            if c not in self.kept[k]:
                continue
            here = {b: n for b, n in self.kept[k][c].items() if b not in excluded}
            dropped = self.total[k][c] - sum(self.kept[k][c].values())
            escape = dropped + len(here) / 2
            if not escape:
                continue
            den = sum(here.values()) + dropped
            if byte in here:
                return out + math.log10((here[byte] - 0.5) / den)
            out += math.log10(escape / den)
            excluded |= set(here)
        return out - math.log10(256 - len(excluded))

    def score(self, w):
        s = lm.END * self.order + b" ".join(w) + lm.END
        return sum(self.log10(s[i - self.order : i], s[i]) for i in range(self.order, len(s)))


def plain(docs, order, resolution):
    train = [words(t) for i, t in docs if crc32(str(i).encode()) % 7 != 2]
    count = Counter(x for w in train for x in w)
    n, v = sum(count.values()) + len(train), len(count) + (len(train) > 0)
    size = sum(max(1, len(b" ".join(w)) + 1) for w in train)
    trie = PlainTrie(train, order, max(1, -(-size // resolution)))
    for i, t in docs:
        w = words(t)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        yield i, crc32(str(i).encode()) % 7 == 2, len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, base, trie.score(w)


@pytest.mark.parametrize("resolution", [1 << 20, 300])
def test_scores_equal_plain_trie(spark, resolution):
    docs = [(r.doc_id, r.text[:300]) for r in spark.read.parquet(f"{sf()}/documents.parquet").limit(60).collect()] + [(1000, "new words: zzz qqq"), (1001, ""), (1002, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: tuple(r) for r in lm.score(df, order=3, resolution=resolution).collect()}
    for e in plain(docs, 3, resolution):
        assert got[e[0]][:5] == e[:5]
        assert got[e[0]][5:] == pytest.approx(e[5:], rel=1e-9)


def test_probabilities_add_up(spark):
    df = spark.createDataFrame([("abracadabra abra",), ("banana bandana",)], "text string")
    trie = lm.Trie(lm.gather(lm.counts(df, 2), 2, 20), 2)
    for context in (b"ab", b"an", b"zz", b"\xff\xff", b"ra"):
        keys = np.array([(context[0] << 16) | (context[1] << 8) | b for b in range(256)], np.uint64)
        assert (10 ** trie.score(keys)).sum() == pytest.approx(1)


def test_query_beats_base_on_held_out(spark):
    rows = lm.op4_ppm_score(spark, sf("sf0.1")).collect()
    assert len(rows) == 10_000
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_awkward(awkward, empty):
    assert lm.score(empty).count() == 0
    rows = lm.score(awkward).collect()
    assert len(rows) == len(AWKWARD) + 2 and all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    untrained = lm.score(awkward.where("doc_id in (3)"), train=lm.F.lit(False)).collect()
    assert untrained[0].score == pytest.approx(-4 * math.log10(256)) and untrained[0].base_score == 0


@pytest.mark.parametrize("shared", [1 << 22, 50])
def test_whole_trie_whatever_is_broadcast(spark, monkeypatch, shared):
    """Rare contexts stay in the trie when the bounds of what is broadcast and scored at once are small."""
    monkeypatch.setattr(lm, "SHARED", shared)
    monkeypatch.setattr(lm, "RESOLUTION", shared)
    monkeypatch.setattr(lm, "CHUNK", 100)
    docs = [(r.doc_id, r.text[:300]) for r in spark.read.parquet(f"{sf()}/documents.parquet").limit(60).collect()] + [(1000, "new words: zzz qqq"), (1001, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: tuple(r) for r in lm.score(df).collect()}
    for e in plain(docs, 5, 1 << 40):
        assert got[e[0]][:5] == e[:5]
        assert got[e[0]][5:] == pytest.approx(e[5:], rel=1e-9)


def test_rare_contexts_of_a_large_corpus(spark):
    """Strings with less than one in 2^20 of the training bytes are learnt too."""
    docs = [(0, "ab cd " * 400_000), (1, "zebra quagga")]
    got = {r.id: r.score for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), train=lm.F.lit(True)).collect()}
    assert got[1] == pytest.approx(PlainTrie([words(t) for _, t in docs], 5, 1).score(words(docs[1][1])), rel=1e-9)


def test_query_equals_plain_trie(spark):
    """The query itself, order 5, on every whole text of the smallest table."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf()}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in lm.op4_ppm_score(spark, sf()).collect()}
    want = list(plain(docs, 5, 1 << 60))
    assert len(got) == len(want) == len(docs)
    for e in want:
        assert got[e[0]][:5] == e[:5]
        assert got[e[0]][5:] == pytest.approx(e[5:], rel=1e-9)
