"""What a worker remembers of words and pieces: what was met again, within a limit."""

import numpy as np

from brindle.llm.wordpool import PieceCache, WordPool


def test_what_is_met_again_outlives_the_limit():
    asked, spelt = [], []

    def encode(pieces):
        spelt.extend(pieces)
        return np.array([ord(c) for p in pieces for c in p], np.int32), np.array([len(p) for p in pieces], np.int64)

    cache = PieceCache(lambda words: [p for w in words for p in (*w.split("-"), "\n")], encode, limit=100)
    pool = WordPool(lambda words: asked.extend(words) or cache(words), limit=60)
    common = [f"often-{c}" for c in "abcde"]
    for k in range(40):
        texts = [" ".join([*common, *(f"once{k}-{i}" for i in range(10 * j, 10 * j + 10))]) for j in range(2)]
        flat, n = pool(texts)
        assert n.tolist() == [sum(len(w.replace("-", "")) for w in t.split()) for t in texts]
        assert "".join(map(chr, flat)) == "".join(texts).replace(" ", "").replace("-", "")
        assert len(pool.at) <= 60 and len(cache.at) <= 100
    assert all(asked.count(w) == 1 for w in common)
    assert spelt.count("often") == 1 and spelt.count("7") == 1
