"""The numpy BPE against the tokenizers library, text by text."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brindle.llm import bpe
from brindle.llm.wordpool import PieceCache, WordPool, steps

from .conftest import AWKWARD, sf


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_query_equals_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf('sf0.01')}/documents.parquet").collect()}
    rows = bpe.op6_numpy_bpe(spark, sf("sf0.01")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_random_texts(library):
    rng = random.Random(5)
    letters = ["\u07fd", "\U00011935", "\U00011930", "\u1e9e", "'", "s", "t", "A", "é", "́", "̧", " ", "\n", "1", "!", "<|endoftext|>", "ll", "re", "Σ", "\x1f", "日", "aaa", "\t"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 20_000, "<|startoftext|>" * 9]
    own = bpe.Bpe(bpe.vocabulary())
    pool = WordPool(PieceCache(own.cut, own.merge, limit=400), limit=500)
    for i in range(0, len(texts), 700):
        flat, n = pool(texts[i : i + 700])
        ends = np.cumsum(n)
        for e, k, x in zip(ends, n, library.encode_batch(texts[i : i + 700], add_special_tokens=False), strict=True):
            assert flat[e - k : e].tolist() == x.ids


@pytest.mark.parametrize("around", ["a{}b", "!{}1{}", "{}'S \u0301{}", "\u0345{}\u0301{}\u0334"])
def test_every_code_point_equals_library(library, around):
    """Letters, digits, blanks and cases as in the library's tables, whatever Unicode version Python has."""
    own = bpe.Bpe(bpe.vocabulary())
    pool = WordPool(PieceCache(own.cut, own.merge))
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 100_000):
        texts = [around.format(chr(c), chr(c)) for c in codes[at : at + 100_000]]
        flat, n = pool(texts)
        lists = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in lists]
        assert flat.tolist() == [i for x in lists for i in x]


def test_awkward(awkward, empty, library):
    assert bpe.encode(empty, bpe.vocabulary()).count() == 0
    rows = bpe.encode(awkward, bpe.vocabulary(), decoded=True).collect()
    assert len(rows) == len(AWKWARD) + 2
    for r in rows:
        if r.id is not None:
            assert r.ids == library.encode(AWKWARD[r.id] or "", add_special_tokens=False).ids
    back = {r.id: r.decoded for r in bpe.decode(bpe.encode(awkward, bpe.vocabulary()), bpe.vocabulary()).collect()}
    assert back == {r.id: r.decoded for r in rows}


def test_steps():
    assert list(steps([5, 5, 20, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(steps([], 10)) == []


def test_order_of_merges_is_checked(tmp_path):
    import json

    spec = json.load(open(bpe.vocabulary(), encoding="utf-8"))
    spec["model"]["merges"].reverse()
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="order"):
        bpe.Bpe(str(path))
    assert isinstance(bpe.Bpe(bpe.vocabulary()).decode(pa.array([[0, 1]], pa.list_(pa.int32()))), pa.Array)


def test_each_character_is_asked_about_once(monkeypatch, library):
    """The pattern of unsettled characters is slow, so it sees what characters there are, not the text; one at its end is still found."""
    asked, real = [], bpe.unsettled(bpe.vocabulary())

    class Counting:
        def search(self, text):
            asked.append(len(text))
            return real.search(text)

    monkeypatch.setattr(bpe, "unsettled", lambda path: Counting())
    cut, words = bpe.Bpe(bpe.vocabulary()), ["straße", "naïve", "日本語"] * 2000
    pieces = cut.cut(words)
    assert pieces.count("\n") == len(words) and sum(asked) <= len(set("".join(words))) + 1
    odd = next(chr(i) for i in range(0x300, 0x110000) if real.search(chr(i)))
    ids, n = cut.merge([p for p in cut.cut([*words[:3], f"a{odd}b"]) if p != "\n"])
    assert ids.tolist() == library.encode(" ".join([*words[:3], f"a{odd}b"]), add_special_tokens=False).ids
