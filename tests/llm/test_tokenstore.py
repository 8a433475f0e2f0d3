"""The store against ids from the tokenizers library; damage is noticed."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import tokenstore
from brindle.llm.bpe import vocabulary

from .conftest import AWKWARD, sf


def expected(texts):
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    return [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_query_equals_library(spark):
    docs = spark.read.parquet(f"{sf('sf0.01')}/documents.parquet").orderBy("doc_id").collect()
    rows = sorted(map(tuple, tokenstore.op3_content_addressed_store(spark, sf("sf0.01")).collect()))
    start = 0
    for d, ids, row in zip(docs, expected([d.text or "" for d in docs]), rows, strict=True):
        assert row == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoder_equals_library():
    """Whole texts of the largest table, every code point up to those that are left to the library, and words of mixed letters."""
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(7)
    _, encode = tokenstore._encoder(vocabulary())
    texts = [t or "" for t in pq.read_table(f"{sf('sf0.1')}/documents.parquet", columns=["text"])["text"].to_pylist()]
    some = [chr(c) for c in range(ord(tokenstore.LATIN) + 0x60)]
    texts += [around.format(c, c) for c in some for around in ("{}", "a{}b", "1{}'S{}", " {}\u0301 ", "!{}?", "A{}\u0327{}B")]
    some += list("'stSTΣσİß\u0301\u0327\u030a 123<|>") + ["<|endoftext|>", "日", "\U0001f600", "ﬁ", "\u2028"]
    texts += ["".join(rng.choices(some, k=rng.randint(1, 30))) for _ in range(20_000)]
    for at in range(0, len(texts), 5_000):
        flat, n = encode(pa.array(texts[at : at + 5_000]))
        want = [x[:-1] for x in expected(texts[at : at + 5_000])]
        assert n.tolist() == [len(x) for x in want]
        assert flat.tolist() == [i for x in want for i in x]


def test_awkward_and_damage(spark, awkward, empty, tmp_path):
    store = str(tmp_path / "a")
    tokenstore.write(awkward, store, vocabulary())
    rows = tokenstore.read(spark, store).orderBy("start").collect()
    assert len(rows) == len(AWKWARD) + 2 and rows[0].doc_id is None
    for r in rows[1:]:
        assert np.frombuffer(r.ids, "<u4").tolist() == expected([AWKWARD[r.doc_id] or ""])[0]
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    bad = str(tmp_path / "b")
    for part in ("chunks", "recipes", "manifest"):
        df = spark.read.parquet(f"{store}/{part}")
        df = df.withColumn("payload", F.concat("payload", F.unhex(F.lit("0000")))) if part == "chunks" else df
        df.write.parquet(f"{bad}/{part}")
    with pytest.raises(Exception, match="address"):
        tokenstore.read(spark, bad).collect()
    worse = str(tmp_path / "c")
    for part in ("chunks", "recipes", "manifest"):
        df = spark.read.parquet(f"{store}/{part}")
        (df.where("start > 0") if part == "recipes" else df).write.parquet(f"{worse}/{part}")
    with pytest.raises(ValueError, match="manifest"):
        tokenstore.read(spark, worse)
    tokenstore.write(empty, str(tmp_path / "e"), vocabulary())
    assert tokenstore.read(spark, str(tmp_path / "e")).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(3)
    shared, table = rng.integers(0, 1000, 3000), tokenstore.gear(1000)
    ids = np.concatenate([rng.integers(0, 1000, 777), shared, shared])
    a, b = tokenstore.cuts(ids, np.array([0, 777 + 3000]), table)
    assert a[-1] == 3777 and b[-1] == 3000
    assert len(set((a - 777).tolist()) & set(b.tolist())) >= len(b) - 3
    for x in (a, b):
        assert np.all(np.diff(x, prepend=0)[:-1] >= tokenstore.SHORTEST) and np.all(np.diff(x, prepend=0) <= tokenstore.LONGEST)


def test_marks_joined_by_shuffle(spark, awkward, tmp_path, monkeypatch):
    rows = []
    for i, most in enumerate((1_000_000, -1)):
        monkeypatch.setattr(tokenstore, "BROADCAST_MARKS", most)
        tokenstore.write(awkward.repartition(5), str(tmp_path / str(i)), vocabulary())
        rows.append(sorted(tuple(r)[1:] for r in tokenstore.read(spark, str(tmp_path / str(i))).collect()))
        chunks = spark.read.parquet(str(tmp_path / str(i)) + "/chunks")
        assert chunks.count() == chunks.select("hash").distinct().count()
    assert rows[0] == rows[1]


def test_pieces_by_the_model_alone():
    """What is cut already goes to the model without the library's normalizer and pattern."""
    from brindle.llm.bpe import library

    whole = library(vocabulary())
    own = tokenstore.merger(whole)
    assert own.normalizer is None and whole.normalizer is not None
    pieces = ["word", "'s", "é", "ß", "...", "<|", "|>", "7", "¤¤", "q" * 300, "�", "\x01\x02", "̀"]
    # Each alone, as the library tells neighbours apart by their kind.
    want = [whole.encode(p, add_special_tokens=False).ids for p in pieces]
    assert own.encode(" ".join(pieces), add_special_tokens=False).ids == [i for x in want for i in x]


def test_known_pieces_are_not_encoded_again():
    from brindle.llm.wordpool import PieceCache

    asked = []

    def encode(new):
        asked.append(new)
        return np.array([len(p) for p in new], np.int32), np.ones(len(new), np.int64)

    cache = PieceCache(lambda words: [x for w in words for x in [*w.split("-"), "\n"]], encode, limit=6)
    for words, ids, n in [(["a-bb", "a"], [1, 2, 1], [2, 1]), (["bb-ccc-ccc"], [2, 3, 3], [3]), (["dddd-a", "eeeee-ffffff", ""], [4, 1, 5, 6, 0], [2, 2, 1])]:
        got = cache(words)
        assert got[0].tolist() == ids and got[1].tolist() == n
    assert asked[:2] == [["a", "bb"], ["ccc"]] and "a" not in asked[2]
