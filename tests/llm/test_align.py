"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from brindle.llm import align
from brindle.llm.bpe import byte_letters, vocabulary

from .conftest import AWKWARD, sf

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """A text's groups [(ids of A, ids of B)], by whole texts and sets of ends."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {x: i for i, x in enumerate(byte_letters())}

    def of_a(i):
        return bytes(byte_of[x] for x in a.id_to_token(i))

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.IsByte(i) else p.replace("▁", " ").encode()

    def run(text):
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if b"".join(map(of_a, x)) != (" " + text).encode() or b"".join(map(of_b, y)) != (" " + text).encode():
            return []
        ends_x, ends_y = np.cumsum([len(of_a(i)) for i in x]), np.cumsum([len(of_b(i)) for i in y])
        both = sorted(set(ends_x.tolist()) & set(ends_y.tolist()))
        out, i, j = [], 0, 0
        for e in both:
            k, m = int(np.searchsorted(ends_x, e)) + 1, int(np.searchsorted(ends_y, e)) + 1
            out.append((x[i:k], y[j:m]))
            i, j = k, m
        return out

    return run


def expected(docs, plain):
    """Rows of the query for [(id, text)]."""
    found = [(i, plain(t)) for i, t in docs]
    links = [Counter((p, q) for x, y in g for p in x for q in y) for _, g in found]
    count = Counter(k for c in links for k in c)
    most = Counter()
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    out = []
    for (i, g), c in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for k, n in c.items() if count[k] == most[k[0]])
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), best, sum(n * count[k] for k, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


KEY = lambda r: (str(r[0]), *r[1:])


def test_query_equals_plain_version(spark, plain):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf('sf0.01')}/documents.parquet").collect()]
    got = align.op12_token_alignment(spark, sf("sf0.01"))
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(expected(docs, plain), key=KEY)


TEXTS = [
    *AWKWARD,
    " ",
    "  ",
    " a",
    "a ",
    "a  b",
    "a   b \n c\n d \t e",
    "a  b　 c  d\x85 e\x1c f",
    "x▁y",
    "▁",
    "fine words then x▁y and more",
    "<|endoftext|> <s> </s> <unk> <0x41> <|endoftext|>",
    "it's we'll I'd 's 'll  's",
    "a" * 5000,
    "ab" * 3001 + " " + "=" * 777,
    "नमस्ते 你好世界 \U0001f468‍\U0001f469‍\U0001f467 é",
    "\r\n\r\n def f(x):\r\n    return x\r\n",
    "\x00 \x00a \x7f",
]


def test_awkward_texts_and_every_threshold(spark, plain):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[4], 1, "x"), (None, "no id", 1, "x"), (4, TEXTS[4], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pair string")
    want = sorted(expected([r[:2] for r in rows], plain), key=KEY)
    for resolution in (1, 300, align.RESOLUTION):
        assert sorted(map(tuple, align.link_counts(docs, A, B, resolution=resolution).collect()), key=KEY) == want


def test_random_mixtures(plain):
    rng = random.Random(5)
    parts = [" ", " ", "  ", "\n", "\t", " ", " ", "a", "The", "ing", "'s", "'", "é", "ß", "1", "2024", "_", "==", "日本", "\U0001f600", "́", "\x0b", "​", "<s>", "\r"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(3000)]
    aligner = align.Aligner(align.byte_level(A), align.sentence_pieces(B), remembered=500)
    for at in range(0, len(texts), 150):
        own = texts[at : at + 150]
        _, made, _, _ = aligner(pa.array(own))
        for t, m in zip(own, made.to_pylist(), strict=True):
            assert m == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain(t)), t


def test_whole_texts_where_no_cut_is_sure(plain):
    a, b = align.byte_level(A), align.sentence_pieces(B)
    a.apart = False
    sums, made, pairs, times = align.Aligner(a, b)(pa.array(TEXTS[3:8]))
    cut = align.Aligner(align.byte_level(A), b)(pa.array(TEXTS[3:8]))
    assert made == cut[1] and (sums == cut[0]).all() and pairs == cut[2] and times == cut[3]


def test_wide_groups_are_counted_without_listing_their_links():
    """Tokens of 7 and of 11 bytes that meet only at the end: as many links as the product, a pair for each two ids."""
    a = align.Side(lambda chunks: [[1] * ((len(c) + 1) // 7) for c in chunks], [b"", b" " * 7], False)
    b = align.Side(lambda chunks: [[1] * ((len(c) + 1) // 11) for c in chunks], [b"", b" " * 11], False)
    n = 7 * 11 * 13
    sums, made, pairs, times = align.Aligner(a, b)(pa.array([" " * (n - 1)]))
    assert sums.tolist() == [[11 * 13, 7 * 13, 13, 7 * 11 * 13]]
    assert pairs.to_pylist() == [[(1 << 1) + 1]] and times.to_pylist() == [[7 * 11 * 13]]


def test_groups_begin_where_both_sides_end():
    rng = random.Random(2)
    for _ in range(300):
        total = rng.randrange(1, 30)
        ends = [sorted({*rng.sample(range(1, total + 1), rng.randrange(0, total)), total}) for _ in range(2)]
        a0, b0 = align.groups(*[np.diff(e, prepend=0) for e in ends])
        both = [0, *sorted(set(ends[0]) & set(ends[1]))][:-1]
        assert [([0, *ends[0]][i], [0, *ends[1]][j]) for i, j in zip(a0, b0, strict=True)] == [(x, x) for x in both]


def test_empty_table(empty):
    assert align.align(empty, A, B).count() == 0 and align.link_counts(empty, A, B).count() == 0
