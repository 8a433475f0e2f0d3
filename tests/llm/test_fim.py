"""Fill-in-middle against a plain version, and back again."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from brindle.llm import fim

from .conftest import AWKWARD, sf

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    lines = LINE.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_plain_version(spark):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf('sf0.01')}/documents.parquet").collect()}
    rows = fim.op13_fill_in_middle(spark, sf("sf0.01")).collect()
    assert len(rows) == len(docs) and {r.form for r in rows} >= {"psm", "spm"}
    for r in rows:
        n, form, p, m, out = plain(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, p, m, sha(out), sha(docs[r.doc_id] or ""))


TEXTS = [
    *AWKWARD,
    "\n",
    "\n\n\n",
    "no end",
    "one\ntwo\nthree\n",
    "é\n\U0001f600\r\nß x\x85y\x0bz\n",
    "<P>",
    "a <S> b\nc",
    "<M\n>\n<\nP>",
    "<<\n<P\n<S<\nM>\n>>\n<",
    "x\n" * 20_000,
]


@pytest.mark.parametrize("rate,spm,seed", [(100, 50, 7), (30, 100, 7), (100, 0, 8), (0, 50, 7)])
def test_awkward_texts(spark, rate, spm, seed):
    rows = [(i * 10 + k, t, "x", 1) for i, t in enumerate(TEXTS) for k in range(6)] + [(None, "a\nb\nc\n", "x", 1), (3, TEXTS[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    got = fim.transform(docs, rate=rate, spm=spm, seed=seed)
    got = got.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda x: (str(x[0]), x[1])
    want = sorted(((i, t or "", *plain(i, t, rate, spm, seed)) for i, t, *_ in rows), key=key)
    assert sorted(((r.id, r.back, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == want


def test_other_units_and_marks(spark):
    docs = spark.createDataFrame([(i, "one two  three four " * (i % 5)) for i in range(40)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    got = fim.transform(docs, pattern=r"\S+|\s+", marks=marks).withColumn("back", fim.restore(F.col("output"), F.col("form"), marks))
    got = got.join(docs, F.col("id") == F.col("doc_id")).collect()
    assert len(got) == 40 and all(r.back == r.text and r.n == len(re.findall(r"\S+|\s+", r.text)) for r in got)
    assert all(r.form == "plain" if not r.text else r.output.startswith(("[pre]", "[suf]")) for r in got)


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<<", "<S>", "<M>"), ("<P>", "x<P>x", "<M>"), ("ab", "bc", "d")])
def test_marks_that_cannot_be_told_apart(spark, marks):
    with pytest.raises(ValueError):
        fim.transform(spark.createDataFrame([], "doc_id long, text string"), marks=marks)


def test_empty_table_and_no_shuffle(empty, awkward):
    assert fim.transform(empty).count() == 0
    assert "Exchange" not in fim.transform(awkward)._jdf.queryExecution().toString()
