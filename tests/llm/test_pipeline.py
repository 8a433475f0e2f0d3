"""The pipeline stage by stage against plain Python over each stage's own input."""

from collections import Counter

import corpus_pipeline as pipeline
from brindle.llm import bpe, mixing, quality, secrets
from tokenizers import Tokenizer

from .conftest import sf
from .test_native import brute_base, shingles


def test_stages(spark):
    assert 4 <= len(pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{sf()}/documents.parquet")
    inputs, columns = [docs], docs.columns
    for _, stage in pipeline.STAGES:
        inputs.append(pipeline.common.stage(stage(spark, inputs[-1], sf()), "test-stage"))
        assert len(inputs) > len(pipeline.STAGES) or inputs[-1].columns == columns
    rows = [{r.doc_id: r for r in x.collect()} for x in inputs]
    # Rejected: those that the classifier scores low, and no labelled clean document that it was taught.
    model = quality.fit(docs, spark.read.parquet(f"{sf()}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert set(rows[1]) == {i for i, s in scores.items() if s >= pipeline.REJECT_BELOW}
    good = {r.doc_id for r in spark.read.parquet(f"{sf()}/labels.parquet").collect() if r.quality == 1}
    assert len(good - set(rows[1])) <= 0.02 * len(good)
    # Near-duplicates: equal texts go; what goes is near another by its exact shingles, and hardly any link is left among what stays.
    sets = {i: shingles(r.text) for i, r in rows[1].items()}
    texts = Counter(r.text for r in rows[2].values())
    assert set(texts.values()) == {1}
    for i in set(rows[1]) - set(rows[2]):
        assert max(len(sets[i] & s) / (len(sets[i]) * len(s)) ** 0.5 for j, s in sets.items() if j != i and s) >= 0.8
    left, links = set(rows[2]), 0
    for i in left:
        links += any(i < j and len(sets[i] & sets[j]) >= 0.8 * (len(sets[i]) * len(sets[j])) ** 0.5 for j in left if sets[i] and sets[j])
    assert links <= 0.1 * len(set(rows[1]) - left)
    # Secrets: none is left, other texts are as they were.
    assert set(rows[3]) == set(rows[2])
    for i, r in rows[2].items():
        if secrets.BASE and not brute_base(r.text) and rows[3][i].text != r.text:
            assert "[secret]" in rows[3][i].text
        assert not brute_base(rows[3][i].text)
        assert rows[3][i].n_chars == len(rows[3][i].text)
    # Mixing: each document as often as its plan says.
    plan = {r.doc_id: r.repeats for r in mixing.plan(inputs[3]).collect()}
    assert Counter(r.doc_id for r in inputs[4].collect()) == Counter({i: n for i, n in plan.items() if n})
    library = Tokenizer.from_file(bpe.vocabulary())
    library.no_truncation()
    for i, r in rows[5].items():
        assert r.ids == library.encode(rows[4][i].text, add_special_tokens=False).ids


def test_awkward(spark, awkward, empty):
    docs = awkward.selectExpr("doc_id", "text", "'en' lang", "source", "n_chars")
    for table in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            table = stage(spark, table, sf())
        assert table.columns == ["doc_id", "n_tokens", "ids"]
        table.collect()
