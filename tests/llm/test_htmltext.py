"""Main text: the test pages against their template, hand-made pages, and the cut against all labellings."""

import html
import random
import re
import time
from itertools import product

import numpy as np
import pytest

from brindle.llm import htmltext

from .conftest import sf


def by_template(page):
    """What the test pages' template puts into the article."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|div|ul|li)>", body)]
    return "\n".join(b for b in blocks if b)


def test_query_matches_template(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf('sf0.01')}/pages.parquet").collect()}
    rows = htmltext.op9_min_cut_text(spark, sf("sf0.01")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == by_template(pages[r.page_id])
        assert r.n_chars == len(r.text)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar">
<div id="page" class="sidebar-layout"><header><h1>Site</h1><nav><a href=/>Home</a> | <a href=/x>More</a></nav></header>
<div class="cookie-notice">We use cookies. Please accept all of them, they are very good for you.</div>
<main><article><header><h2>A &lt;title&gt; &amp; more</h2></header><p>First para&shy;graph with <a href=x>a link</a> in&nbsp;it,
 and a few more words to read.<p>Second.<ul><li>An item</li><li>Another item</ul>
<div class="advertisement">Buy now! Best offers of the whole year, only today and only here.</div>
<form><label>Your mail</label><input><button>Subscribe to our letters</button></form>
<script>var x = "<p>no</p>";</script><p>Third &#8212; the end of this article, which has a long last sentence in it.</p>
<section id="comments"><article><p>I have read this and I must say that I disagree with every single word of it.</p></article></section></article></main>
<aside><p>Related stories that are very long and look like text, but are in the wrong place altogether.</p></aside>
<footer><p>Copyright by us. All rights reserved in all countries of the world and beyond.</p></footer></div></body></html>"""

PLAIN = """<html><body><div class=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div>
<p>A long paragraph of text without any names around it, as many old pages have them, which goes on and on.</p><p>Short one.</p>
<p>Another long paragraph of text that comes after the short one, and it has a number of words, too.</p></div>
<div><a href=a>Imprint</a> <a href=b>Contact</a></div></body></html>"""


def test_hand_made_pages():
    assert htmltext.main_text(PAGE).split("\n") == [
        "A <title> & more",
        "First para­graph with a link in it, and a few more words to read.",
        "Second.",
        "An item",
        "Another item",
        "Third — the end of this article, which has a long last sentence in it.",
    ]
    lines = htmltext.main_text(PLAIN).split("\n")
    assert len(lines) == 3 and lines[1] == "Short one."


def test_cut_equals_all_labellings():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 9)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        links = [(i, i + 1, rng.uniform(0, 2)) for i in range(n - 1)] + [(0, n - 1, 0.7)] * (n > 2) + [(0, n // 2, 0.4)] * (n > 3)
        value = lambda x: sum(g for g, k in zip(gain, x, strict=True) if k) - sum(c for a, b, c in links if x[a] != x[b])  # noqa: E731, B023
        best = max(map(value, product([False, True], repeat=n)))
        assert abs(value(htmltext.minimum_cut(gain, links)) - best) < 1e-9


def test_awkward(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>" * 3000 + "deep " * 40), (3, "u", "<<<>>> &bogus; </p></div>"), (4, "u", "<!-- open"), (5, "u", "<div>" * 5000 + "deep " * 40), (4, "u", "<p>" + "A long sentence of a page. " * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert got[1] == got[2] == "" and len(got[4]) == 27 * 20_000 - 1
    assert htmltext.extract(df.limit(0)).count() == 0


ARTICLE = """<html><body><nav><a href=/>Home</a></nav><main><article><header class="entry-header"><h1>How search engines work</h1></header>
<p>An article about search, which has several sections with names that are everyday words, and some text.</p>
<h2 id="search">Searching</h2><p id="legal">Some of what follows is about the law, and it is part of the text.</p>
<div class="warning">Never try this at home without a second person who can help you.</div>
<h2 id="related-work">Related work</h2><section class="discussion"><p>Others have written about this before, and they came to the same end.</p></section>
<div class="related"><ul><li><a href=1>Ten tricks</a></li><li><a href=2>Five more tricks</a></li></ul></div>
<div class="newsletter"><p>Get our letters every week, with all that is new and good to know for you.</p></div></article>
<div class="related"><p>Another story that has nothing to do with this one, but that you may want to read.</p></div></main></body></html>"""


def test_everyday_names_within_an_article():
    assert htmltext.main_text(ARTICLE).split("\n") == [
        "How search engines work",
        "An article about search, which has several sections with names that are everyday words, and some text.",
        "Searching",
        "Some of what follows is about the law, and it is part of the text.",
        "Never try this at home without a second person who can help you.",
        "Related work",
        "Others have written about this before, and they came to the same end.",
    ]


def test_no_markup_is_an_error():
    rng = random.Random(4)
    bits = ["<", ">", "</", "<!", "<![", "<![foo[", "<![CDATA[", "]]>", "<!--", "-->", "--!>", "<?", "/>", "=", "'", '"', "&", "&#x110000;", "&#0;", "&amp", " ", "\n", "\0", "\ud7ff", "word", "A sentence. "]
    bits += [f"<{c}{t}{a}>" for c in ("", "/") for t in "p div b a li td tr table ul dd h1 article nav script textarea title svg br hr x-y body head select option noscript".split() for a in ("", " class=ad", " hidden", "/")]
    for _ in range(5_000):
        assert isinstance(htmltext.main_text("".join(rng.choices(bits, k=rng.randint(1, 60)))), str)
    assert htmltext.main_text("<article><p>A text with <![foo[ a mark ]]> in it.</p></article>") == "A text with in it."
    assert htmltext.main_text("<article><p>One.<!-->two.<!-- <p>three --!>four 5 < 6.</p><!-- open") == "One.two.four 5 < 6."


@pytest.mark.parametrize(
    "part", ["<x>", "<x><p>a b.", "<div>", "<ul><li>a", "<table><tr><td><p>x", "<b>", "</i>", "<", "<?", "<![foo[", '<a b="', "<header>", "<div><p>A sentence of some length, it ends.</p><div><a>link</a></div></div>"]
)
def test_time_follows_length(part):
    began = time.process_time()
    htmltext.main_text("<i><div>" + part * 50_000 + "<p>text</p>" * 50_000)
    assert time.process_time() - began < 8  # seconds on a slow machine; a walk to the top for each element would take minutes


def test_fitted_to_pages_that_mark_their_article(spark):
    pages = spark.read.parquet(f"{sf('sf0.01')}/pages.parquet")
    prior, w = np.array(list(htmltext.PRIOR.values())), htmltext.fit(pages)
    assert np.array_equal(w, htmltext.fit(pages)) and np.abs(w - prior).max() > 0.1
    rows = np.concatenate([htmltext.lesson(r.html) for r in pages.collect()])
    # Without marks, tags and names the text alone tells most blocks apart, better than by the prior.
    rows[:, 8:] = 0.0
    right = [float(((rows[:, 1:] @ v > 0) == (rows[:, 0] > 0)).mean()) for v in (prior, w)]
    assert right[1] > 0.9 and right[1] >= right[0]
    assert np.array_equal(htmltext.fit(pages.limit(0)), prior)
    assert np.array_equal(htmltext.learn(np.empty((0, 1 + len(prior)))), prior)
    unmarked = spark.createDataFrame([(1, "<p>No article here.</p>"), (None, "<article>x"), (2, None)], "page_id long, html string")
    assert np.array_equal(htmltext.fit(unmarked), prior)
