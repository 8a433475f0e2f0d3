"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text and the elements they lie in, in one pass over
its markup: no markup is an error, and no element looks further up than its
parent, so the time follows the length of the page however deep it is nested. A
linear classifier over tags, names, text and link shares gives each block the odds
of being content; they are the difference of the capacities to the two terminals.
Edges between neighbouring blocks, and between successive blocks of one parent,
make it costly to label them apart, the more so the closer they are in the tree.
The minimum cut is the cheapest labelling of the whole page; the blocks on the
content side are the text.

The classifier is fitted (``fit``) to a bounded sample of the pages that mark their
article themselves. What lies in such an article is content, what lies outside it
or in a navigation, footer, form or the like is not, and what a name within an
article casts doubt on teaches nothing. Each page is learnt several times with the
marks, the tags or the names hidden, so that the rest has to do without. Weights
are drawn to ``PRIOR``: what the sample doesn't show stays as it is there.

A block whose own odds outweigh all its edges has its label in any minimum cut,
so such blocks are settled first and their edges folded into their neighbours'
capacities; what is left goes through blocking flows along shortest paths.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold isn't read as markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIP = frozenset("head script style noscript noembed noframes template iframe object svg math canvas audio video title datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end when another of their kind begins: tags, and the containers that keep an outer one open.
KINDS = [(frozenset(a.split()), frozenset(b.split())) for a, b in (
    ("p h1 h2 h3 h4 h5 h6", "div section article main td th li table ul ol body button object"),
    ("li", "ul ol menu"),
    ("dt dd", "dl"),
    ("tr td th", "table"),
    ("td th", "tr table"),
    ("option", "select"),
)]
#: Which kind a start tag ends; block tags end texts, too.
ENDS = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
BAD_TAGS = frozenset("nav aside footer form button select textarea dialog menu fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_NAMES = frozenset(
    "ad ads adv adbox adslot adunit adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottom "
    "sidebar aside rail widget widgets cookie cookies consent gdpr notice notices alert warning popup modal overlay dialog newsletter subscribe subscription signup login signin register form search "
    "share sharing social related recommended recommendations more comment comments commentlist reply replies respond discussion disqus feedback toolbar pager pagination copyright legal disclaimer skip hidden teaser teasers trending popular taboola outbrain tagcloud offcanvas".split()
)
#: Of these, those that articles use for parts of their own: within a marked article they are a weak sign.
EVERYDAY = frozenset("search form register related recommended more warning alert notice notices legal disclaimer header share sharing social discussion feedback popular trending bottom skip".split())
#: Their ids are anchors that name a subject, not a place in the page.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
GOOD_NAMES = frozenset("article content post entry story main body text maintext articlebody".split())
NAME = re.compile(r"[A-Za-z][a-z]*")


class Element:
    __slots__ = ("tag", "parent", "depth", "block", "cell", "open", "bad", "named", "good", "chars", "has_title", "has_article", "place", "names", "weak", "within", "strong", "likely", "in_article")

    def __init__(self, tag: str, parent: Element | None, attrs: dict[str, str]):
        self.tag, self.parent = tag, parent
        self.chars, self.has_title, self.has_article = 0, False, False
        self.bad = self.named = self.good = False
        if parent is None:
            self.depth, self.block, self.cell, self.open = 0, self, self, (None,) * len(KINDS)
            self.place = self.names = self.weak = self.within = self.strong = self.likely = self.in_article = False
            return
        self.depth = parent.depth + 1
        # The nearest elements, this one included, that are no inline ones, that are cells, and that are open of each kind.
        self.block = parent.block if tag in INLINE else self
        self.cell = self if tag in ("td", "th", "caption") else parent.cell
        self.open = parent.open
        for k in EFFECT.get(tag, ()):
            self.open = (*self.open[:k], self if tag in KINDS[k][0] else None, *self.open[k + 1 :])
        role = attrs.get("role", "").strip().lower()
        hidden = attrs and ("hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or "display:none" in "".join(attrs.get("style", "").split()).lower())
        self.bad = tag in BAD_TAGS or role in BAD_ROLES or bool(hidden)
        if attrs and tag not in ("html", "body"):
            own, anchor = attrs.get("class", ""), attrs.get("id", "")
            self.named, _ = _named(own if tag in TEXTS else f"{own} {anchor}")
            _, self.good = _named(f"{own} {anchor}")
        if tag in ("article", "main") or role in ("main", "article"):
            self.good = True

    def judge(self, page_chars: int) -> None:
        """Sets what it and the elements around it are marked as; its parent comes first.

        A name doesn't count against an element that holds the article: one with
        article and title, or with most of the page's text. An everyday name within
        a marked article only sets ``weak``, unless it holds articles itself.
        """
        up = self.parent
        holds = (self.has_article and self.has_title) or self.chars >= 0.6 * page_chars
        self.in_article = up.in_article or up.tag == "article"
        page_header = self.tag == "header" and not self.in_article and not self.has_article
        everyday = self.named is None and up.within and not self.has_article
        self.place = up.place or page_header or (self.bad and not (self.tag in ("form", "menu", "fieldset") and holds))
        self.names = up.names or (self.named is not False and not everyday and not holds)
        self.weak = up.weak or (everyday and not holds)
        self.within = up.within or (self.good is True and (self.tag == "article" or not self.has_article))
        self.strong = up.strong or self.good is True
        self.likely = up.likely or self.good is None


#: By tag, the kinds whose open element it changes.
EFFECT: dict[str, list[int]] = {}
for _k, _tags in enumerate(KINDS):
    for _tag in sorted(_tags[0] | _tags[1]):
        EFFECT.setdefault(_tag, []).append(_k)


@lru_cache(maxsize=20_000)
def _named(names: str) -> tuple[bool | None, bool | None]:
    """Whether names are those of boilerplate (None: everyday ones only), and None if they are those of an article, else False."""
    words = {w.lower() for w in NAME.findall(names)} | set(names.lower().split())
    if words.isdisjoint(BAD_NAMES):
        bad = False
    else:
        bad = None if words.isdisjoint(BAD_NAMES - EVERYDAY) else True
    return bad, False if words.isdisjoint(GOOD_NAMES) else None


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


OPENING = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|[!?/])")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|(=?[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)""")
#: The attributes that count.
OWN = frozenset("class id role style hidden aria-hidden".split())


@lru_cache(maxsize=len(RAW))
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


class Reader:
    """The blocks and elements of a page, in order. Unclosed and crossing tags are allowed for; text is never an error."""

    def __init__(self, html: str):
        self.top = self.at = Element("#root", None, {})
        self.elements: list[Element] = []
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.named: dict[str, list[Element]] = {}
        self.linked = self.in_link = self.skipping = 0
        self.home: Element | None = None
        self._read(html)
        while self.at.parent:
            self.pop()
        self.flush()
        for e in self.elements:
            e.judge(self.top.chars)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            i = html.find("<", at)
            if i != at:
                self.text(unescape(html[at:i] if i > 0 else html[at:]))
                if i < 0:
                    return
            m = OPENING.match(html, i)
            if m is None:
                self.text("<")
                at = i + 1
            elif m[1]:
                # A comment may end with the dashes that begin it; without an end it goes on to the end of the page.
                end = COMMENT_END.search(html, i + 2) if html.startswith(("<!-->", "<!--->"), i) else COMMENT_END.search(html, i + 4)
                at = end.end() if end else n
            elif not m[3] or m[2]:
                end = html.find(">", m.end())
                at = end + 1 if end >= 0 else n
                if m[3] and end >= 0:
                    self.end(m[3].lower())
            else:
                at = self._start_tag(html, m[3].lower(), m.end())

    def _start_tag(self, html: str, tag: str, at: int) -> int:
        """Where to go on after a start tag; one that the page ends in is dropped."""
        attrs: dict[str, str] = {}
        while True:
            m = ATTRIBUTE.match(html, at)
            if m[1]:
                break
            if m.end() >= len(html) or m.end() == at:
                return len(html)
            name = m[2].lower()
            if name in OWN and name not in attrs:
                value = m[3] or m[4] or m[5] or ""
                attrs[name] = unescape(value) if "&" in value else value
            at = m.end()
        at = m.end()
        if tag in RAW:
            end = _raw_end(tag).search(html, at)
            close = html.find(">", end.end()) if end else -1
            # A field is boilerplate wherever it stands, the others are skipped: none has text of the article.
            if tag == "textarea":
                self.flush()
            return close + 1 if close >= 0 else len(html)
        self.start(tag, attrs)
        if tag in ("svg", "math") and html[at - 2] == "/":
            self.pop()
        return at

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                e = self.home or self.at
                self.blocks.append(Block(text, e, self.linked))
                e.chars += len(text)
            self.pieces, self.linked, self.home = [], 0, None

    def pop(self, to: Element | None = None) -> None:
        """Ends the innermost open element, or all up to ``to``."""
        while True:
            e, up = self.at, self.at.parent
            if e.tag not in INLINE:
                self.flush()
            up.chars += e.chars
            up.has_title |= e.has_title or e.tag == "h1"
            up.has_article |= e.has_article or e.tag in ("article", "main")
            self.skipping -= e.tag in SKIP
            self.in_link -= e.tag == "a"
            self.named[e.tag].pop()
            self.at = up
            if to is None or e is to:
                return

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in VOID:
            if tag == "br" and not self.skipping:
                self.pieces.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            if tag not in SKIP and self.at.open[0]:
                self.pop(self.at.open[0])
        if tag in ENDS:
            while e := self.at.open[ENDS[tag]]:
                self.pop(e)
        if tag == "body" and self.named.get("head"):
            self.pop(self.named["head"][-1])
        self.at = Element(tag, self.at, attrs)
        self.elements.append(self.at)
        self.named.setdefault(tag, []).append(self.at)
        self.skipping += tag in SKIP
        self.in_link += tag == "a"

    def end(self, tag: str) -> None:
        """Ends the nearest open element of that tag, unless it lies beyond a block (for an inline one) or a cell of a table."""
        if tag == "br":
            self.pieces.append(" ")
        elif tag not in VOID:
            if tag not in INLINE:
                self.flush()
            e = self.named.get(tag)
            if e and e[-1].depth >= (self.at.block.depth if tag in INLINE else 0 if tag in TABLE else self.at.cell.depth):
                self.pop(e[-1])

    def text(self, data: str) -> None:
        if not self.skipping:
            if self.home is None and not data.isspace():
                self.home = self.at.block
            self.pieces.append(data)
            if self.in_link:
                self.linked += len(data.strip())


#: The classifier's features and the weights they are drawn to.
PRIOR = {
    "base": -1.5,
    "log2 of words": 0.5,
    "share in links": -4.0,
    "ends like a sentence": 1.0,
    "paragraph": 0.8,
    "heading": 0.5,
    "list item or cell": -0.5,
    "in a marked article": 6.0,
    "outside the marked article": -2.0,
    "named like an article, none marked": 2.0,
    "place of boilerplate": -14.0,
    "named like boilerplate": -14.0,
    "everyday name in an article": -3.0,
}
MARKS, PLACE, NAMES = (7, 8, 9), (10,), (11, 12)
#: Pages and blocks a page that the classifier is fitted to at most, and how firmly weights are drawn to the prior.
SAMPLE, BLOCKS, FIRM = 2_000, 100, 40.0


def features(page: Reader) -> np.ndarray:
    """(blocks, features)."""
    marked, out = page.top.has_article, np.zeros((len(page.blocks), len(PRIOR)))
    for row, b in zip(out, page.blocks, strict=True):
        e, tag = b.element, b.element.tag
        row[:3] = 1.0, log2(2 + b.text.count(" ")), min(1.0, b.linked / len(b.text))
        row[3] = b.text[-1] in ".!?:;\"'”»。！？…"
        if tag in ("p", "blockquote", "pre"):
            row[4] = 1.0
        elif tag in HEADINGS:
            row[5] = 1.0
        elif tag in ("li", "td", "th"):
            row[6] = 1.0
        row[7 if e.strong else 8 if marked else 9] = e.strong or marked or e.likely
        row[10], row[11] = e.place, e.names
        row[12] = e.weak and not (e.place or e.names)
    return out


def lesson(html: str | None) -> np.ndarray:
    """(blocks, label and features) of a page that marks one article; no rows for another page.

    Of more than ``BLOCKS`` blocks every so many are taken.
    """
    page = Reader(html or "")
    x = features(page)
    content = (x[:, 7] > 0) & (x[:, 10] == 0)
    sure = ~(content & (x[:, 11:].sum(axis=1) > 0))
    if not page.top.has_article or not content.any():
        sure[:] = False
    rows = np.column_stack([content, x])[sure]
    return rows[:: -(-len(rows) // BLOCKS) or 1]


def learn(rows: np.ndarray, firm: float = FIRM, steps: int = 30) -> np.ndarray:
    """The weights of a logistic regression over rows of label and features, drawn to the prior; without rows the prior."""
    prior = np.array(list(PRIOR.values()))
    w = prior.copy()
    views = []
    for hidden in ((), MARKS, (*MARKS, *NAMES), (*MARKS, *PLACE), (*MARKS, *PLACE, *NAMES)):
        view = rows.copy()
        view[:, [1 + i for i in hidden]] = 0.0
        views.append(view)
    rows, times = np.unique(np.concatenate(views), axis=0, return_counts=True)
    y, x = rows[:, 0], rows[:, 1:]
    if len(x):
        # Both labels have the same weight in all, and the sample that of ``SAMPLE`` rows, however many blocks it has.
        share = np.where(y > 0, times / max(1, times[y > 0].sum()), times / max(1, times[y == 0].sum())) * SAMPLE
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (share * (p - y)) + firm * (w - prior)
            curve = (x * (share * p * (1 - p))[:, None]).T @ x + firm * np.eye(len(w))
            step = np.linalg.solve(curve, slope)
            step /= max(1.0, np.abs(step).max() / 2)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
    return w


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted to at most ``sample`` pages, those with the smallest hashes of their ids; the prior if none marks an article.

    Only the ids are read for the choice, then the chosen pages. Null ids and null
    pages aren't chosen, of pages that share an id at most ``sample`` in all.
    """
    ids = pages.where(F.col(id_col).isNotNull() & F.col(html_col).isNotNull()).select(F.col(id_col).alias("__id"))
    chosen = F.broadcast(ids.distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample))
    rows = pages.join(chosen, F.col(id_col) == F.col("__id"), "left_semi").select(F.col(html_col).alias("html")).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for h in batch.column("html").to_pylist() for x in lesson(h).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], ["row"])

    got = rows.mapInArrow(run, "row array<double>").toPandas()
    return learn(np.array(sorted(got["row"].map(list)), float).reshape(-1, 1 + len(PRIOR)))


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours in the page by their distance in the tree, and successive blocks of one parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            # No longer than what opens and closes between the two, so all walks together follow the page's length.
            x, y, steps = blocks[i - 1].element, b.element, 0
            while x is not y:
                if x.depth >= y.depth:
                    x = x.parent
                else:
                    y = y.parent
                steps += 1
            out.append((i - 1, i, 2.0 / (1 + steps)))
        up = id(b.element.parent)
        if up in last and last[up] != i - 1:
            out.append((last[up], i, 0.5))
        last[up] = i
    return out


def minimum_cut(gain: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling that maximizes the gains of the true minus the links between true and false.

    ``gain`` is the difference of a node's two terminal capacities: only that
    decides. Where labellings tie, nodes are false.
    """
    n = len(gain)
    gain, near = list(gain), [dict() for _ in range(n)]
    for a, b, c in links:
        near[a][b] = near[b][a] = near[a].get(b, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # settle those that their edges cannot outweigh
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) > sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, c in near[i].items():
                gain[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    flow = {i: dict(near[i]) for i in range(n) if label[i] is None}
    excess = {i: gain[i] for i in flow}
    while True:  # from nodes with gain to nodes with loss, by blocking flows along shortest paths
        level = {i: 0 for i in flow if excess[i] > LEAST}
        queue, found = deque(level), False
        while queue:
            i = queue.popleft()
            for j, c in flow[i].items():
                if c > LEAST and j not in level:
                    level[j] = level[i] + 1
                    found |= excess[j] < -LEAST
                    queue.append(j)
        if not found:
            break
        untried = {i: iter(list(flow[i])) for i in level}
        for source in [i for i, k in level.items() if k == 0]:
            path = [source]
            while path and excess[source] > LEAST:
                i = path[-1]
                if excess[i] < -LEAST:
                    steps = list(zip(path, path[1:], strict=False))
                    amount = min(excess[source], -excess[i], *(flow[a][b] for a, b in steps))
                    excess[source] -= amount
                    excess[i] += amount
                    for a, b in steps:
                        flow[a][b] -= amount
                        flow[b][a] += amount
                    path = [source]
                    # The path's edges may have room left, so they are tried again.
                    for a, b in steps:
                        if flow[a][b] > LEAST:
                            untried[a] = iter([b, *untried[a]])
                    continue
                for j in untried[i]:
                    if flow[i][j] > LEAST and level[j] == level[i] + 1:
                        path.append(j)
                        break
                else:
                    path.pop()
    for i in flow:
        label[i] = i in level
    return label


#: Capacities below this count as none.
LEAST = 1e-12


def main_text(html: str | None, weights: np.ndarray | None = None) -> str:
    """The article's blocks, joined by line breaks; empty for null, blank or purely boilerplate pages. Without ``weights`` by the prior."""
    if not html:
        return ""
    page = Reader(html)
    odds = features(page) @ (np.array(list(PRIOR.values())) if weights is None else weights)
    kept = minimum_cut(np.clip(odds, -30.0, 30.0).tolist(), edges(page.blocks))
    return "\n".join(b.text for b, k in zip(page.blocks, kept, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), weights: np.ndarray | None = None) -> DataFrame:
    """id_col, ``keep`` and text: one row for each page.

    ``weights`` are those of ``fit``; by default it is called here. Null and empty
    html give the empty text, any markup gives some text; pages are read whole.
    Other columns are ignored, so their names can't clash; null and repeated ids
    and rows are kept. An empty table gives one.
    """
    cols = [id_col, *keep]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in cols)
    weights = fit(pages, id_col, html_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                texts = [main_text(h, weights) for h in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in cols), pa.array(texts, pa.string())], [*cols, "__text"])

    rows = pages.select(*cols, F.col(html_col).alias("__html")).mapInArrow(run, f"{schema}, __text string")
    return rows.select(*cols, F.col("__text").alias("text"))


def op9_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars: main text and its length for every page.

    Null and empty pages have the empty text; repeated pages and ids stay; other
    columns are ignored; no pages give no rows.
    """
    rows = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
