"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every text run is a node with a hidden label, content or not. Log-linear node
potentials see the tag, words of the class and id, length and links; parent-child potentials tie labels
along the edges, with weights of their own for text runs, paragraphs and other elements. Potentials also see what
needs no names: how much text and how many links a subtree holds, its share of the page, and its paragraphs. Sum-product messages
go up the tree and down again and give each run's probability of being content; runs over one half are the
page's text. All pages of a batch are one forest, and a depth of it is one numpy step.

The weights maximise the likelihood of labelled pages, with the same messages for the gradient. The labelled
pages are drawn by ``html_pages`` from many layouts (``pages`` and ``seed`` bound and fix them).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.dom import Node, parse

# Tags and words that the node potentials know.
TAGS = (
    "#root #text body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption"
    " nav header footer aside form fieldset button address details summary dialog menu select option noscript object"
).split()
WORDS = {
    "advert": "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner dfp",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar topbar tabs pager pagination skip",
    "header": "header masthead logo branding site-title hero",
    "footer": "footer foot copyright legal colophon imprint",
    "sidebar": "sidebar side aside rail widget widgets complementary secondary",
    "comments": "comment comments reply replies respond disqus discussion thread",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay banner newsletter subscribe subscription signup paywall toast warning",
    "hidden": "hidden d-none sr-only visually-hidden",
    "social": "share sharing social follow twitter facebook",
    "related": "related recommended recommendations more popular trending teaser teasers",
    "form": "form login search contact poll survey",
    "content": "content article post entry main body story text copy prose hentry",
}
_GROUPS = list(WORDS)
_WORD_OF = {w: i for i, g in enumerate(_GROUPS) for w in WORDS[g].split()}
_SPLIT = re.compile(r"[^a-z0-9]+")
_TAG_OF = {t: i for i, t in enumerate(TAGS)}
N_TAGS, N_GROUPS = len(TAGS) + 1, len(_GROUPS)
#: Limits of the words of a subtree, its share of the page's words outside links, and its longer paragraphs.
SIZES, SHARES, PARAGRAPHS = (5, 20, 60, 200, 1000), (0.05, 0.2, 0.5, 0.8), (1, 2, 4)
#: Values of a shape: four link shares beside them, and whether it holds a button or input.
N_SHAPE = len(SIZES) + 1 + 4 + len(SHARES) + 1 + len(PARAGRAPHS) + 1 + 2
#: Values of a place among siblings: four shares of the longest one's text, and whether it stands before or after it.
N_PLACE = 4 + 4
#: Bias, tags, words, for runs five lengths, four link shares and whether a sentence ends, the shape of elements,
#: for runs the shape of their parent, and the places of sections of a page.
N_FEATURES = 1 + N_TAGS + N_GROUPS + 5 + 4 + 2 + 2 * N_SHAPE + N_PLACE
#: Elements whose place tells something: a short paragraph among long ones is as good as they are.
SECTIONS = frozenset("main article section div nav header footer aside form table ul ol".split())
#: As many like siblings count fully.
LIKE = 8
#: Kinds of edges: to a text run, to a paragraph or heading, to another element.
KINDS = 3


@lru_cache(maxsize=20_000)
def _element(tag: str, names: str) -> tuple[int, ...]:
    found = {1 + _TAG_OF.get(tag, N_TAGS - 1)}
    for token in names.split():
        for word in (token, *_SPLIT.split(token)):
            if word in _WORD_OF:
                found.add(1 + N_TAGS + _WORD_OF[word])
    return (0, *sorted(found))


def _features(node: Node) -> tuple[int, ...]:
    if node.tag != "#text":
        return _element(node.tag, node.names)
    at = 1 + N_TAGS + N_GROUPS
    words = node.text.count(" ") + 1
    length = 0 if words < 4 else 1 if words < 10 else 2 if words < 20 else 3 if words < 50 else 4
    share = node.linked / max(1, len(node.text))
    link = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3
    end = 0 if node.text[-1] in ".!?:;\"'»”…" else 1
    return (0, 1 + _TAG_OF["#text"], at + length, at + 5 + link, at + 9 + end)


def _share(linked: int, all_: int) -> int:
    share = linked / max(1, all_)
    return 0 if share < 0.02 else 1 if share < 0.3 else 2 if share < 0.7 else 3


def _shapes(page: list[Node]) -> tuple[list[tuple[int, ...]], list[tuple[int, int]]]:
    """The shape of each node's subtree and its place among its siblings, as features counted from 0."""
    n = len(page)
    words, chars, linked, plain, long_, controls = ([0] * n for _ in range(6))
    longest = [(-1, 0)] * n  # of each node's children: the most text, and the first child that has it
    for i in range(n - 1, -1, -1):  # children come after their parents
        node = page[i]
        if node.tag == "#text":
            words[i] = node.text.count(" ") + 1
            chars[i], linked[i] = len(node.text), node.linked
            plain[i] = chars[i] - linked[i]
        elif node.tag in ("button", "select"):
            controls[i] = 1
        up = node.parent
        if up >= 0:
            words[up] += words[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            plain[up] += plain[i]
            controls[up] |= controls[i]
            longest[up] = max(longest[up], (plain[i], -i))
            if node.tag in ("p", "#text") and words[i] >= 8 and 2 * linked[i] < chars[i]:
                long_[up] += 1
    a, b, c = len(SIZES) + 1, len(SIZES) + 5, len(SIZES) + 6 + len(SHARES)
    d = c + len(PARAGRAPHS) + 1
    all_ = max(1, plain[0])
    shapes, places = [], []
    for i in range(n):
        size = bisect_right(SIZES, words[i])
        shape = (size, a + _share(linked[i], chars[i]), c + bisect_right(PARAGRAPHS, long_[i]), d + controls[i])
        # of a small element, the share only tells how long the page is
        shapes.append((*shape, b + bisect_right(SHARES, plain[i] / all_)) if size > 2 else shape)
        most, first = longest[page[i].parent] if i else (0, 0)
        share = plain[i] / max(1, most)
        places.append((0 if share < 0.05 else 1 if share < 0.3 else 2 if share < 1 else 3, 4 + (0 if i == -first else 1 if i < -first else 2)))
    return shapes, places


def _rows(page: list[Node]) -> list[tuple[int, ...]]:
    (shapes, places), out = _shapes(page), []
    place = N_FEATURES - N_PLACE
    above, own = place - N_SHAPE, place - 2 * N_SHAPE
    for i, node in enumerate(page):
        run = node.tag == "#text"
        at, shape = (above, shapes[node.parent]) if run else (own, shapes[i])
        out.append((*_features(node), *(at + f for f in shape), *(place + f for f in places[i] if node.tag in SECTIONS)))
    return out


def _scales(page: list[Node]) -> list[float]:
    """What a node's own potential counts: many like siblings, and their runs, say no more than ``LIKE`` of them."""
    counts = Counter((n.parent, n.tag, n.names) for n in page)
    out: list[float] = []
    for n in page:
        above = out[n.parent] if n.parent >= 0 and page[n.parent].tag not in SECTIONS else 1.0
        out.append(above * min(1.0, LIKE / counts[n.parent, n.tag, n.names]))
    return out


class Forest:
    """The nodes of many pages, by depth."""

    def __init__(self, pages: list[list[Node]]):
        self.nodes = [n for p in pages for n in p]
        base = np.cumsum([0] + [len(p) for p in pages])
        self.page = np.repeat(np.arange(len(pages)), np.diff(base))
        parent = np.array([n.parent for n in self.nodes], np.int64)
        self.parent = np.where(parent >= 0, parent + base[self.page], -1)
        self.depth = np.array([n.depth for n in self.nodes], np.int64)
        self.kind = np.array([0 if n.tag == "#text" else 1 if n.tag in ("p", "h1", "h2", "h3", "h4", "li", "blockquote", "pre") else 2 for n in self.nodes], np.int64)
        self.is_text = self.kind == 0
        rows = [r for p in pages for r in _rows(p)]
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([c for r in rows for c in r], np.int64)
        self.value = np.array([x for p in pages for x in _scales(p)])[self.row]
        order = np.argsort(self.depth, kind="stable")
        cut = np.searchsorted(self.depth[order], np.arange(1, self.depth.max(initial=0) + 2))
        self.by_depth = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def unary(self, weights: np.ndarray) -> np.ndarray:
        """The log potential of content; that of no content is 0."""
        return np.bincount(self.row, weights[self.column] * self.value, minlength=len(self.nodes))


def marginals(forest: Forest, weights: np.ndarray, pairs: np.ndarray):
    """Sum-product over the forest: (content probability per node, pair probabilities per edge, log partition).

    ``pairs[kind, parent label, child label]`` are log potentials. Edges are named by their child.
    """
    n = len(forest.nodes)
    own = np.zeros((n, 2))
    own[:, 1] = forest.unary(weights)
    up = own.copy()  # own potential and all messages from below
    message = np.zeros((n, 2))
    for of in reversed(forest.by_depth):
        m = np.logaddexp(pairs[forest.kind[of], :, 0] + up[of, 0:1], pairs[forest.kind[of], :, 1] + up[of, 1:2])
        message[of] = m
        np.add.at(up, forest.parent[of], m)
    down = np.zeros((n, 2))  # message from above
    for of in forest.by_depth:
        p = forest.parent[of]
        rest = down[p] + up[p] - message[of]
        k = pairs[forest.kind[of]]
        down[of] = np.logaddexp(k[:, 0, :] + rest[:, 0:1], k[:, 1, :] + rest[:, 1:2])
    belief = up + down
    total = np.logaddexp(belief[:, 0], belief[:, 1])
    prob = np.exp(belief[:, 1] - total)
    edge = np.zeros((n, 2, 2))
    has = forest.parent >= 0
    p = forest.parent[has]
    rest = down[p] + up[p] - message[has]
    joint = rest[:, :, None] + pairs[forest.kind[has]] + up[has][:, None, :]
    edge[has] = np.exp(joint - total[has][:, None, None])
    return prob, edge, total[~has].sum()


def fit(forest: Forest, labels: np.ndarray, steps: int = 200, rate: float = 0.15, penalty: float = 0.005):
    """Weights and pair potentials by gradient ascent (Adam) on the likelihood of the labels."""
    theta = np.zeros(N_FEATURES + KINDS * 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.bincount(forest.column, labels[forest.row] * forest.value, minlength=N_FEATURES)
    has = np.flatnonzero(forest.parent >= 0)
    cell = forest.kind[has] * 4 + labels[forest.parent[has]] * 2 + labels[has]
    seen_pairs = np.bincount(cell, minlength=KINDS * 4)
    pages = forest.page.max() + 1
    for t in range(1, steps + 1):
        pairs = conditional(theta[N_FEATURES:])
        prob, edge, _ = marginals(forest, theta[:N_FEATURES], pairs)
        want = np.bincount(forest.column, prob[forest.row] * forest.value, minlength=N_FEATURES)
        want_pairs = np.zeros((KINDS, 2, 2))
        np.add.at(want_pairs, forest.kind[has], edge[has])
        rise = seen_pairs.reshape(KINDS, 2, 2) - want_pairs
        rise -= np.exp(pairs) * rise.sum(2, keepdims=True)
        slope = np.concatenate([seen - want, rise.reshape(-1)]) / pages - penalty * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta[:N_FEATURES], conditional(theta[N_FEATURES:])


def conditional(theta: np.ndarray) -> np.ndarray:
    """Pair potentials as log probabilities of the child's label for each label of the parent.

    A child without evidence of its own then tells its parent nothing, however many such children there are.
    """
    raw = theta.reshape(KINDS, 2, 2)
    return raw - np.logaddexp(raw[:, :, 0], raw[:, :, 1])[:, :, None]


@lru_cache(maxsize=2)
def trained(pages: int = 1200, seed: int = 7):
    """The model, trained on ``pages`` labelled pages drawn with ``seed``."""
    from quaver.llm.html_pages import labelled_page

    rng = np.random.default_rng(seed)
    drawn = [labelled_page(rng, odd=i % 3 > 0) for i in range(pages)]
    trees = [parse(h) for h, _ in drawn]
    labels = []
    for tree, (_, content) in zip(trees, drawn):
        own = [int(n.tag == "#text" and n.text in content) for n in tree]
        for i in range(len(tree) - 1, 0, -1):  # an element is content if it holds any
            own[tree[i].parent] |= own[i]
        labels += own
    return fit(Forest(trees), np.array(labels, np.int64))


def extract(pages: list[str | None], weights: np.ndarray, pairs: np.ndarray, group: int = 4 << 20) -> list[str]:
    """The main text of each page, blocks joined by a line feed; '' if there is none. Pages of about ``group`` characters are one forest."""
    out: list[str] = []
    a = 0
    while a < len(pages):
        b, size = a, 0
        while b < len(pages) and (b == a or size + len(pages[b] or "") <= group):
            size += len(pages[b] or "")
            b += 1
        trees = [parse(p) for p in pages[a:b]]
        forest = Forest(trees)
        prob, _, _ = marginals(forest, weights, pairs)
        blocks: list[list[str]] = [[] for _ in trees]
        for i in np.flatnonzero(forest.is_text & (prob > 0.5)).tolist():
            blocks[forest.page[i]].append(forest.nodes[i].text)
        out += ["\n".join(x) for x in blocks]
        a = b
    return out


def extract_pages(pages: DataFrame, html_col: str = "html", training_pages: int = 1200, seed: int = 7) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    A null page is empty, as is one without an article; pages may be of any length; repeated rows and null ids stay; other columns
    are ignored; no rows give none.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained(training_pages, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pairs = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = extract(part.column("html").to_pylist(), weights, pairs)
                yield pa.RecordBatch.from_pydict(
                    {"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
