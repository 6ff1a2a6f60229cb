"""Main-text extraction: boosted trees over DOM-node features, decoded over the hierarchy.

Each node of a page's block tree gets features: tag, depth, density of its subtree (text, links,
blocks), tokens of its attributes and of its ancestors', and statistics of its siblings. Two
gradient-boosted classifiers give the log-odds that all text below a node is main content, and
that none is. Decoding picks one state for every node - content, boilerplate or mixed - that
maximises the summed log-probabilities under one rule: below content all is content, below
boilerplate all is boilerplate. So no ancestor contradicts its descendants.

The classifiers are trained on pages made here by ``training_page`` from a fixed seed (bounded by
``pages``), whose blocks are labelled by construction.

Output: kept text runs in page order, character references decoded, white space inside a block
turned into one space, blocks joined by one space. Edge cases: null and empty pages give an empty
text; broken and truncated markup is closed silently; repeated rows repeat their result; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftmark.llm.boosting import BoostedTrees
from siftmark.llm.common import bounded_batches
from siftmark.llm.html_tree import CONTROLS, HEADINGS, Node, parse

#: Attribute tokens, by what they tell. Matched as words or with digits and dashes around.
HINTS = {
    "content": "article content entry main post story text body page document blog news paragraph",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc pager pagination links tabs toolbar skip topbar",
    "edge": "header footer masthead foot head banner colophon copyright bottom top branding logo legal site",
    "side": "sidebar aside side rail widget related recommended more popular trending archive tags categories author bio secondary complementary",
    "advert": "ad ads advert advertisement advertising adbox adslot adsense sponsor sponsored promo promotion commercial outbrain taboola dfp",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay banner disclaimer newsletter subscribe subscription signup paywall",
    "form": "form search login register contact input field survey poll",
    "comments": "comment comments reply replies respond discussion disqus thread responses reader feedback",
    "social": "share sharing social follow facebook twitter like buttons tools print",
}
TOKEN = re.compile(r"[a-z]+")
TOKENS = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}
COMPOUND = re.compile("|".join(f"(?P<k{k}>{p})" for k, p in ((1, "nav|menu|crumb"), (2, "foot|masthead"), (3, "sidebar|related|widget"), (4, "advert|sponsor|promo|adsense"), (5, "cookie|consent|newsletter|popup|subscri"), (7, "comment|discuss|disqus"), (8, "share|social"))))
GROUPS = [
    {"#text"}, {"p"}, set(HEADINGS), {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu"}, {"div"}, {"section"}, {"article"}, {"main"}, {"nav"},
    {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend", "search", "dialog"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"blockquote", "pre", "figure", "figcaption", "details", "summary"}, set(CONTROLS),
]
GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}
KINDS, N_HINTS = len(GROUPS) + 1, len(HINTS)
WIDTH = KINDS * 2 + N_HINTS * 2 + KINDS + 18
CONTENT, BOILER, MIXED = 0, 1, 2
#: Private characters that mark text runs of training pages.
MAIN, OTHER = "\ue000", "\ue001"


def hints(attributes: str) -> set[int]:
    """Kinds of hints that attribute tokens give."""
    found = {TOKENS[w] for w in TOKEN.findall(attributes) if w in TOKENS}
    for m in COMPOUND.finditer(attributes):
        found.add(int(m.lastgroup[1:]))
    return found


def flatten(root: Node) -> list[Node]:
    """Nodes in page order, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node."""
    n = len(nodes)
    x = np.zeros((n, WIDTH), np.float32)
    index = {id(v): i for i, v in enumerate(nodes)}
    parent = [index[id(v.parent)] if v.parent is not None else -1 for v in nodes]
    chars, links, blocks, runs, stops = ([0] * n for _ in range(5))
    before = [0] * n
    seen = 0
    hinted: list[set[int]] = []
    above: list[set[int]] = []
    tags_above: list[set[int]] = []
    cache: dict[str, set[int]] = {"": set()}
    kind = [GROUP.get(v.tag, KINDS - 1) for v in nodes]
    for i, v in enumerate(nodes):
        if v.attributes not in cache:
            cache[v.attributes] = hints(v.attributes)
        own = cache[v.attributes]
        hinted.append(own)
        p = parent[i]
        above.append(above[p] | hinted[p] if p >= 0 and hinted[p] - above[p] else above[p] if p >= 0 else set())
        tags_above.append(tags_above[p] if p < 0 or kind[p] in tags_above[p] else tags_above[p] | {kind[p]}) if p >= 0 else tags_above.append(set())
        before[i] = seen
        if v.tag == "#text":
            chars[i], links[i], runs[i] = len(v.text), v.link_chars, 1
            stops[i] = v.text.count(".") + v.text.count(",")
            seen += len(v.text)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        blocks[p] += blocks[i] + (nodes[i].tag != "#text")
        runs[p] += runs[i]
        stops[p] += stops[i]
    parent, chars, links, blocks, runs, stops, before = np.array(parent), *(np.array(a, float) for a in (chars, links, blocks, runs, stops, before))
    total = max(chars[0], 1.0)
    rows, has = np.arange(n), parent >= 0
    x[rows, kind] = 1
    x[rows[has], KINDS + np.array(kind)[parent[has]]] = 1
    for sets, base in ((hinted, 2 * KINDS), (above, 2 * KINDS + N_HINTS), (tags_above, 2 * KINDS + 2 * N_HINTS)):
        at = [(i, base + k) for i, found in enumerate(sets) if found for k in found]
        if at:
            x[tuple(np.array(at).T)] = 1
    c = 3 * KINDS + 2 * N_HINTS
    siblings = np.array([len(v.parent.children) if v.parent is not None else 1 for v in nodes])
    x[:, c : c + 4] = np.log1p(np.column_stack([[v.depth for v in nodes], siblings, blocks, runs]))
    some = np.maximum(chars, 1)
    x[:, c + 4 : c + 8] = np.column_stack([np.log1p(chars), links / some, chars / np.maximum(runs, 1), stops / some * 100])
    x[:, c + 8 : c + 11] = np.column_stack([chars / total, before / total, np.where(has, (chars[parent] - chars) / total, 0)])
    # statistics of siblings: their share of equal tags, mean length, link density, place among them
    c = 3 * KINDS + 2 * N_HINTS + 11
    lone, long, linked = np.log1p(chars).tolist(), chars.tolist(), links.tolist()
    where, stats = [], []
    for v in nodes:
        if v.children:
            at = [index[id(u)] for u in v.children]
            m, mass = len(at), sum(long[j] for j in at)
            share, alike = sum(linked[j] for j in at) / max(mass, 1), Counter(kind[j] for j in at)
            where += at
            stats += [(alike[kind[j]] / m, mass / m, share, k / m, lone[at[k - 1]] if k else -1, lone[at[k + 1]] if k + 1 < m else -1) for k, j in enumerate(at)]
    if where:
        stats = np.array(stats)
        stats[:, 1] = np.log1p(stats[:, 1])
        x[where, c : c + 6] = stats
    x[:, c + 6] = np.log1p(total)
    return x


def decode(nodes: list[Node], content: np.ndarray, boiler: np.ndarray) -> list[int]:
    """States that maximise the summed log-probabilities; leaves are content or boilerplate."""
    n = len(nodes)
    index = {id(v): i for i, v in enumerate(nodes)}
    p = 1 / (1 + np.exp(-np.stack([content, boiler], 1)))
    mixed = np.clip(1 - p.sum(1), 0.02, 1)
    leaf = np.array([not v.children for v in nodes])
    mixed[leaf] = 1e-9
    state = np.log(np.clip(np.column_stack([p, mixed]), 1e-9, 1) / np.column_stack([p, mixed]).sum(1, keepdims=True))
    best = state.tolist()
    for i in range(n - 1, 0, -1):  # children from the last to the first, each after all below it
        own, over = best[i], best[index[id(nodes[i].parent)]]
        over[CONTENT] += own[CONTENT]
        over[BOILER] += own[BOILER]
        over[MIXED] += max(own)
    chosen = [MIXED] * n
    for i, v in enumerate(nodes):
        above = chosen[index[id(v.parent)]] if v.parent is not None else MIXED
        chosen[i] = above if above != MIXED else best[i].index(max(best[i]))
    return chosen


class ContentModel:
    """The two classifiers."""

    def __init__(self, content: BoostedTrees, boiler: BoostedTrees):
        self.content, self.boiler = content, boiler

    def extract(self, pages: list[str | None]) -> list[str]:
        """Main text of each page."""
        trees = [flatten(parse(p)) for p in pages]
        if not trees:
            return []
        x = np.concatenate([features(t) for t in trees])
        content, boiler = self.content.decision(x), self.boiler.decision(x)
        out, at = [], 0
        for nodes in trees:
            end = at + len(nodes)
            states = decode(nodes, content[at:end], boiler[at:end])
            out.append(" ".join(v.text for v, s in zip(nodes, states, strict=True) if s == CONTENT and v.tag == "#text"))
            at = end
        return out


class _Maker:
    """Random pages with labelled blocks."""

    def __init__(self, rng: random.Random):
        self.r = rng

    def word(self) -> str:
        return "".join(self.r.choice("abcdefghijklmnoprstuvwzéüñ") for _ in range(self.r.randint(1, 9)))

    def words(self, n: int) -> str:
        ends = self.r.choice([[""] * 8 + [".", ","], [""] * 8 + [".", ","], ["%%%", "***", "&amp;"], [" |"], ["!!"]])
        return " ".join(self.word() + self.r.choice(ends) for _ in range(n))

    def tag(self, name: str, inside: str, *classes: str, close: bool = True) -> str:
        attribute = ""
        if classes and self.r.random() < 0.9:
            value = self.r.choice(classes)
            if self.r.random() < 0.3:
                value += self.r.choice([" box", "-1", " clearfix", "-wrapper", "_main", " x2"])
            attribute = f' {self.r.choice(["class", "class", "id", "role"])}="{value}"'
        return f"<{name}{attribute}>{inside}" + (f"</{name}>" if close else "")

    def links(self, n: int, each: int = 2) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.words(self.r.randint(1, each))}</a></li>' for _ in range(n))

    def paragraph(self) -> str:
        n = self.r.choice([1, 2, 3, 5, 12, 30, 60, 120, 200])
        text = self.words(n)
        if self.r.random() < 0.25:
            text = f"<b>{text}"
            text += "</b>" if self.r.random() < 0.5 else "<br>"
        if self.r.random() < 0.15:
            text += f' <a href="#">{self.words(2)}</a> {self.words(self.r.randint(3, 20))}'
        return self.tag("p", text, close=self.r.random() < 0.85)

    def article(self) -> list[tuple[str, bool]]:
        r, parts = self.r, []
        if r.random() < 0.8:
            parts.append((f"<h1>{self.words(r.randint(2, 14))}</h1>", True))
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            if kind < 0.75:
                parts.append((self.paragraph(), True))
            elif kind < 0.8:
                parts.append((f"<h2>{self.words(r.randint(1, 6))}</h2>", True))
            elif kind < 0.84:
                parts.append((self.tag(r.choice(["ul", "ol"]), "".join(f"<li>{self.words(r.randint(1, 25))}</li>" for _ in range(r.randint(2, 6)))), True))
            elif kind < 0.87:
                parts.append((self.tag("blockquote", self.paragraph()), True))
            elif kind < 0.89:
                parts.append((self.tag("pre", self.words(r.randint(4, 40))), True))
            elif kind < 0.91:
                parts.append((self.tag("table", "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(3)}</td></tr>" for _ in range(r.randint(2, 5)))), True))
            elif kind < 0.94:
                parts.append((self.advert(), False))
            elif kind < 0.955:
                parts.append((self.control(), False))
            elif kind < 0.975:
                parts.append((self.tag("aside", self.words(r.randint(4, 30)), "related", "pullout", "promo", "sidebar"), False))
            else:
                parts.append((self.tag("div", self.paragraph(), "section", "text", "chapter"), True))
        if not parts:
            parts.append((self.paragraph(), True))
        if r.random() < 0.2:
            parts.append((self.tag("div", self.tag("ul", self.links(4, 1)), "share", "social", "share-buttons"), False))
        if r.random() < 0.25:
            parts.append((self.comments(), False))
        return parts

    def control(self) -> str:
        """A button, a selection, a drawing or a film with text for browsers that can't show it."""
        r = self.r
        options = "".join(f"<option>{self.words(r.randint(1, 2))}</option>" for _ in range(r.randint(2, 5)))
        return r.choice([
            self.tag("button", self.words(r.randint(1, 3)), "like", "btn", "share"), self.tag("select", options),
            f"<svg><text>{self.words(r.randint(1, 3))}</text></svg>", self.tag(r.choice(["video", "audio", "object", "canvas"]), self.words(r.randint(3, 10))),
        ])

    def advert(self) -> str:
        return self.tag(self.r.choice(["div", "div", "aside", "section", "p"]), self.r.choice([self.words(self.r.randint(3, 40)), self.paragraph()]), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad")

    def comments(self) -> str:
        each = "".join(self.tag(self.r.choice(["div", "li", "article", "p"]), self.r.choice([self.words(self.r.randint(3, 60)), self.paragraph()]), "comment", "reply", "comment-body") for _ in range(self.r.randint(1, 6)))
        return self.tag(self.r.choice(["div", "section", "ol"]), f"<h3>{self.words(2)}</h3>" * (self.r.random() < 0.6) + each, "comments", "comment-list", "discussion", "reader-comments", "responses")

    def around(self, end: bool) -> list[str]:
        r, out = self.r, []
        pool = [
            lambda: self.tag("nav", self.tag("ul", self.links(r.randint(2, 12)), "menu"), "nav", "main-nav", "breadcrumb"),
            lambda: self.tag("div", self.tag("ul", self.links(r.randint(2, 12))), "menu", "nav", "navbar", "topnav", "navigation"),
            lambda: self.tag("header", self.tag(r.choice(["div", "p", "h1", "h2"]), self.words(r.randint(1, 8))) + (self.tag("ul", self.links(4)) if r.random() < 0.5 else ""), "header", "site-header", "masthead"),
            self.advert,
            lambda: self.tag(r.choice(["div", "aside", "section"]), r.choice([self.words(r.randint(4, 40)), self.paragraph()]), "cookie", "notice", "cookie-banner", "alert", "consent", "newsletter", "popup"),
            lambda: self.tag(r.choice(["aside", "div"]), f"<h3>{self.words(2)}</h3>" + r.choice([self.tag("ul", self.links(r.randint(2, 8), 6)), self.paragraph(), self.words(20)]), "sidebar", "related", "widget", "side", "popular"),
            lambda: f"<form>{self.tag('label', self.words(2))}<input name=q>{self.words(r.randint(1, 8))}<button>{self.words(1)}</button></form>",
        ]
        if end:
            pool += [self.comments, self.comments, *[lambda: self.tag(r.choice(["footer", "footer", "div"]), r.choice([f"&copy; {self.words(r.randint(1, 20))}", self.paragraph(), self.tag("ul", self.links(5))]), "footer", "site-footer", "copyright", "foot")] * 4]
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4])):
            out.append(r.choice(pool)())
        return out


def training_page(rng: random.Random) -> tuple[str, list[tuple[str, bool]]]:
    """A page and its pieces in order, each with whether it is main text."""
    m = _Maker(rng)
    body = m.article()
    before, after = m.around(False), m.around(True)
    outer = rng.choice([("article", ()), ("article", ("post", "entry")), ("main", ()), ("div", ("content", "article", "post", "main", "entry-content", "story")), ("section", ("content", "article-body")), ("div", ())])
    pieces = [(x, False) for x in before] + [(x, y) for x, y in body] + [(x, False) for x in after]
    opened = m.tag(outer[0], "\0", *outer[1])
    inner = "".join(x for x, _ in body)
    if rng.random() < 0.2:
        inner = f"<div>{inner}</div>"
    middle = opened.replace("\0", inner)
    if rng.random() < 0.25:
        middle = m.tag("div", middle, "wrapper", "container", "page", "row")
    page = f"<!DOCTYPE html><html><head><title>{m.words(3)}</title></head><body>{''.join(before)}<!-- x -->{middle}{''.join(after)}</body></html>"
    if rng.random() < 0.1:
        page = page[: -rng.randint(5, 30)]
    return page, pieces


def labelled_nodes(rng: random.Random) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of one training page, and for each node whether all / none of its text is main, and whether it has text."""
    page, pieces = training_page(rng)
    marked = page
    for k, (piece, main) in enumerate(pieces):  # a private character before each text run says what it is
        tagged = re.sub(r"(>)([^<>]*[^<>\s][^<>]*)", lambda m, main=main: m[1] + (MAIN if main else OTHER) + m[2], piece)
        marked = marked.replace(piece, tagged, 1)
    nodes = flatten(parse(marked))
    main = np.zeros(len(nodes))
    other = np.zeros(len(nodes))
    index = {id(v): i for i, v in enumerate(nodes)}
    for i, v in enumerate(nodes):
        if v.tag == "#text":
            yes, no = v.text.count(MAIN), v.text.count(OTHER)
            main[i], other[i] = yes > 0 and yes >= no, no > 0 and no > yes
            if not yes and not no:
                other[i] = 1
            v.text = v.text.replace(MAIN, "").replace(OTHER, "")
            v.link_chars = min(v.link_chars, len(v.text))
    for i in range(len(nodes) - 1, 0, -1):
        p = index[id(nodes[i].parent)]
        main[p] += main[i]
        other[p] += other[i]
    return features(nodes), (main > 0) & (other == 0), (main == 0), main + other > 0


def train(pages: int = 700, seed: int = 7, **options) -> ContentModel:
    """Fit on ``pages`` made pages."""
    rng = random.Random(seed)
    made = [labelled_nodes(rng) for _ in range(pages)]
    x, content, boiler, real = (np.concatenate([m[k] for m in made]) for k in range(4))
    return ContentModel(BoostedTrees(**options).fit(x[real], content[real].astype(float)), BoostedTrees(**options).fit(x[real], boiler[real].astype(float)))


@lru_cache(maxsize=1)
def trained() -> ContentModel:
    """The model of the default settings, fitted once in a process."""
    return train()


def main_text(pages: DataFrame, model: ContentModel) -> DataFrame:
    """``page_id, url, text, n_chars`` of every whole page; row-local, no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):  # some pages at a time: their features stay small
                part = batch.slice(at, 50)
                texts = shared.value.extract([h.as_py() for h in part.column("html")])
                yield pa.record_batch(
                    [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
