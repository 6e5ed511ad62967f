"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements with runs of text as leaves. Every node
is content or not; its own features (tag, words of its class, id and role, length,
links, punctuation) give a unary potential, and each edge a parent-child potential.
Sum-product messages up and down the tree give the exact marginals; the text of
leaves with a marginal of a half and more is the main text.

Potentials are fitted to labelled pages: pages made by ``labelled_pages`` and a
bounded sample of given pages whose markup names the article.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.quality import _newton

#: Given pages that the model is fitted to at most.
SAMPLE = 400
# Element names of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = set(
    "script style noscript template textarea select option button iframe svg head object".split()
)
#: Hidden elements whose tags inside are text.
_RAW = set("script style textarea iframe".split())
_BLOCKS = set(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p "
    "pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_CLOSES_P = _BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
_SAME_CLOSES = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"},
}
_HIDDEN_CLOSES = {
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "select": {"select"}, "button": {"button"},
}
_LIMITS = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "main", "aside"}
_WORDS = re.compile(r"[a-z]+")
_SENTENCE_END = re.compile(r"[.!?;:,…]")


@dataclass
class Node:
    """An element or a run of text (``tag`` is "")."""

    tag: str
    parent: int
    names: str = ""
    text: str = ""
    linked: int = 0  # characters of text inside links
    children: list[int] = field(default_factory=list)
    label: str | None = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", -1)]
        self.nodes[0].tag = "root"
        self.open: list[tuple[str, int]] = [("root", 0)]  # tag, block it belongs to
        self.count: Counter[str] = Counter()  # open elements by tag
        self.hidden = 0
        self.links = 0
        self.run: list[str] = []
        self.run_linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self._add("", text=text, linked=self.run_linked)
        self.run, self.run_linked = [], 0

    def _add(self, tag: str, **more) -> int:
        at = self.open[-1][1]
        self.nodes.append(Node(tag, at, **more))
        self.nodes[at].children.append(len(self.nodes) - 1)
        return len(self.nodes) - 1

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            if self.open[-1][0] in _RAW or tag in _VOID:
                return
            if tag in _HIDDEN_CLOSES:
                self._close_until(_HIDDEN_CLOSES[tag], _LIMITS)
            # What is still hidden is kept open too, so that its end tags find it.
            if self.hidden:
                self._push(tag, self.open[-1][1])
                self.hidden += tag in _HIDDEN and tag != "head"
                self.links += tag == "a"
                return
        if tag == "body" or tag not in ("html", "head") and self.open[-1][0] == "head":
            self._close_until({"head"}, set())
        if tag in _HIDDEN:
            self.flush()
            self._push(tag, self.open[-1][1])
            self.hidden += tag != "head"
            return
        if tag in ("br", "img", "wbr"):
            self.run.append(" ")
            return
        if tag in _BLOCKS:
            self.flush()
            if tag in _CLOSES_P:
                self._close_until({"p"}, _LIMITS)
            if tag in _SAME_CLOSES:
                self._close_until(_SAME_CLOSES[tag], {"ul", "ol", "dl", "table"})
            if tag in _VOID:
                return
            values = {k: v or "" for k, v in attrs}
            names = " ".join(values.get(k, "") for k in ("class", "id", "role")).lower()
            number = self._add(tag, names=names, label=values.get("data-label"))
            self._push(tag, number)
        elif tag not in _VOID:
            self._push(tag, self.open[-1][1])
            self.links += tag == "a"

    def _push(self, tag: str, block: int) -> None:
        self.open.append((tag, block))
        self.count[tag] += 1

    def parse_marked_section(self, i, report=1):
        """Whatever begins with ``<![`` is a comment that ends at the next ``>``."""
        return self.parse_bogus_comment(i)

    def parse_comment(self, i, report=True):
        """A comment without an end takes the rest of the page."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end

    def _close_until(self, tags: set[str], limits: set[str]) -> None:
        if not any(self.count[tag] for tag in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                self._close_from(k)
                return
            if self.open[k][0] in limits:
                return

    def _close_from(self, at: int) -> None:
        if any(tag in _BLOCKS for tag, _ in self.open[at:]):
            self.flush()
        for tag, _ in self.open[at:]:
            self.links -= tag == "a" and self.links > 0
            self.hidden -= tag in _HIDDEN and tag != "head" and self.hidden > 0
            self.count[tag] -= 1
        del self.open[at:]

    def handle_endtag(self, tag):
        if tag == "br":
            self.run.append(" ")
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self._close_from(k)
                return
            if self.open[k][0] in _RAW:
                return

    def handle_data(self, data):
        if self.hidden or self.count["head"] or self.count["title"]:
            return
        self.run.append(data)
        self.run_linked += len(data.strip()) if self.links else 0


def tree(html: str) -> list[Node]:
    """Nodes of a page in page order, parents before children. Any text is a page."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder.flush()
    return builder.nodes


# --- model -------------------------------------------------------------------------


def _own_features(nodes: list[Node], k: int) -> list[str]:
    node = nodes[k]
    if node.tag:
        return [f"tag {node.tag}", *(f"name {w}" for w in set(_WORDS.findall(node.names)))]
    words = node.text.count(" ") + 1
    linked = node.linked / max(len(node.text), 1)
    signs = len(_SENTENCE_END.findall(node.text)) / words
    parent = nodes[node.parent].tag
    return [
        "text",
        f"words {min(words.bit_length(), 6)}",
        f"links {min(int(linked * 4), 3)}",
        f"signs {min(int(signs * 20), 3)}",
        f"in {parent}",
    ]


@dataclass
class Model:
    """Log-potentials: of features for content, and of (child is text, parent state,
    child state)."""

    weights: dict[str, float]
    edges: np.ndarray
    root: float

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of content of each node, by messages to the root and back."""
        own = [
            sum(self.weights.get(f, 0.0) for f in _own_features(nodes, k)) for k in range(len(nodes))
        ]
        own[0] += self.root
        edges = self.edges.tolist()
        up = [0.0] * len(nodes)  # log-odds that a child's side says about its parent
        below = own[:]
        for k in range(len(nodes) - 1, 0, -1):
            up[k] = _through(edges[not nodes[k].tag], below[k], False)
            below[nodes[k].parent] += up[k]
        belief = below[:]
        for k in range(1, len(nodes)):
            parent = nodes[k].parent
            belief[k] = below[k] + _through(edges[not nodes[k].tag], belief[parent] - up[k], True)
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, b)))) for b in belief]


def _through(edge, odds: float, down: bool) -> float:
    """Log-odds of one end of an edge from those of the other; ``edge[parent][child]``."""
    a = edge if down else [[edge[j][i] for j in (0, 1)] for i in (0, 1)]
    odds = max(-40.0, min(40.0, odds))
    given = math.exp(odds)
    yes = math.exp(a[0][1]) + given * math.exp(a[1][1])
    no = math.exp(a[0][0]) + given * math.exp(a[1][0])
    return math.log(yes / no)


def _states(nodes: list[Node], labelled: bool) -> list[int] | None:
    """Known state of every node: of text from the nearest element that tells, of an
    element from the larger part of its text. None if no element tells."""
    tells = _label if labelled else _markup
    state, told = [0] * len(nodes), False
    content, total = [0] * len(nodes), [0] * len(nodes)
    for k in range(1, len(nodes)):
        said = tells(nodes[k])
        told = told or said == 1
        inherited = state[nodes[k].parent]
        state[k] = inherited if said is None else said
        if not nodes[k].tag:
            total[k], content[k] = len(nodes[k].text), state[k] * len(nodes[k].text)
    for k in range(len(nodes) - 1, 0, -1):
        total[nodes[k].parent] += total[k]
        content[nodes[k].parent] += content[k]
        if nodes[k].tag and total[k]:
            state[k] = int(2 * content[k] > total[k])
    state[0] = int(2 * content[0] > total[0])
    return state if told else None


def _label(node: Node) -> int | None:
    return None if node.label is None else int(node.label == "content")


def _markup(node: Node) -> int | None:
    if node.tag in ("article", "main"):
        return 1
    return 0 if node.tag in ("nav", "aside", "footer", "form") else None


def fit(pages: list[tuple[list[Node], list[int]]], first: int | None = None) -> Model:
    """Potentials from nodes with known states: a logistic regression of a node's state
    on its features, and for each kind of edge how much more often two states meet
    than by chance. Nodes of the ``first`` pages count more often the more of them are
    alike; all alike nodes of the others count once, as they come from few layouts."""
    names = Counter(f for nodes, _ in pages for k in range(len(nodes)) for f in _own_features(nodes, k))
    order = sorted(f for f, n in names.items() if n >= 3)
    place = {f: k for k, f in enumerate(order)}
    # Rows with the same features and state are one row with a weight; all counts small.
    rows = Counter(
        (tuple(sorted(place[f] for f in _own_features(nodes, k) if f in place)), states[k])
        for nodes, states in pages[:first]
        for k in range(1, len(nodes))
    )
    for nodes, states in pages[len(pages) if first is None else first :]:
        for k in range(1, len(nodes)):
            rows.setdefault(
                (tuple(sorted(place[f] for f in _own_features(nodes, k) if f in place)), states[k]), 0
            )
    x, y = [], []
    for (features, state), n in sorted(rows.items()):
        line = np.zeros(len(order))
        line[list(features)] = 1
        for _ in range(1 + n.bit_length()):
            x.append(line)
            y.append(state)
    found = _newton(np.array(x), np.array(y, float), 1e-4)
    meet = np.ones((2, 2, 2))
    for nodes, states in pages:
        for k in range(1, len(nodes)):
            meet[int(not nodes[k].tag), states[nodes[k].parent], states[k]] += 1
    share = meet / meet.sum(axis=(1, 2), keepdims=True)
    edges = np.log(share / (share.sum(axis=2, keepdims=True) * share.sum(axis=1, keepdims=True)))
    weights = {f: float(found[k] + found[-1] * (f == "text" or f.startswith("tag "))) for f, k in place.items()}
    return Model(weights, edges, float(found[-1]))


# --- labelled pages ------------------------------------------------------------------

_FILLER = (
    "the report says that water levels in the valley rose again, and residents were told to stay "
    "away from the river until the morning. Officials expect the rain to end soon; repairs begin "
    "on Monday, after engineers have looked at the bridge."
).split()


def _words(start: int, count: int) -> str:
    return " ".join(_FILLER[(start + k) % len(_FILLER)] for k in range(count))


def labelled_pages() -> list[str]:
    """Pages with ``data-label`` on the elements that tell content from the rest: all
    combinations of some layouts of the article with some of what surrounds it."""
    links = lambda n: "".join(f"<li><a href='/{k}'>{_words(k, 1 + k % 3)}</a></li>" for k in range(n))
    frames = [
        ("article", ""), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "main"),
        ("section", "post"), ("div", "entry"), ("section", "story"),
    ]
    # Element, names it may have ("" only where the element itself tells), what is inside.
    around = [
        ("nav", ["", "menu", "navigation"], f"<ul>{links(6)}</ul>"),
        ("div", ["navbar", "menu", "topbar", "nav", "breadcrumb"], f"<ul>{links(5)}</ul>"),
        ("header", ["", "site-header", "banner"], f"<p>{_words(3, 4)}</p>"),
        ("div", ["ad", "advert", "advertisement", "sponsored", "promo"], _words(9, 12)),
        ("aside", ["", "sidebar"], f"<h3>{_words(2, 2)}</h3><p>{_words(20, 25)}</p><ul>{links(4)}</ul>"),
        ("div", ["sidebar", "related", "widget"], f"<p>{_words(6, 22)}</p><ul>{links(3)}</ul>"),
        ("div", ["cookie", "consent", "notice", "popup", "alert"], f"<p>{_words(11, 18)}</p>"),
        ("section", ["comments", "comment", "replies", "discussion"], f"<h2>{_words(1, 2)}</h2>"
         f"<div><p>{_words(5, 30)}</p></div><p>{_words(17, 14)}</p>"),
        ("div", ["comments", "comment", "comment-list"], f"<p>{_words(12, 26)}</p><p>{_words(2, 15)}</p>"),
        ("form", ["", "newsletter", "subscribe", "search"], f"<label>{_words(4, 3)}</label><p>{_words(7, 9)}</p>"),
        ("div", ["share", "social", "tags", "meta"], f"<a>{_words(6, 2)}</a> <a>{_words(8, 1)}</a>"),
        ("footer", ["", "copyright", "contentinfo"], f"<p>&copy; {_words(14, 16)}</p>"),
        ("div", ["footer", "bottom", "legal"], f"&copy; {_words(15, 8)}"),
    ]
    count = len(around)

    def other(which: int, turn: int) -> str:
        tag, names, inner = around[which % count]
        name = names[turn % len(names)]
        given = f" {('class', 'id')[turn % 2]}='{name}'" if name else ""
        return f"<{tag}{given} data-label='no'>{inner}</{tag}>"

    pages = []
    for turn, ((tag, name), inside, first) in enumerate(
        product(frames, (False, True, False, True), range(count))
    ):
        given = f" {('class', 'id')[turn % 2]}='{name}'" if name else ""
        body = "".join(f"<p>{_words(k * 7 + first, 15 + k * 9)}</p>" for k in range(1 + first % 4))
        head = f"<h1>{_words(first, 6)}</h1>"
        head = f"<header>{head}</header>" if first % 3 == 2 else head
        more = (
            f"<blockquote><p>{_words(first, 12)}</p></blockquote><ul><li>{_words(first, 8)}</li></ul>"
            f"<table><tr><th>{_words(first, 1)}</th><td>{_words(first, 2)}</td></tr></table>"
            f"<h2>{_words(9, 3)}</h2><p>{_words(first + 3, 20)}</p>"
        )
        within = other(first, turn) + other(first + 7, turn // 3) if inside else ""
        article = f"<{tag}{given} data-label='content'>{head}{body}{more}{within}</{tag}>"
        if turn % 5 == 0:
            article = f"<main data-label='content'>{article}{other(first + 5, turn // 2)}</main>"
        before = other(first + 1, turn // 2) + other(first + 3, turn // 4)
        after = other(first + 4, turn // 3) + other(first + 8, turn // 5)
        pages.append(f"<html><body>{before}{article}{after}</body></html>")
    return pages


def trained(pages: DataFrame) -> Model:
    """Model from the labelled pages and at most ``SAMPLE`` given pages, in hash order of
    their ids, whose markup names the article."""
    known = [tree(page) for page in labelled_pages()]
    examples = [(nodes, _states(nodes, True)) for nodes in known]
    rows = (
        pages.select("page_id", "html")
        .filter(F.col("html").rlike("<(article|main)[ >]"))
        .withColumn("_o", F.xxhash64("page_id"))
        .orderBy("_o", "page_id", F.length("html"), F.md5("html"))
        .limit(SAMPLE)
        .select("html")
        .collect()
    )
    for row in rows:
        nodes = tree(row["html"])
        states = _states(nodes, False)
        if states is not None:
            examples.append((nodes, states))
    return fit(examples, len(known))


def main_text(html: str, model: Model) -> str:
    """The blocks of main text, one on a line."""
    nodes = tree(html)
    chances = model.marginals(nodes)
    return "\n".join(n.text for n, p in zip(nodes, chances, strict=True) if not n.tag and p >= 0.5)


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text`` of each row of ``pages``; null html gives an empty text.

    Repeated rows stay repeated, other columns are not looked at, ids and urls may be
    null. Every page is handled alone: no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches):
        for batch in batches:
            texts = [main_text(html or "", shared.value) for html in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(
        read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    )
