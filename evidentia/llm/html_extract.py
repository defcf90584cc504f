"""The main text of web pages by a tree-structured graphical model.

A page's block elements form a tree; each is content or not. A node's potential is a sum of weights of its features (tag, words
in class, id and role, length and link density of its text); parent and child share a potential of their two labels. Messages
upward and then downward give each node's marginal. A run of text belongs to the innermost block element around it and is kept
if that element is content with probability 0.5 or more.

Weights maximise the likelihood of labelled pages, whose labels are marked in the pages (`data-content`); `labelled_pages`
writes such pages with usual layouts.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.common import map_batches, slices

#: What follows the name in a tag: quoted values (after an equals sign only) may hold a >. An unclosed quote or tag ends with the page.
_REST = r"(?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)"
#: Comments, elements whose inside is no text, tags, and declarations. Nothing is tried twice at a sign, so that time is linear.
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<skip>script|style|noscript|template|textarea|select|iframe|svg|title)(?=[\s/>])(?P<in>{_REST})|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>{_REST})|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: End tags of elements whose inside is no text.
_ENDS = {x: re.compile(rf"</{x}\s*+>", re.I) for x in "script style noscript template textarea select iframe svg title".split()}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Which open elements a start tag closes, up to the given containers.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"})}
_HINTS = {
    "ad": r"\bads?\b|advert|sponsor|promo|banner", "nav": r"nav|menu|breadcrumb|pagination|pager|toc\b|skip", "foot": r"foot|copyright|colophon|legal", "head": r"head|masthead|topbar|logo",
    "side": r"side|widget|related|recommend|popular|trending|more-", "comment": r"comment|repl(y|ies)|discuss|respond|disqus|feedback", "notice": r"cookie|consent|notice|gdpr|alert|modal|popup|overlay|toast|paywall", "share": r"share|social|follow",
    "form": r"form|login|sign|subscribe|newsletter|search", "body": r"content|article|post|entry|main|body|story|text|prose",
}
_HINT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _HINTS.items()), re.I)


@dataclass
class Node:
    tag: str
    parent: int
    attributes: str = ""
    own: int = 0
    total: int = 0
    linked: int = 0
    blocks: int = 0
    features: list[str] = field(default_factory=list)
    label: int | None = None


def _collapse(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, and the runs of text (element, text) in page order. Unclosed elements are closed as needed."""
    nodes, runs = [Node("#page", -1)], []
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements; inline ones have -1
    blocks: list[tuple[int, int]] = [(0, 0)]  # open block elements: node, depth in the stack
    depths: dict[str, list[int]] = defaultdict(list)  # of each tag the depths of its open elements
    parts: list[str] = []
    link_parts: list[str] = []

    def flush() -> None:
        nonlocal parts, link_parts
        text = _collapse(parts) if parts else ""
        if text:
            k = blocks[-1][0]
            runs.append((k, text))
            nodes[k].own += len(text)
            nodes[k].blocks += 1
            nodes[k].linked += min(len(text), len(_collapse(link_parts)))
        parts, link_parts = [], []

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            tag, block = stack.pop()
            depths[tag].pop()
            if block >= 0:
                flush()
                blocks.pop()

    def nearest(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=-1)

    def say(text: str) -> None:
        parts.append(text)
        if depths.get("a"):
            link_parts.append(text)

    at, page = 0, page or ""
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m["skip"]:
            name = m["skip"].lower()
            if name == "svg" and m["in"].endswith("/>"):
                continue
            end = _ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            parts.append(" ")
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag, attributes = tag.lower(), m["rest"].rstrip(">")
        if m["end"]:
            depth = nearest((tag,))
            if depth > (blocks[-1][1] if tag in _INLINE else 0):
                close_to(depth)
            continue
        if tag in _VOID:
            parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in _INLINE:
            if not attributes.endswith("/"):
                depths[tag].append(len(stack))
                stack.append((tag, -1))
            continue
        flush()
        node, depth = blocks[-1]
        if nodes[node].tag == "p" and depth:  # a block element ends an open paragraph
            close_to(depth)
        if tag in _CLOSES:
            closed, within = _CLOSES[tag]
            depth = nearest(closed)
            if depth > max(0, nearest(within)):
                close_to(depth)
        nodes.append(Node(tag, blocks[-1][0], attributes))
        if not attributes.endswith("/"):
            depths[tag].append(len(stack))
            blocks.append((len(nodes) - 1, len(stack)))
            stack.append((tag, len(nodes) - 1))
    if at < len(page):
        say(page[at:])
    close_to(1)
    flush()
    for k in range(len(nodes) - 1, 0, -1):
        n = nodes[k]
        n.total += n.own
        p = nodes[n.parent]
        p.total += n.total
        p.linked += n.linked
        p.blocks += n.blocks
    nodes[0].total += nodes[0].own
    for n in nodes:
        _describe(n)
    return nodes, runs


def _describe(n: Node) -> None:
    share = n.linked / n.total if n.total else 0.0
    out = ["bias", f"tag={n.tag}", f"length={min(8, int(math.log2(n.total + 1)))}", f"own={min(8, int(math.log2(n.own + 1)))}", f"links={int(share * 4)}", f"blocks={min(5, n.blocks)}"]
    if n.attributes:
        for name, value in _ATTRIBUTE.findall(n.attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                out += {f"hint={h.lastgroup}" for h in _HINT.finditer(value)}
            elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
                out.append("hidden")
            elif name == "data-content":
                n.label = int(value == "1")
    n.features = out


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def marginals(parents: list[int], potentials: list[tuple[float, float]], edge: tuple[float, float, float, float]) -> tuple[list[float], list[tuple[float, ...]], float]:
    """Probability of content of each node, of each (parent label, label) pair, and the log partition sum.

    Parents stand before their children. potentials: log potentials of the labels 0 and 1; edge: of the pairs 00, 01, 10, 11.
    """
    n = len(parents)
    e00, e01, e10, e11 = edge
    up = [list(p) for p in potentials]
    to_parent: list[tuple[float, float]] = [(0.0, 0.0)] * n
    for k in range(n - 1, 0, -1):
        a, b = up[k]
        m0, m1 = _log_add(a + e00, b + e01), _log_add(a + e10, b + e11)
        to_parent[k] = m0, m1
        up[parents[k]][0] += m0
        up[parents[k]][1] += m1
    total = _log_add(*up[0])
    belief = [up[0]] + [None] * (n - 1)
    pairs: list[tuple[float, ...]] = [()] * n
    for k in range(1, n):
        rest0, rest1 = belief[parents[k]][0] - to_parent[k][0], belief[parents[k]][1] - to_parent[k][1]
        a, b = up[k]
        joint = rest0 + e00 + a, rest0 + e01 + b, rest1 + e10 + a, rest1 + e11 + b
        belief[k] = [_log_add(joint[0], joint[2]), _log_add(joint[1], joint[3])]
        pairs[k] = tuple(math.exp(min(0.0, j - total)) for j in joint)
    return [math.exp(min(0.0, b[1] - total)) for b in belief], pairs, total


@dataclass(frozen=True)
class TreeModel:
    weights: dict[str, float]
    edge: tuple[float, float, float, float]

    def content(self, nodes: list[Node]) -> list[float]:
        w = self.weights.get
        return marginals([x.parent for x in nodes], [(0.0, sum(w(f, 0.0) for f in x.features)) for x in nodes], self.edge)[0]


def train(pages: list[str], rounds: int = 120, rate: float = 0.3, penalty: float = 0.0005) -> TreeModel:
    """Gradient ascent on the likelihood of labelled pages; an element without a mark has its parent's label, the page 0."""
    parsed = []
    for page in pages:
        nodes, _ = parse(page)
        for x in nodes:
            if x.label is None:
                x.label = nodes[x.parent].label if x.parent >= 0 else 0
        parsed.append(nodes)
    names = sorted({f for nodes in parsed for x in nodes for f in x.features})
    index = {f: i for i, f in enumerate(names)}
    data = [([x.parent for x in nodes], [np.array([index[f] for f in x.features]) for x in nodes], [x.label for x in nodes]) for nodes in parsed]
    w, edge = np.zeros(len(names)), np.array([0.5, 0.0, 0.0, 0.5])
    gw, ge = np.full(len(names), 1e-6), np.full(4, 1e-6)
    for _ in range(rounds):
        dw, de = -penalty * w * len(data), np.zeros(4)
        for parents, features, labels in data:
            prob, pairs, _ = marginals(parents, [(0.0, float(w[f].sum())) for f in features], tuple(edge))
            for k, f in enumerate(features):
                dw[f] += labels[k] - prob[k]
                if k:
                    de -= pairs[k]
                    de[2 * labels[parents[k]] + labels[k]] += 1
        dw, de = dw / len(data), de / len(data)
        gw, ge = gw + dw * dw, ge + de * de
        w, edge = w + rate * dw / np.sqrt(gw), edge + rate * de / np.sqrt(ge)
    return TreeModel(dict(zip(names, w.tolist(), strict=True)), tuple(edge.tolist()))


def labelled_pages(n: int = 240, seed: int = 3) -> list[str]:
    """Pages of usual layouts with marked content: menus, headers, sidebars, notices, adverts, forms, comments around and in an article."""
    r = random.Random(seed)
    syllables = "ba de ki lo mu ne po ra si to vu we za chi gro pla ster ing al en or".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    line = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice(["", ".", "."])
    links = lambda k: "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(k))
    plain = lambda *names: f'class="{r.choice(names)}"' if r.random() < 0.75 else f'class="c{r.randint(1, 40)}"'

    def paragraph() -> str:
        text = " ".join(line(*r.choice([(1, 2), (3, 18), (3, 18)])) for _ in range(r.choice([1, 1, 2, 4, 8, 20])))
        if r.random() < 0.2:
            text += f' <a href="#">{line(1, 3)}</a> ' + line(3, 9)
        return r.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{line(2, 9)}<br><p>{text}</p>", f"<blockquote>{text}</blockquote>", f"<h2>{line(2, 6)}</h2><p>{text}</p>", "<ul>" + "".join(f"<li>{line(2, 12)}" for _ in range(3)) + "</ul>", f"<pre>{text}</pre>"])

    def aside() -> str:
        return r.choice([
            lambda: f'<aside {plain("sidebar", "widget")} data-content="0"><h3>{line(1, 4)}</h3><ul>{links(4)}</ul><p>{line(4, 16)}</p></aside>',
            lambda: f'<div {plain("ad", "ads", "advert", "sponsored", "promo-box")} data-content="0">{line(3, 14)}</div>',
            lambda: f'<div {plain("cookie-notice", "notice", "consent", "alert")} data-content="0"><p>{line(5, 16)}</p><button>{line(1, 2)}</button></div>',
            lambda: f'<form {plain("search", "newsletter", "subscribe")} data-content="0"><label>{line(1, 4)}</label><input name="q"><button>{line(1, 2)}</button><p>{line(3, 10)}</p></form>',
            lambda: f'<div {plain("share", "social-links")} data-content="0"><a href="#">{line(1, 2)}</a> <a href="#">{line(1, 2)}</a></div>',
            lambda: f'<div {plain("related", "recommended", "more-stories")} data-content="0"><h3>{line(1, 3)}</h3><ul>{links(3)}</ul></div>',
        ])()

    def comments() -> str:
        each = "".join(f'<{t}{r.choice(["", " " + plain("comment", "reply")])}><p>{line(4, 30)} {line(3, 12)}</p></{t}>' for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 4)))
        tag = r.choice(["section", "div", "ol"])
        return f'<{tag} {r.choice(["id", "class"])}="{r.choice(["comments", "comment-list", "discussion", "responses", "replies"])}" data-content="0"><h3>{line(1, 2)}</h3>{each}</{tag}>'

    pages = []
    for _ in range(n):
        terse = r.random() < 0.25
        body = [f"<p>{line(1, 2)}</p>" for _ in range(r.choice([1, 2, 6, 30]))] if terse else [paragraph() for _ in range(r.choice([1, 2, 4, 8, 14]))]
        for _ in range(r.choice([0, 0, 1, 2])):
            body.insert(r.randint(1, len(body)), aside())
        open_tag, close = r.choice([("<article>", "</article>"), ("<article>", "</article>"), (f'<article {plain("post", "entry")}>', "</article>"), (f'<main {plain("content")}>', "</main>"), (f'<div {plain("content", "post-body", "entry-content", "article-text")}>', "</div>"), ('<div id="main">', "</div>"), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>")])
        article = open_tag.replace(">", ' data-content="1">', 1) + (f"<h1>{line(2, 9)}</h1>" if r.random() < 0.9 else "") + "".join(body) + close
        top = [f'<nav data-content="0"><ul>{links(r.randint(2, 8))}</ul></nav>'] if r.random() < 0.8 else [f'<div {plain("menu", "nav", "navbar")} data-content="0"><ul>{links(6)}</ul></div>']
        if r.random() < 0.5:
            top.insert(0, f'<header {plain("header", "masthead")} data-content="0"><div>{line(1, 4)}</div><p>{line(3, 7)}</p></header>')
        top += [aside() for _ in range(r.choice([0, 1, 1, 2]))]
        bottom = [aside() for _ in range(r.choice([0, 0, 1, 2]))] + ([comments()] if r.random() < 0.4 else [])
        bottom.append(f'<footer data-content="0">&copy; {line(1, 12)} <a href="/">{line(1, 2)}</a></footer>' if r.random() < 0.8 else f'<div {plain("footer", "copyright")} data-content="0"><p>{line(3, 12)}</p></div>')
        wrap = r.choice([("", ""), ("<div>", "</div>"), ('<div class="wrapper">', "</div>"), ("<main>", "</main>")])
        pages.append(f"<!DOCTYPE html><html><head><title>{line(2, 8)}</title><style>p{{margin:0}}</style></head><body>{''.join(top)}{wrap[0]}{article}{''.join(bottom[:-1])}{wrap[1]}{bottom[-1]}</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    """The model of the generated pages; a process trains it once."""
    return train(labelled_pages())


def main_text(page: str | None, model: TreeModel) -> str:
    """The kept runs of text, one per line."""
    nodes, runs = parse(page)
    if not runs:
        return ""
    content = model.content(nodes)
    return "\n".join(text for k, text in runs if content[k] >= 0.5)


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars (long).

    A null or empty page gives an empty text, as does one without content. Equal pages give equal texts, other columns are
    ignored, an empty table gives an empty result. The model is trained here from `labelled_pages` unless one is given.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(x, model) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
