"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a binary variable, content or not.  Its own potential comes
from a logistic model of its tag, the words of its class and id, and the text
and links below it; a potential for each parent and child, by the kind of the
child, says how labels pass along an edge.  Sum-product messages go up from the
leaves and down from the root, which gives exact marginals on a tree.  Both
parts are trained from labelled pages: pages composed from many site layouts,
in which the place of the article is known.  Text counts if the element that
holds it is content with probability of at least one half.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html import unescape
from math import exp, log1p
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Fixed values of HTML: elements without content, with raw text, that close an open p, and that flow in a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend button select option label".split())
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption legend option label button select".split())
#: A start tag that ends an open element, and the elements at which the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements whose text is never read.
P_SCOPE = ("button", "td", "th", "caption", "table", "object")
UNREAD = RAW | frozenset("head select button object canvas svg math".split())
#: Groups of words in class and id, each a feature.
WORDS = ("nav menu breadcrumb pagination pager toc", "header masthead banner topbar branding", "footer foot copyright colophon legal", "sidebar side aside widget rail related recommended popular", "ad ads advert advertisement sponsor sponsored promo promotion", "cookie consent notice alert popup modal newsletter subscribe banner gdpr overlay", "comment comments reply respond disqus discussion", "share social follow login search form signup", "article content main post entry story body text prose")
TAGS = ("article main section div p h1 h2 h3 h4 h5 h6 nav header footer aside form ul ol li a table td tr blockquote pre figure figcaption span b i em strong body html dl dd dt label dialog menu address small").split()
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.S)
_STARTS = re.compile(r"</?[a-zA-Z]")
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_KINDS = {t: i for i, t in enumerate(TAGS)}
_SIZE = len(TAGS) + len(WORDS) + 6


@dataclass
class Page:
    """Elements in document order: parent, tag, names; and runs of text with their element and block."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)


def _tokens(html: str) -> Iterator[re.Match]:
    """Comments and tags.  Once a tag's quotes run to the end of the page, later ones end at their first '>'."""
    pattern, at, last = _TOKEN, 0, html.rfind(">")
    while (at := html.find("<", at)) >= 0:
        comment = html.startswith("<!--", at)
        if at > last and not comment:
            return
        m = pattern.match(html, at)
        if not m and pattern is _TOKEN and _STARTS.match(html, at):
            pattern = _PLAIN
            m = pattern.match(html, at)
        at = m.end() if m else at + 1
        if m:
            skip = yield m
            at = skip or at


def parse(html: str) -> Page:
    """The element tree of a page, with omitted end tags supplied; never fails, and takes time in proportion."""
    page, stack, block, blocks, at = Page([-1], ["#root"], [""]), [0], 0, 0, 0
    places: dict[str, list[int]] = {}  # where in the stack elements of a tag are open

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            page.texts.append((stack[-1], block, unescape(piece)))
        elif piece and page.texts and page.texts[-1][1] == block:
            page.texts.append((stack[-1], block, " "))

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(index: int) -> None:
        nonlocal block, blocks
        gone = [page.tag[n] for n in stack[index:]]
        if any(t in BLOCKS for t in gone):
            blocks += 1
            block = blocks
        for t in gone:
            places[t].pop()
        del stack[index:]

    found, skip = _tokens(html), None
    while True:
        try:
            m = found.send(skip)
        except StopIteration:
            break
        skip = None
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in CLOSES_P and innermost(("p",)) > innermost(P_SCOPE):
            close(places["p"][-1])
        if tag in ENDS:
            ended, stops = ENDS[tag]
            if (index := innermost(ended)) > innermost(stops - ended):
                close(index)
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                blocks += 1
                block = blocks
            continue
        node = len(page.tag)
        page.parent.append(stack[-1])
        page.tag.append(tag)
        page.names.append(" ".join(x for g in _NAMES.findall(m[3]) for x in g if x).lower() if m[3] else "")
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            skip = at = end.end() if end else len(html)
            continue
        if m[3].endswith("/") and tag in ("svg", "path", "math"):
            continue
        if tag in BLOCKS:
            blocks += 1
            block = blocks
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
    text(html[at:])
    return page


def features(page: Page) -> np.ndarray:
    """What the own potential of each element reads."""
    n = len(page.tag)
    x = np.zeros((n, _SIZE))
    words, linked = np.zeros(n), np.zeros(n)
    for node, _, t in page.texts:
        words[node] += t.count(" ") + 1
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[page.parent[i]] or page.tag[i] == "a"
        linked[i] = words[i] if inside[i] else 0
    paragraphs = np.array([t == "p" for t in page.tag], float)
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        words[up] += words[i]
        linked[up] += linked[i]
        paragraphs[up] += paragraphs[i]
    for i, (tag, names) in enumerate(zip(page.tag, page.names, strict=True)):
        if tag in _KINDS:
            x[i, _KINDS[tag]] = 1
        if names:
            own = set(_SPLIT.split(names))
            for j, group in enumerate(_groups()):
                if own & group:
                    x[i, len(TAGS) + j] = 1
    at = len(TAGS) + len(WORDS)
    x[:, at] = np.log1p(np.minimum(words, 200)) / 5  # beyond what layouts in training show, size tells nothing more
    x[:, at + 1] = linked / np.maximum(words, 1)
    x[:, at + 2] = np.log1p(np.minimum(paragraphs, 8)) / 3
    x[:, at + 3] = words > 25
    x[:, at + 4] = words / max(words[0], 1)
    x[:, at + 5] = 1
    return x


@cache
def _groups() -> list[frozenset]:
    return [frozenset(g.split()) for g in WORDS]


def edge_kind(tag: str, names: str) -> int:
    """Kinds of edges by the child: in a line, text block, named container, other block."""
    if tag not in BLOCKS:
        return 0
    if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "tr", "blockquote", "pre", "dd", "dt"):
        return 1
    if names or tag in ("nav", "header", "footer", "aside", "form", "article", "main", "dialog", "menu"):
        return 2
    return 3


@dataclass
class TreeModel:
    """Weights of the own potentials and log potentials (kind, parent label, child label) of the edges."""

    weights: np.ndarray
    edges: np.ndarray

    def marginals(self, page: Page) -> np.ndarray:
        """The probability of content of each element."""
        return np.array(self.infer(features(page) @ self.weights, _kinds_of(page), page.parent)[0])

    def infer(self, own: np.ndarray, kinds: list[int], parent: list[int], pairs: bool = False) -> tuple[list[float], np.ndarray]:
        """Marginals by sum-product up and down the tree; with ``pairs`` the summed ones of edges by kind."""
        n, total = len(kinds), np.zeros((4, 2, 2))
        belief = [[-x / 2, x / 2] for x in own.tolist()]
        edges = self.edges.tolist()
        up: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):  # children come after their parent
            e, (b0, b1), p = edges[kinds[i]], belief[i], belief[parent[i]]
            up[i] = (_log_add(e[0][0] + b0, e[0][1] + b1), _log_add(e[1][0] + b0, e[1][1] + b1))
            p[0] += up[i][0]
            p[1] += up[i][1]
        out = []
        for i in range(n):
            if i:
                e, (p0, p1), b = edges[kinds[i]], belief[parent[i]], belief[i]
                p0, p1 = p0 - up[i][0], p1 - up[i][1]  # what the parent knows without this child
                if pairs:
                    joint = np.array([[e[0][0] + p0 + b[0], e[0][1] + p0 + b[1]], [e[1][0] + p1 + b[0], e[1][1] + p1 + b[1]]])
                    joint = np.exp(joint - joint.max())
                    total[kinds[i]] += joint / joint.sum()
                m0, m1 = _log_add(e[0][0] + p0, e[1][0] + p1), _log_add(e[0][1] + p0, e[1][1] + p1)
                b[0] += m0
                b[1] += m1
            out.append(1 / (1 + exp(min(max(belief[i][0] - belief[i][1], -500), 500))))
        return out, total


def _kinds_of(page: Page) -> list[int]:
    return [edge_kind(t, c) for t, c in zip(page.tag, page.names, strict=True)]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + log1p(exp(-abs(a - b))) if abs(a - b) < 40 else max(a, b)


def labelled_pages(count: int, seed: int = 5) -> Iterator[str]:
    """Pages of many layouts; elements of the article carry the attribute ``data-y``."""
    r = Random(seed)

    def line(low: int, high: int) -> str:
        return " ".join("".join(r.choice("aeioulnrstdm") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))).capitalize() + r.choice(("", ".", ".", "!"))

    def named(tag: str, inner: str, names: tuple[str, ...], y: str = "") -> str:
        name = r.choice(names) if names and r.random() < 0.75 else ""
        attribute = f" {r.choice(('class', 'id'))}={r.choice(chr(34) + chr(39))}" if name else ""
        return f"<{tag}{attribute}{name}{attribute[-1:]}{y}>{inner}</{tag}>"

    def links(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f"<li><a href='/{i}'>{line(1, 3)}</a></li>" for i in range(r.randint(2, 9))) + f"</{tag}>"

    def clutter() -> str:
        kind = r.randrange(8)
        if kind == 0:
            return named(r.choice(("nav", "nav", "div")), links(), ("nav", "menu", "main-nav", "breadcrumb")) if r.random() < 0.8 else f"<nav>{links()}</nav>"
        if kind == 1:
            return f"<header>{named('div', line(1, 5), ('masthead', 'branding'))}</header>"
        if kind == 2:
            return named(r.choice(("aside", "div")) if r.random() < 0.5 else "aside", f"<h3>{line(1, 3)}</h3>{links()}<p>{line(5, 25)}</p>", ("sidebar", "widget", "related"))
        if kind == 3:
            return f"<div class=\"{r.choice(('ad', 'ads', 'advert', 'sponsored', 'promo box'))}\">{r.choice(('', '<p>'))}{line(3, 25)}</div>"
        if kind == 4:
            return f"<div class='{r.choice(('cookie-notice', 'newsletter', 'popup', 'alert notice', 'consent'))}'><p>{line(5, 25)}</p><button>{line(1, 1)}</button></div>"
        if kind == 5:
            return f"<form action='/s'><label>{line(1, 3)}</label><input name=q><p>{line(2, 12)}</p></form>"
        if kind == 6:
            return f"<{r.choice(('section', 'div'))} id=comments><h3>{line(1, 2)}</h3>" + "".join(f"<div class=comment><p>{line(4, 30)}</p></div>" for _ in range(r.randint(1, 5))) + "</div></section>"
        return f"<footer>{r.choice(('', '<p>'))}&copy; {line(3, 14)}</footer>"

    for _ in range(count):
        y, body = " data-y", []
        short, terse = r.random() < 0.2, r.choice((2, 3, 12)) if r.random() < 0.16 else 0
        for _ in range(1 if short else r.randint(10, 60) if terse else r.randint(1, 10)):
            kind = r.random()
            if short or kind < 0.75:
                inner = line(1, 5) if short else line(1, terse) if terse else line(r.choice((3, 20)), 90)
                if r.random() < 0.2:
                    inner = f"<b{y}>{inner}" + r.choice(("", "</b>")) + r.choice(("", "<br>"))
                if r.random() < 0.2:
                    inner += f" <a{y} href=x>{line(1, 4)}</a> {line(2, 9)}"
                body.append(f"<p{y}>{inner}" + r.choice(("</p>", "</p>", "")))
            elif kind < 0.82:
                body.append(f"<h{(d := r.randint(2, 4))}{y}>{line(1, 8)}</h{d}>")
            elif kind < 0.88:
                body.append(f"<ul{y}>" + "".join(f"<li{y}>{line(2, 20)}" + r.choice(("", "</li>")) for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.92:
                body.append(f"<blockquote{y}><p{y}>{line(6, 40)}</p></blockquote>")
            elif kind < 0.95:
                body.append(f"<table{y}><tr{y}><td{y}>{line(1, 6)}<td{y}>{line(1, 6)}</table>")
            elif kind < 0.97:
                body.append(clutter())
            else:
                body.append(f"<div{y}>{line(10, 60)}</div>")
        title = f"<h1{y}>{line(2, 9)}</h1>" if r.random() < 0.9 else ""
        wrap = r.random()
        inner = title + "".join(body)
        if wrap < 0.55:
            main = f"<article{y}>{inner}</article>"
        elif wrap < 0.7:
            main = f"<main{y}>{inner}</main>"
        else:
            main = f"<div class='{r.choice(('content', 'post', 'entry-content', 'article-body', 'story'))}'{y}>{inner}</div>"
        if r.random() < 0.3:
            main = f"<{(o := r.choice(('div', 'main', 'section')))}{y}>{main}" + (clutter() if r.random() < 0.4 else "") + f"</{o}>"
        before, after = "".join(clutter() for _ in range(r.randint(0, 4))), "".join(clutter() for _ in range(r.randint(0, 4)))
        yield f"<!DOCTYPE html><html{y}><head><title>{line(2, 9)}</title><style>p{{}}</style></head><body{y}>{before}{main}{after}" + r.choice(("</body></html>", ""))


@cache
def trained(count: int = 300, rounds: int = 45, seed: int = 5) -> TreeModel:
    """Own and edge potentials of greatest likelihood on labelled pages.

    Starts from a logistic regression of single elements.  The gradient is the
    difference of observed features and pairs of labels from those expected
    under the model, which sum-product gives exactly on trees; Adam climbs it.
    """
    pages = []
    for html in labelled_pages(count, seed):
        marked = [m[3].rstrip().endswith("data-y") or " data-y " in m[3] for m in _TOKEN.finditer(html) if m[2] and not m[1] and m[2].lower() not in VOID]
        page = parse(html)
        y, kinds = np.array([1, *map(int, marked)]), _kinds_of(page)
        seen = np.zeros((4, 2, 2))
        np.add.at(seen, (kinds[1:], y[page.parent[1:]], y[1:]), 1)
        pages.append((features(page), y, kinds, page.parent, seen))
    x, y = np.concatenate([p[0] for p in pages]), np.concatenate([p[1] for p in pages])
    w = np.zeros(_SIZE)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(_SIZE), x.T @ (p - y) + w)
    model = TreeModel(w / 2, np.zeros((4, 2, 2)))
    first, second = np.zeros(_SIZE + 16), np.zeros(_SIZE + 16)
    for t in range(1, rounds + 1):
        expected, gradient = [], np.zeros((4, 2, 2))
        for own, (_, _, kinds, parent, seen) in zip(np.split(x @ model.weights, np.cumsum([len(p[1]) for p in pages])[:-1]), pages, strict=True):
            q, total = model.infer(own, kinds, parent, pairs=True)
            expected += q
            gradient += seen - total
        g = np.concatenate([x.T @ (y - np.array(expected)) - model.weights, gradient.ravel() - model.edges.ravel()])
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        step = 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        model = TreeModel(model.weights + step[:_SIZE], model.edges + step[_SIZE:].reshape(4, 2, 2))
    return model


def main_text(html: str, model: TreeModel) -> str:
    """Blocks of content in page order, joined by two line ends."""
    if not html:
        return ""
    page = parse(html)
    if not page.texts:
        return ""
    keep = model.marginals(page) >= 0.5
    unread = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        unread[i] = unread[page.parent[i]] or page.tag[i] in UNREAD
    out: list[list[str]] = []
    last = -1
    for node, block, text in page.texts:
        if keep[node] and not unread[node]:
            if block != last:
                out.append([])
                last = block
            out[-1].append(text)
    joined = (" ".join("".join(parts).split()) for parts in out)
    return "\n\n".join(b for b in joined if b)


def _extract(model: TreeModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column("html"), 4 << 20):
                part = batch.slice(lo, hi - lo)
                found = [main_text(h or "", model) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """A row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    A null or empty html gives the empty text, as does a page on which nothing
    is content.  Markup may be broken: end tags are supplied, and an unclosed
    comment or script runs to the end.  Pages are read whole, in time that grows
    with their length; a probability of exactly one half counts as content.  Repeated rows give equal rows; an empty
    table gives an empty result; other columns are ignored.
    """
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return held.mapInArrow(_extract(model or trained()), "page_id long, url string, text string, n_chars long")
