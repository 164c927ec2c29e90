"""Operator 6: main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements; each text run belongs to the nearest one.  All other
elements are part of a line: their text is its text, but for controls, pictures, stand-ins of
media and annotations of formulas, whose labels are no page text and do not cut the line.
Every node is content or not.  Node potentials are the likelihoods of what can be seen of
it (element with length of its own text and share of link text; words in class/id/role);
parent-child potentials, one table for each kind of parent, couple it with its parent.
Sum-product messages, upward from
the leaves and downward from the roots, give exact marginals; text of nodes at least as
likely content as not is kept.  All pages of a batch are passed at once, depth by depth.

The potentials are counted from labelled pages that ``labelled_pages`` writes: page layouts
with known roles for every element.

Blocks are trimmed, their white space becomes single spaces, character references are
decoded, and blocks join by a newline in page order.

Defined results: null or empty html gives an empty text; broken markup is read as far as
it goes (missing end tags are implied, an unended script swallows the rest, an unended control what
is left of its block); repeated
rows and extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_batches

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:script|style|template|noscript|textarea|title)\b[^>]*+>.*?(?:</(?:script|style|template|noscript|textarea|title)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?/][^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
#: Elements whose text is no page text; all others are nodes or inline, and the model decides.
RAW_END = {x: re.compile(rf"</{x}\s*+>", re.IGNORECASE) for x in "script style template noscript textarea title".split()}
RAW_START = re.compile(r"<(script|style|template|noscript|textarea|title)\b", re.IGNORECASE)
#: Block elements of the HTML standard: nodes, which end the text before them.  All other elements, known or not, are part of the line they stand in.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html"
    " legend li listing main menu nav ol p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Elements that show something else than their text (a control, a picture, what stands in for a medium or repeats a formula): they stand in a
#: line without ending it, and what is written in them is no page text.
MUTED = frozenset("button select option optgroup datalist meter progress output svg canvas object iframe audio video annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that starts closes these open ones, up to the nearest of the second kind.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "body": ("head", "html")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
KEYS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

TAG_KINDS = ["nav", "header", "footer", "aside", "form", "article", "main", "p", "heading", "item", "list", "box", "cell", "table", "quote", "figure", "body", "html", "head", "other"]
TAG_KIND = {k: k for k in TAG_KINDS} | dict.fromkeys(["h1", "h2", "h3", "h4", "h5", "h6"], "heading") | dict.fromkeys(["li", "dt", "dd"], "item") | dict.fromkeys(["ul", "ol", "dl", "menu"], "list") | dict.fromkeys(["div", "section", "center", "address", "details", "summary"], "box") | dict.fromkeys(["td", "th", "caption"], "cell") | dict.fromkeys(["tr", "tbody", "thead", "tfoot", "table"], "table") | dict.fromkeys(["blockquote", "pre"], "quote") | dict.fromkeys(["figure", "figcaption"], "figure") | dict.fromkeys(["fieldset", "legend", "dialog"], "form")
TAG_CODE = {k: TAG_KINDS.index(v) for k, v in TAG_KIND.items()}
WORD_KINDS = ["none", "ad", "menu", "comment", "notice", "side", "footer", "header", "content", "form", "mixed", "vague"]
#: Words of class, id and role values, by kind; the first kind with a word in the value holds, "mixed" where
#: content and another kind have one, and "vague" where the words of a kind stand only in names with other words that say something.
KEY_WORDS = {
    "ad": "ad ads advert advertisement adverts adsense banner-ad sponsor sponsored promo promotion promoted",
    "comment": "comment comments reply replies disqus discussion respond",
    "notice": "cookie cookies consent notice gdpr popup modal alert newsletter subscribe banner paywall",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs skip toc",
    "side": "sidebar aside related recommended share sharing social widget widgets more trending complementary",
    "footer": "footer foot copyright contentinfo legal",
    "header": "header masthead topbar logo branding",
    "form": "form search login signup searchbox",
    "content": "content article post entry main body story text page prose",
}
#: Words that say nothing about what they name.
FILLERS = frozenset("a all area articles bar block body bottom box boxes container element group grid header holder inner item items left link links list listing main news outer page panel posts products right row section site slot stories the top unit widgets wrap wrapper zone".split())
KEY_KIND = {w: WORD_KINDS.index(k) for k, words in KEY_WORDS.items() for w in words.split()}
CONTENT, MIXED, VAGUE = (WORD_KINDS.index(k) for k in ("content", "mixed", "vague"))
KEY_ORDER = [WORD_KINDS.index(k) for k in KEY_WORDS]
LENGTHS, SHARES = (1, 20, 60, 150, 400), (0.1, 0.4, 0.8)
#: Number of codes of (element, length, share) and of key kinds.
SIZES = (len(TAG_KINDS) * (len(LENGTHS) + 1) * (len(SHARES) + 2), len(WORD_KINDS))


def key_kind(attrs: str) -> int:
    """Kind of an element by the words in its class, id and role."""
    found, clear = set(), False
    for m in KEYS.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            kinds = {KEY_KIND[w] for w in words if w in KEY_KIND}
            found |= kinds
            clear = clear or bool(kinds) and all(w in KEY_KIND or w in FILLERS or w.isdigit() for w in words)
    if CONTENT in found and len(found) > 1:
        return MIXED
    kind = next((k for k in KEY_ORDER if k in found), 0)
    return kind if clear or kind in (0, CONTENT) else VAGUE


class Tree:
    """Nodes of one page in page order, and its text blocks (node, text)."""

    def __init__(self, page: str) -> None:
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[int] = []
        self.key: list[int] = []
        self.chars: list[int] = []
        self.links: list[int] = []
        self.names: list[str] = []
        self.blocks: list[tuple[int, str]] = []
        self._stack: list[int] = []
        self._opened: dict[str, int] = {}
        self._runs: list[str] = []
        self._in_link = False
        self._muted: list[tuple[str, int]] = []  # open elements without page text, and the stack below them
        self._read(page)

    def _open(self, name: str, key: int) -> None:
        stack = self._stack
        if not stack and name != "html":  # implied, as browsers do
            self._open("html", 0)
            if name not in ("head", "body"):
                self._open("body", 0)
        self.parent.append(stack[-1] if stack else -1)
        self.depth.append(len(stack))
        self.tag.append(TAG_CODE.get(name, TAG_CODE["other"]))
        self.key.append(key)
        self.chars.append(0)
        self.links.append(0)
        self.names.append(name)
        stack.append(len(self.names) - 1)
        self._opened[name] = self._opened.get(name, 0) + 1

    def _close(self, at: int) -> None:
        """End the open elements from that place of the stack on."""
        for node in self._stack[at:]:
            self._opened[self.names[node]] -= 1
        del self._stack[at:]
        while self._muted and self._muted[-1][1] > at:
            self._muted.pop()

    def _flush(self) -> None:
        if self._runs:
            text = "".join(self._runs)
            self._runs = []
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                if not self._stack:
                    self._open("body", 0)
                self.blocks.append((self._stack[-1], text))

    def _text(self, text: str) -> None:
        if self._muted:
            return
        self._runs.append(text)
        if self._stack:
            n = len(text) - text.count(" ")
            self.chars[self._stack[-1]] += n
            if self._in_link:
                self.links[self._stack[-1]] += n

    def _read(self, page: str) -> None:
        at, size, names, stack = 0, len(page), self.names, self._stack
        find = MARKUP.search
        while at < size:
            m = find(page, at)
            if m is None:
                self._text(page[at:])
                break
            start = m.start()
            if start > at:
                self._text(page[at:start])
            name = m["tag"]
            at = m.end()
            if name is None:
                # The alternatives for raw elements end at any raw end tag; look for their own.
                if raw := RAW_START.match(page, start):
                    own = RAW_END[raw[1].lower()].search(page, raw.end())
                    at = own.end() if own else size
                continue
            name = name.lower()
            if name in MUTED:
                if not m["end"]:
                    if not (name == "svg" and page.endswith("/>", start, at)):
                        self._muted.append((name, len(stack)))
                elif any(x == name for x, _ in self._muted):
                    while self._muted.pop()[0] != name:
                        pass
                continue
            if name == "br":
                self._runs.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    self._flush()
                continue
            if name not in BLOCKS:
                if name == "a":
                    self._in_link = not m["end"]
                continue
            self._flush()
            self._in_link = False
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1) if self._opened.get(name) else ():
                    if names[stack[k]] == name:
                        self._close(k)
                        break
                continue
            if stack and names[stack[-1]] == "p":
                self._close(len(stack) - 1)
            if name in CLOSES and any(self._opened.get(x) for x in CLOSES[name][0]):
                closed, until = CLOSES[name]
                for k in range(len(stack) - 1, -1, -1):
                    if names[stack[k]] in closed:
                        self._close(k)
                        if name not in ("tr", "td", "th"):
                            break
                    elif names[stack[k]] in until:
                        break
            attrs = m["attrs"]
            self._open(name, key_kind(attrs) if "=" in attrs else 0)
        self._flush()


class Forest:
    """The nodes of many pages as arrays; observations are one code for each kind of feature."""

    def __init__(self, trees: list[Tree]) -> None:
        counts = np.array([len(t.names) for t in trees], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        join = lambda name: np.array([x for t in trees for x in getattr(t, name)], np.int64)
        parent = join("parent")
        self.parent = np.where(parent < 0, -1, parent + np.repeat(self.first[:-1], counts))
        self.depth = join("depth")
        chars, links = join("chars"), join("links")
        length = np.digitize(chars, LENGTHS)
        share = np.where(chars == 0, 0, 1 + np.digitize(links / np.maximum(chars, 1), SHARES))
        tag, key = join("tag"), join("key")
        self.codes = np.stack([(tag * (len(LENGTHS) + 1) + length) * (len(SHARES) + 2) + share, key], axis=1)
        kind = tag * len(WORD_KINDS) + key
        self.parent_kind = np.where(self.parent < 0, -1, kind[self.parent]) if len(kind) else kind


def marginals(forest: Forest, emission: list[np.ndarray], transition: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(content) of every node by sum-product on the trees.  Tables hold logarithms."""
    belief = sum(e[forest.codes[:, k]] for k, e in enumerate(emission))
    n = len(belief)
    if not n:
        return np.zeros(0)
    levels = np.split(np.argsort(forest.depth, kind="stable"), np.cumsum(np.bincount(forest.depth))[:-1])
    step = transition[forest.parent_kind]  # (node, parent's label, own label); not read at roots
    up = np.zeros((n, 2))
    for nodes in reversed(levels[1:]):
        up[nodes] = np.logaddexp(step[nodes, :, 0] + belief[nodes, :1], step[nodes, :, 1] + belief[nodes, 1:])
        np.add.at(belief, forest.parent[nodes], up[nodes])
    down = np.zeros((n, 2))
    down[levels[0]] = prior
    for nodes in levels[1:]:
        parent = forest.parent[nodes]
        cavity = down[parent] + belief[parent] - up[nodes]
        down[nodes] = np.logaddexp(cavity[:, :1] + step[nodes, 0], cavity[:, 1:] + step[nodes, 1])
    both = belief + down
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages and the label of each of their nodes, in page order (1: content)."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi)))

    def page() -> tuple[str, list[int]]:
        out: list[str] = []
        labels: list[int] = []

        def el(name: str, label: int, inner, attrs: str = "") -> None:
            # Names mislead now and then, on content and on what is none.
            if rng.random() < 0.06 and name not in ("html", "head", "body"):
                attrs = f' {rng.choice(["class", "id"])}="{misnomer()}"'
            out.append(f"<{name}{attrs}>")
            labels.append(label)
            inner() if callable(inner) else out.append(inner)
            out.append(f"</{name}>")

        def misnomer() -> str:
            word = rng.choice(sorted(KEY_KIND))
            other = rng.choice(KEY_WORDS["content"].split()) if rng.random() < 0.3 else words(1, 1)
            return rng.choice("- _").join(rng.sample([word, other], 2)) if rng.random() < 0.9 else word

        def menu(label: int = 0) -> None:
            el("ul", label, lambda: [el("li", 0, f'<a href="/x">{words(1, 3)}</a>') for _ in range(rng.randint(2, 9))])

        def noise(kind: str) -> None:
            if kind == "nav":
                name, attrs = rng.choice([("nav", ""), ("div", ' class="navbar"'), ("div", ' id="menu"'), ("nav", ' class="breadcrumb"'), ("ul", ' class="menu"')])
                if name == "ul":
                    el("ul", 0, lambda: [el("li", 0, f'<a href="/x">{words(1, 3)}</a>') for _ in range(rng.randint(2, 9))], attrs)
                else:
                    el(name, 0, menu, attrs)
            elif kind == "ad":
                def inside() -> None:
                    if rng.random() < 0.6:
                        out.append(words(3, 25))
                    else:
                        el("p", 0, words(3, 30))
                el(rng.choice(["div", "aside", "section"]), 0, inside, f' class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo box", "ad-slot"])}"')
            elif kind == "aside":
                def inside() -> None:
                    el("h3", 0, words(1, 4))
                    menu() if rng.random() < 0.6 else el("p", 0, words(4, 30))
                name, attrs = rng.choice([("aside", ""), ("div", ' class="sidebar"'), ("div", ' class="related"'), ("aside", ' class="widget"'), ("div", ' class="share social"')])
                el(name, 0, inside, attrs)
            elif kind == "notice":
                def inside() -> None:
                    if rng.random() < 0.5:
                        el("p", 0, words(5, 30))
                    else:
                        out.append(words(5, 30))
                el(rng.choice(["div", "section"]), 0, inside, f' {rng.choice(["class", "id"])}="{rng.choice(["cookie-notice", "consent", "banner", "newsletter", "alert", "popup"])}"')
            elif kind == "form":
                el("form", 0, lambda: [out.append(f'<label>{words(1, 3)}</label><input name="q">'), el("p", 0, words(1, 8)) if rng.random() < 0.4 else None], rng.choice(["", ' class="search"', ' id="login"']))
            elif kind == "header":
                def inside() -> None:
                    if rng.random() < 0.5:
                        el(rng.choice(["h1", "h2", "div"]), 0, words(1, 4))
                    if rng.random() < 0.5:
                        el("p", 0, words(2, 9))
                    if rng.random() < 0.5:
                        noise("nav")
                name, attrs = rng.choice([("header", ""), ("div", ' id="header"'), ("div", ' class="masthead"'), ("header", ' class="site-header"')])
                el(name, 0, inside, attrs)
            elif kind == "footer":
                def inside() -> None:
                    if rng.random() < 0.6:
                        out.append(f"&copy; {words(2, 14)}")
                    if rng.random() < 0.5:
                        el("p", 0, words(3, 20))
                    if rng.random() < 0.4:
                        menu()
                name, attrs = rng.choice([("footer", ""), ("footer", ""), ("div", ' id="footer"'), ("div", ' class="footer"')])
                el(name, 0, inside, attrs)
            elif kind == "comments":
                def one() -> None:
                    if rng.random() < 0.6:
                        el("h4", 0, words(1, 2))
                    for _ in range(rng.randint(1, 2)):
                        el("p", 0, words(4, 60))
                def inside() -> None:
                    el("h3", 0, words(1, 3))
                    for _ in range(rng.randint(1, 5)):
                        el(rng.choice(["div", "li", "article"]), 0, one, ' class="comment"')
                el(rng.choice(["section", "div", "ol"]), 0, inside, f' {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "disqus", "replies"])}"')

        def paragraph() -> None:
            r = rng.random()
            if r < 0.72:
                text = words(1, 8) if rng.random() < 0.25 else words(8, 120)
                if rng.random() < 0.15:
                    text += f' <a href="/y">{words(1, 4)}</a> {words(1, 12)}'
                el("p", 1, text)
            elif r < 0.80:
                el(rng.choice(["h2", "h3"]), 1, words(1, 9))
            elif r < 0.87:
                el(rng.choice(["ul", "ol"]), 1, lambda: [el("li", 1, words(1, 20)) for _ in range(rng.randint(2, 6))])
            elif r < 0.91:
                el("blockquote", 1, (lambda: el("p", 1, words(5, 50))) if rng.random() < 0.5 else words(5, 50))
            elif r < 0.94:
                el("pre", 1, words(3, 40))
            elif r < 0.97:
                el("table", 1, lambda: [el("tr", 1, lambda: [el("td", 1, words(1, 4)) for _ in range(3)]) for _ in range(rng.randint(1, 4))])
            else:
                el("figure", 1, lambda: el("figcaption", 1, words(2, 14)))

        def body_text() -> None:
            if rng.random() < 0.85:
                el(rng.choice(["h1", "h1", "h2"]), 1, words(1, 12))
            for k in range(rng.randint(1, 12)):
                if k and rng.random() < 0.06:
                    noise(rng.choice(["ad", "aside", "notice", "form"]))
                if rng.random() < 0.05:
                    el(rng.choice(["div", "section"]), 1, lambda: [paragraph() for _ in range(rng.randint(1, 4))])
                elif rng.random() < 0.04:
                    out.append(words(6, 60))
                else:
                    paragraph()

        def article() -> None:
            name, attrs = rng.choice([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="entry-content"'), ("div", ""), ("section", ' class="article-body"')])
            r = rng.random()
            if r < 0.15:
                el("main", 1, lambda: el("article", 1, body_text))
            elif r < 0.22:
                el("div", 0, lambda: [noise("aside") if rng.random() < 0.3 else None, el(name, 1, body_text, attrs), noise("aside") if rng.random() < 0.5 else None], rng.choice(["", ' class="container"', ' id="wrapper"']))
            elif r < 0.30:
                body_text()
            else:
                el(name, 1, body_text, attrs)

        def body() -> None:
            before = [k for k, p in (("header", 0.4), ("nav", 0.7), ("notice", 0.2), ("ad", 0.4), ("form", 0.15)) if rng.random() < p]
            after = [k for k, p in (("comments", 0.25), ("aside", 0.3), ("ad", 0.25), ("form", 0.15), ("notice", 0.15), ("footer", 0.75)) if rng.random() < p]
            for k in before:
                noise(k)
            article()
            for k in after:
                noise(k)

        def top() -> None:
            if rng.random() < 0.9:
                el("head", 0, f'<meta charset="utf-8"><title>{words(1, 6)}</title><style>p{{}}</style>')
            el("body", 0, body)

        el("html", 0, top)
        return "".join(out), labels

    return [page() for _ in range(n)]


def widget_pages(n: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Labelled pages whose paragraphs, headings, items and menus hold controls and embedded objects."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))

    def page() -> tuple[str, list[int]]:
        parts, labels = ["<html><body>"], [0, 0]
        control = lambda: f"<{(name := rng.choice(sorted(MUTED)))}>{words(rng.randint(1, 6))}</{name}>"
        for _ in range(rng.randint(0, 2)):
            parts.append(f"<nav>{control()}</nav>")
            labels.append(0)
        parts.append(f"<article><h1>{words(rng.randint(1, 9))}</h1>")
        labels += [1, 1]
        for _ in range(rng.randint(2, 8)):
            name, text = rng.choice(["p", "p", "p", "h2", "li"]), words(rng.randint(3, 60))
            parts.append(f"<{name}>{text} {control() if rng.random() < 0.3 else ''} {words(rng.randint(0, 5))}</{name}>")
            labels.append(1)
        return "".join([*parts, "</article></body></html>"]), labels

    return [page() for _ in range(n)]


@cache
def fitted(n: int = 1500, seed: int = 7) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Log potentials counted from labelled pages: node likelihoods, transitions [kind of parent, parent, child], root prior."""
    pages = [(Tree(p), y) for p, y in [*labelled_pages(n, seed), *widget_pages(n // 2, seed)]]
    pages = [(t, y) for t, y in pages if len(t.names) == len(y)]
    forest, label = Forest([t for t, _ in pages]), np.array([x for _, y in pages for x in y])
    emission = []
    for k, size in enumerate(SIZES):
        counts = np.ones((size, 2)) * 0.5
        np.add.at(counts, (forest.codes[:, k], label), 1)
        emission.append(np.log(counts / counts.sum(axis=0)))
    child = forest.parent >= 0
    # Kinds of parent seen seldom lean on what all parents show.
    overall = np.ones((2, 2))
    np.add.at(overall, (label[forest.parent[child]], label[child]), 1)
    pairs = np.repeat(4 * (overall / overall.sum(axis=1, keepdims=True))[None], len(TAG_KINDS) * len(WORD_KINDS), axis=0)
    np.add.at(pairs, (forest.parent_kind[child], label[forest.parent[child]], label[child]), 1)
    roots = np.bincount(label[~child], minlength=2) + 1.0
    return emission, np.log(pairs / pairs.sum(axis=2, keepdims=True)), np.log(roots / roots.sum())


def main_texts(pages: list[str | None], model: tuple[list[np.ndarray], np.ndarray, np.ndarray] | None = None) -> list[str]:
    """Main text of each page."""
    trees = [Tree(p or "") for p in pages]
    forest = Forest(trees)
    kept = marginals(forest, *(model or fitted())) >= 0.5
    return ["\n".join(text for node, text in t.blocks if kept[first + node]) for t, first in zip(trees, forest.first[:-1].tolist(), strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    arrow_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(fitted())  # a few tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch.column(2).to_pylist(), shared.value)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
