"""Main-text extraction: a tree-structured graphical model over DOM nodes, solved by sum-product messages."""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, ship

#: What a node can be: boilerplate, a container that holds both, content.
STATES = ("boiler", "mixed", "content")
TRAIN_PAGES, SMOOTH = 400, 0.3

# The kinds of HTML elements.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is none of the page's: code, what only shows without scripts, and text of form controls.
RAW = frozenset("script style template noscript noframes noembed iframe textarea".split())
#: Opening one of these ends an open element of its group, up to the nearest of the containers named.
ENDS = {
    **dict.fromkeys(("li",), (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"}))),
    **dict.fromkeys(("dt", "dd"), (frozenset({"dt", "dd"}), frozenset({"dl"}))),
    **dict.fromkeys(("td", "th"), (frozenset({"td", "th"}), frozenset({"tr", "table"}))),
    **dict.fromkeys(("tr",), (frozenset({"tr", "td", "th"}), frozenset({"table"}))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset({"tr", "td", "th", "thead", "tbody", "tfoot"}), frozenset({"table"}))),
    **dict.fromkeys(("option", "optgroup"), (frozenset({"option"}), frozenset({"select"}))),
    "body": (frozenset({"head", "title"}), frozenset({"html"})),
}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


class _Open:
    """The open elements, each with its tag and node; where an element of a tag was opened last is known at once."""

    def __init__(self) -> None:
        self.tags, self.nodes, self.last, self.blocks = ["html"], [0], {"html": [0]}, [0]

    def push(self, tag: str, node: int) -> None:
        self.last.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCK:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def cut(self, i: int) -> None:
        for tag in self.tags[i:]:
            self.last[tag].pop()
        while self.blocks[-1] >= i:
            self.blocks.pop()
        del self.tags[i:], self.nodes[i:]

    def nearest(self, tags) -> int:
        """The place of the innermost open element of one of ``tags``; 0: none."""
        return max((at[-1] for t in tags if (at := self.last.get(t))), default=0)


def parse(page: str) -> tuple[list[int], list[tuple], list[int], list[int], list[list[tuple[int, str]]], list[str]]:
    """parents, (tag, name parts), own text length, length within links, runs of text (node, text), labels of nodes.

    A node is a block element or an inline element with a name of its own (class, id, role); other inline elements
    belong to the node around them. A run ends where a block begins or ends; it is made of its nodes' texts. Every
    step costs the same however deep the page or how many end tags match nothing.
    """
    parent, kind, chars, linked, runs, labels = [-1], [("html", ())], [0], [0], [], [""]
    open_, held, link, at = _Open(), [], False, 0

    def flush() -> None:
        if held:
            if any(text.strip() for _, text in held):
                runs.append(held.copy())
                for node, text in held:
                    chars[node] += len(text.strip())
            held.clear()

    def say(raw: str) -> None:
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            node = open_.nodes[-1]
            held.append((node, text))
            if link:
                linked[node] += len(text.strip())

    def add(tag: str, parts: tuple, label: str) -> int:
        parent.append(open_.nodes[-1])
        kind.append((tag, parts))
        chars.append(0)
        linked.append(0)
        labels.append(label)
        return len(parent) - 1

    search = _TOKEN.search
    while m := search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] if m[2] else m[6]
        block = tag in BLOCK
        if tag == "a":
            link = not ending
        elif tag == "br":
            held.append((open_.nodes[-1], " "))
            continue
        elif tag in RAW and not ending:
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "html":
            continue
        if ending:
            if block:
                flush()
            i = open_.nearest((tag,))
            if i and (block or i > open_.blocks[-1]):  # an inline end tag ends nothing outside its block
                open_.cut(i)
            continue
        named = _NAMED.findall(attributes) if attributes else ()
        parts = tuple(sorted({p.lower() for k, v in named if k.lower() != "data-y" for p in _PART.findall(v)})) if named else ()
        label = next((v.strip("\"'") for k, v in named if k.lower() == "data-y"), "")
        if not block:
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                open_.push(tag, add(tag, parts, label) if parts else open_.nodes[-1])
            continue
        flush()
        if open_.tags[open_.blocks[-1]] == "p":
            open_.cut(open_.blocks[-1])
        if tag in ENDS:
            group, walls = ENDS[tag]
            wall = open_.nearest(walls)
            while (i := open_.nearest(group)) > wall:
                open_.cut(i)
                if tag in ("li", "dt", "dd", "option"):
                    break
        node = add(tag, parts, label)
        if tag not in VOID:
            open_.push(tag, node)
    say(page[at:])
    flush()
    return parent, kind, chars, linked, runs, labels


def _size(n: int) -> int:
    return 0 if n == 0 else 1 if n <= 25 else 2 if n <= 90 else 3 if n <= 300 else 4


def _share(linked: int, chars: int) -> int:
    return 0 if not linked else 1 if 3 * linked < chars else 2 if 3 * linked < 2 * chars else 3


# --- labelled pages -------------------------------------------------------------------------------------------------


def labelled_page(rng: random.Random) -> str:
    """A page whose block elements carry their state in data-y; layouts, names and nesting vary."""
    word = lambda: "".join(rng.choice("aeiourstnlm") for _ in range(rng.randint(2, 9)))
    said = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    pick = rng.choice

    def el(tag: str, y: str, inner: str, *names: str) -> str:
        attr = f' {pick(("class", "id"))}="{pick(names)}"' if names and rng.random() < 0.85 else ""
        return f'<{tag}{attr} data-y="{y}">{inner}</{tag}>'

    links = lambda n, tag="li": "".join(el(tag, "boiler", f'<a href="/{word()}">{said(1, 3)}</a>') for _ in range(n))
    menu = lambda: el(pick(("nav", "nav", "div", "ul")), "boiler", el("ul", "boiler", links(rng.randint(3, 8))), "menu", "nav", "main-nav", "navbar", "breadcrumb", "pagination", "top-menu")

    def boiler() -> str:
        p = lambda a, b: el(pick(("p", "div", "span")), "boiler", said(a, b))
        return pick(
            (
                menu,
                lambda: el(pick(("div", "aside", "section")), "boiler", pick((said(3, 25), p(3, 20), el("p", "boiler", f'<a href="/x">{said(2, 6)}</a>'))), "ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner", "advertisement", "adsbox"),
                lambda: el(pick(("div", "section", "dialog", "aside")), "boiler", p(6, 40) + el("button", "boiler", said(1, 2)), "cookie-notice", "notice", "consent", "cookies", "gdpr", "alert", "popup", "modal", "overlay", "notification"),
                lambda: el("form", "boiler", el("label", "boiler", said(1, 3)) + "<input>" + el("button", "boiler", said(1, 2)), "search", "newsletter", "subscribe", "login", "contact"),
                lambda: el(pick(("aside", "aside", "div")), "boiler", el(pick(("h2", "h3", "h4")), "boiler", said(1, 4)) + pick((el("ul", "boiler", links(rng.randint(2, 6))), p(8, 40))), "sidebar", "side", "widget", "related", "aside", "trending", "recommended"),
                lambda: el(pick(("div", "ul")), "boiler", links(4, "div"), "share", "social", "share-buttons", "tags", "sharing"),
            )
        )()

    def comments() -> str:
        one = lambda: el(pick(("div", "li", "article")), "boiler", el(pick(("h4", "div", "cite")), "boiler", said(1, 2)) + el("p", "boiler", said(4, 60)), "comment", "reply", "comment-body")
        return el(pick(("section", "div", "ol", "aside")), "boiler", el(pick(("h2", "h3")), "boiler", said(1, 3)) + "".join(one() for _ in range(rng.randint(1, 5))), "comments", "discussion", "responses", "comment-list", "reader-comments", "replies")

    def passage() -> str:
        text = said(1, 12) if rng.random() < 0.25 else said(8, 120)
        if rng.random() < 0.15:
            text += f' <a href="/{word()}">{said(1, 4)}</a> {said(3, 20)}'
        if rng.random() < 0.12:
            text += f' <{(t := pick(("span", "em", "b", "code", "abbr")))} class="{pick(("term", "highlight", "name", "caps", "keyword", "math"))}" data-y="content">{said(1, 5)}</{t}> {said(1, 9)}'
        if rng.random() < 0.05:
            text += f' <span class="{pick(("ad", "ad-inline", "sponsored", "promo", "share", "social"))}" data-y="boiler">{said(1, 9)}</span> {said(0, 6)}'
        r = rng.random()
        if r < 0.78:
            return el("p", "content", text)
        if r < 0.86:
            return el(pick(("h2", "h3", "h4")), "content", said(1, 8))
        if r < 0.91:
            return el(pick(("ul", "ol")), "content", "".join(el("li", "content", said(2, 25)) for _ in range(rng.randint(2, 5))))
        if r < 0.94:
            return el("blockquote", "content", el("p", "content", text))
        if r < 0.96:
            return el("table", "content", "".join(el("tr", "content", el("td", "content", said(1, 5)) + el("td", "content", said(1, 8))) for _ in range(3)))
        if r < 0.98:
            return el("pre", "content", text)
        return el("div", "content", text)

    def story() -> str:
        parts = [el("h1", "content", said(2, 12))] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 14)):
            parts.append(passage())
            if rng.random() < 0.06:
                parts.append(boiler())
        if rng.random() < 0.12:
            parts.append(comments())
        inner = "".join(parts)
        if rng.random() < 0.25:
            inner = el(pick(("div", "section")), "content", inner, "entry-content", "post-body", "article-body", "text", "content", "body")
        if rng.random() < 0.1:
            return inner
        tag, names = pick((("div", ()), ("article", ("post", "article", "story", "entry")), ("article", ()), ("article", ()), ("main", ("content", "main")), ("div", ("content", "post", "article", "entry", "main-content", "story")), ("section", ("article", "content", "post"))))
        return el(tag, "content", inner, *names)

    body = [menu()] if rng.random() < 0.8 else []
    if rng.random() < 0.5:
        body.insert(rng.randint(0, len(body)), el(pick(("header", "header", "div")), "boiler", pick((el("div", "boiler", said(1, 4)), el("h2", "boiler", said(1, 3)), menu(), said(1, 6))), "header", "site-header", "masthead", "topbar", "logo"))
    body += [boiler() for _ in range(rng.randint(0, 3))]
    main = story()
    if rng.random() < 0.35:
        main = el(pick(("div", "main", "section")), "mixed", (boiler() if rng.random() < 0.5 else "") + main + (boiler() if rng.random() < 0.5 else ""), "wrapper", "container", "page", "row", "layout", "main", "content-wrap")
    body.append(main)
    if rng.random() < 0.35:
        body.append(comments())
    body += [boiler() for _ in range(rng.randint(0, 3))]
    if rng.random() < 0.85:
        body.append(el(pick(("footer", "footer", "div")), "boiler", pick((said(2, 25), el("p", "boiler", said(3, 25)), el("ul", "boiler", links(4)), f"&copy; {said(1, 12)}")), "footer", "site-footer", "copyright", "legal"))
    head = f'<head data-y="boiler"><title data-y="boiler">{said(2, 9)}</title></head>'
    return f'<html>{head}<body data-y="mixed">{"".join(body)}</body></html>'


class Model:
    """Node factors P(tag, name parts, length, link share | state) and parent-child potentials, from smoothed counts."""

    def __init__(self, pages: Iterator[str]):
        k = len(STATES)
        edge, state = np.full((k, k), SMOOTH), np.full(k, SMOOTH)
        tags, parts = [Counter() for _ in range(k)], [Counter() for _ in range(k)]
        size, share = np.full((k, 5), SMOOTH), np.full((k, 4), SMOOTH)
        for page in pages:
            parent, kind, chars, linked, _, labels = parse(page)
            y = [STATES.index(x) if x in STATES else 1 for x in labels]  # the root holds both
            for i, p in enumerate(parent):
                state[y[i]] += 1
                if p >= 0:
                    edge[y[p], y[i]] += 1
                tags[y[i]][kind[i][0]] += 1
                parts[y[i]].update(kind[i][1])
                size[y[i], _size(chars[i])] += 1
                share[y[i], _share(linked[i], chars[i])] += 1
        self.edge = np.log(edge / edge.sum(1, keepdims=True))
        self.size, self.share = np.log(size / size.sum(1, keepdims=True)), np.log(share / share.sum(1, keepdims=True))
        rate = lambda c, x, n: np.log([(c[s][x] + SMOOTH) / (n[s] + 40 * SMOOTH) for s in range(k)])
        n = [sum(t.values()) for t in tags]
        self.tags = {x: rate(tags, x, n) for x in set().union(*tags)}
        self.parts = {x: rate(parts, x, state) for x in set().union(*parts)}
        self.none = np.zeros(k)

    def unary(self, kind: tuple) -> np.ndarray:
        """Of a tag and its names; what was never seen says nothing."""
        return self.tags.get(kind[0], self.none) + sum((self.parts[p] for p in kind[1] if p in self.parts), self.none)


def marginals(parent: np.ndarray, unary: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """P(state) of every node of a forest (parent -1: a root; parents come before children), in log space.

    Messages go up level by level from the leaves, then down; each level is one array operation.
    """
    n, k = unary.shape
    depth = np.zeros(n, np.int64)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    if n and depth.max() > DEEP:
        return _one_by_one(parent.tolist(), unary, edge)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    belief, up = unary.copy(), np.zeros((n, k))
    for level in levels[:0:-1]:
        up[level] = lse(edge[None] + belief[level][:, None, :], 2)
        np.add.at(belief, parent[level], up[level])
    for level in levels[1:]:
        above = belief[parent[level]] - up[level]  # the parent's belief without this child
        belief[level] += lse(above[:, :, None] + edge[None], 1)
    belief -= lse(belief, 1)[:, None]
    return np.exp(belief)


#: Trees of more levels than this are passed node by node: levels of a node or two are too small for arrays.
DEEP = 300


def _one_by_one(parent: list[int], unary: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The same messages in plain numbers; parents come before children, so one pass each way in node order is enough."""
    k, exp, log = unary.shape[1], math.exp, math.log
    states, weight = range(k), np.exp(edge).tolist()
    across = list(zip(*weight, strict=True))
    belief, up = unary.tolist(), [None] * len(parent)
    for i in range(len(parent) - 1, -1, -1):
        if (p := parent[i]) >= 0:
            b = belief[i]
            top = max(b)
            e = [exp(x - top) for x in b]
            message = up[i] = [log(sum(w * x for w, x in zip(weight[s], e))) for s in states]
            of = belief[p]
            for s in states:
                of[s] += message[s]
    for i, p in enumerate(parent):
        b = belief[i]
        if p >= 0:
            above = [x - y for x, y in zip(belief[p], up[i])]
            top = max(above)
            e = [exp(x - top) for x in above]
            for s in states:
                b[s] += log(sum(w * x for w, x in zip(across[s], e)))
        top = max(b)
        whole = top + log(sum(exp(x - top) for x in b))
        for s in states:
            b[s] -= whole
    return np.exp(np.array(belief))


def trained(pages: int = TRAIN_PAGES, seed: int = 7) -> Model:
    rng = random.Random(seed)
    return Model(labelled_page(rng) for _ in range(pages))


def texts(model: Model, pages: list[str]) -> list[str]:
    """The main text of each page; one round of messages for all of them."""
    cached: dict[tuple, np.ndarray] = {}
    parents, rows, sizes, shares, runs, base = [], [], [], [], [], 0
    for page in pages:
        parent, kind, chars, linked, own, _ = parse(page)
        parents += [p + base if p >= 0 else -1 for p in parent]
        for x in kind:
            if x not in cached:
                cached[x] = model.unary(x)
            rows.append(cached[x])
        sizes += map(_size, chars)
        shares += map(_share, linked, chars)
        runs.append((base, own))
        base += len(parent)
    if not base:
        return []
    unary = np.array(rows) + model.size[:, sizes].T + model.share[:, shares].T
    content = marginals(np.array(parents), unary, model.edge)[:, STATES.index("content")] > 0.5
    said = lambda base, run: " ".join("".join(t if content[i + base] else " " for i, t in run).split())
    return ["\n\n".join(t for run in own if (t := said(base, run))) for base, own in runs]


def extract(pages: DataFrame, html: str = "html", model: Model | None = None, out: str = "text") -> DataFrame:
    """``pages`` without ``html`` and with ``out``, the main text: blocks in page order joined by an empty line.

    A DOM node is a block element, or an inline one with a name of its own. Each has a factor from its tag, name parts, text length and link share; potentials
    join it to its parent; sum-product messages upward and downward give the marginal by which its text is kept.
    The model is fitted on TRAIN_PAGES labelled pages made by ``labelled_page`` (a documented bound; pass another
    model to use labelled pages of your own) and every page is read whole. Null or empty html, or a page without
    content: empty text. Repeated rows are all returned; ``out`` replaces a column of that name.
    """
    ship(pages.sparkSession)
    model = model or trained()
    carry = [c for c in pages.columns if c not in (html, out)]
    rows = pages.select(F.struct(*carry).alias("_row"), F.col(html).alias("_t"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = texts(model, [x or "" for x in part.column("_t").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(found, type=pa.string())], names=["_row", "_o"])

    done = rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, _o string")
    return done.select("_row.*", F.col("_o").alias(out))


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page; null html gives an empty text, odd inputs as in ``extract``."""
    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
