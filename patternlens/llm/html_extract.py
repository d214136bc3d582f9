"""Main-text extraction with gradient-boosted trees over the nodes of a page.

A page is parsed into a tree; each block element, and each element with a class, id or role, is
described by its subtree's density, its attributes' tokens, its depth and its siblings.
Boosted trees, trained in numpy on generated pages of many layouts, say how likely it is that
a node holds main text. Decoding goes down the tree: the labels of highest joint likelihood
are chosen under the rule that nothing inside a left-out node is kept, so ancestor and
descendant never contradict each other.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship

# Element names by the part they play in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title template noscript select option button textarea svg canvas object iframe audio video map math datalist".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot dd dt li legend summary figcaption".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
#: Words in class, id and role that tell parts of pages apart, a feature each.
HINTS = (
    ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager"), ("header", "masthead", "topbar", "banner", "branding", "logo"),
    ("footer", "foot", "copyright", "colophon", "bottom"), ("sidebar", "aside", "side", "rail", "complementary", "widget", "widgets"), ("ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion"),
    ("notice", "cookie", "cookies", "consent", "alert", "banner", "popup", "modal", "gdpr", "warning", "newsletter", "subscribe"), ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus"), ("form", "search", "login", "signup", "contact"),
    ("share", "social", "related", "recommended", "tags", "meta", "more", "recirc"), ("content", "article", "main", "post", "entry", "body", "story", "text", "prose"),
)
TAGS = ("p", "div", "article", "main", "section", "nav", "aside", "header", "footer", "form", "ul", "li", "table", "h", "blockquote", "pre", "figure", "span")
_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
WIDTH = len(TAGS) + 2 * len(HINTS) + 18


class Node:
    __slots__ = ("tag", "parent", "tokens", "depth", "children", "scored", "chars", "linked", "tags", "stops", "index", "own", "position", "unseen", "hints", "above", "zone")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset, position: int):
        self.tag, self.parent, self.tokens, self.position = tag, parent, tokens, position
        self.depth = parent.depth + 1 if parent else 0
        self.unseen = tag in UNSEEN or bool(parent and parent.unseen)
        self.children: list[Node] = []
        self.scored = tag in BLOCK or bool(tokens)
        self.hints = sum(1 << j for j, hint in enumerate(HINTS) if not tokens.isdisjoint(hint)) if tokens else 0
        self.above = parent.above | parent.hints if parent else 0
        self.zone = (parent.zone | (1 if parent.tag in ("article", "main") else 2 if parent.tag in ("nav", "aside", "header", "footer", "form") else 0)) if parent else 0
        self.chars = self.linked = self.tags = self.stops = self.own = self.index = 0


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str | None]]]:
    """(nodes in page order, events): an event is text in a node, or None where a block begins or ends.

    Comments, declarations and unfinished tags give nothing; script and style run to their own
    end tag; elements are closed where HTML implies it; whatever is open at the end is closed.
    """
    root = Node("html", None, frozenset(), 0)
    nodes, events, stack, at, n = [root], [], [root], 0, len(page)
    opened: Counter = Counter()  # by name, so that a search of the stack is for something that is there

    def text(raw: str) -> None:
        if raw and not stack[-1].unseen:
            events.append((stack[-1], html.unescape(raw) if "&" in raw else raw))

    def close(to: int) -> None:
        if any(x.tag in BLOCK for x in stack[to:]):
            events.append((stack[to - 1], None))
        opened.subtract(x.tag for x in stack[to:])
        del stack[to:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2] or m[5]
        if not name or not m[0].endswith(">"):
            continue
        name = name.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[k].tag == name:
                    close(k)
                    break
            continue
        raw = m[3] if m[2] else m[6]
        if name == "html" or name == "body" and opened[name]:
            continue
        if name in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in ("table", "td", "th", "button", "object"):
                    break
        if name in ENDS:
            closing, scope = ENDS[name]
            for k in range(len(stack) - 1, 0, -1) if any(opened[c] for c in closing) else ():
                if stack[k].tag in scope:
                    break
                if stack[k].tag in closing:
                    close(k)
                    break
        if name == "body" and opened["head"]:
            for k in range(1, len(stack)):
                if stack[k].tag == "head":
                    close(k)
                    break
        tokens = frozenset(_WORD.findall(" ".join(a[1] or a[2] or a[3] for a in _ATTR.findall(raw)).lower())) if "=" in raw else frozenset()
        node = Node(name, stack[-1], tokens, lt)
        stack[-1].children.append(node)
        nodes.append(node)
        if name in BLOCK:
            events.append((node, None))
        elif name == "br":
            events.append((stack[-1], " "))
        if name in VOID or (raw.endswith("/") and name not in BLOCK and name not in RAW):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            at = n if not end else (page.find(">", end.start()) + 1 or n)
            continue
        stack.append(node)
        opened[name] += 1
    return nodes, events


def _measure(nodes: list[Node], events: list[tuple[Node, str | None]]) -> None:
    for node, text in events:
        if text:
            size = len(text) - text.count(" ")
            node.own += size
            node.chars += size
            node.stops += text.count(".") + text.count(",") + text.count("!") + text.count("?")
    for i, node in enumerate(reversed(nodes)):
        node.tags += 1
        if node.tag == "a":
            node.linked = node.chars
        if node.parent:
            p = node.parent
            p.chars += node.chars
            p.linked += node.linked
            p.tags += node.tags
            p.stops += node.stops
    for node in nodes:
        for k, child in enumerate(node.children):
            child.index = k


def describe(nodes: list[Node], length: int) -> tuple[list[Node], np.ndarray]:
    """The scored nodes and a row of features for each."""
    scored = [x for x in nodes if x.scored and not x.unseen and x.parent]
    out = np.zeros((len(scored), WIDTH), np.float32)
    total = max(1, nodes[0].chars)
    for row, x in enumerate(scored):
        tag = "h" if len(x.tag) == 2 and x.tag[0] == "h" and x.tag[1].isdigit() else x.tag
        if tag in TAGS:
            out[row, TAGS.index(tag)] = 1
        k = len(TAGS)
        for j in range(len(HINTS)):
            out[row, k + j], out[row, k + len(HINTS) + j] = x.hints >> j & 1, x.above >> j & 1
        kin = x.parent.children
        before = kin[x.index - 1].chars if x.index else 0
        after = kin[x.index + 1].chars if x.index + 1 < len(kin) else 0
        chars = max(1, x.chars)
        out[row, k + 2 * len(HINTS) :] = (
            x.depth, np.log1p(x.chars), x.linked / chars, np.log1p(x.tags), x.chars / x.tags, x.stops / chars, len(x.children), x.index, len(kin),
            x.chars / max(1, x.parent.chars), x.chars / total, np.log1p(before), np.log1p(after), x.position / max(1, length), x.own / chars,
            x.zone & 1, x.zone >> 1, len(x.tokens),
        )
    return scored, out


@dataclass
class Trees:
    feature: np.ndarray  # [trees, inner nodes]
    cut: np.ndarray
    value: np.ndarray  # [trees, leaves]
    start: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at[0:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 4.0) -> Trees:
    """Logistic gradient boosting: histograms of gradients per level, all leaves of a level at once."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    inner, n_features = (1 << depth) - 1, x.shape[1]
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z = np.full(len(y), base)
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p) + 1e-6
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            lo, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-3)
            where = [(0, np.inf)] * width
            for f in range(n_features):
                key = (at - lo) * bins + code[:, f]
                gs, hs = (np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h))
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = np.where((hl > least / 4) & (ha - hl > least / 4), gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1), -1)
                for leaf in range(width):
                    k = int(gain[leaf].argmax())
                    if gain[leaf, k] > best[leaf] and k < len(edges[f]):
                        best[leaf], where[leaf] = gain[leaf, k], (f, float(edges[f][k]))
            for leaf, (f, cut) in enumerate(where):
                out.feature[t, lo + leaf], out.cut[t, lo + leaf] = f, cut
            at = 2 * at + 1 + (x[np.arange(len(x)), out.feature[t, at]] > out.cut[t, at])
        leaf = at - inner
        out.value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        z += out.value[t][leaf]
    return out


def generated(count: int, seed: int = 5) -> Iterator[tuple[str, set[str]]]:
    """(page, its main blocks): layouts drawn at random, every block's text unique to it."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g l m n p r s t v w th ch".split() for b in "a e i o u an en is or".split()]
    number = 0

    def words(lo: int, hi: int) -> str:
        nonlocal number
        number += 1
        own = [f"k{number}"] + ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(lo, hi))]
        return " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in own).capitalize() + rng.choice([".", ".", ".", ""])

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{words(0, 2)}</a></{tag}>' for i in range(rng.randint(3, 9)))

    def attr(*names: str) -> str:
        return rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} c{rng.randint(1, 9)}"'])

    for _ in range(count):
        main: set[str] = set()

        def block(lo: int, hi: int, main=main) -> str:
            text = words(lo, hi)
            main.add(text)
            return text

        def boiler(kind: str) -> str:
            match kind:
                case "nav":
                    return rng.choice([f"<nav><ul>{links()}</ul></nav>", f"<div{attr('menu', 'nav', 'navbar')}><ul>{links()}</ul></div>", f'<ul{attr("menu", "breadcrumb")}>{links()}</ul>'])
                case "header":
                    return rng.choice([f"<header><h1>{words(1, 4)}</h1><p>{words(2, 8)}</p></header>", f"<div{attr('header', 'masthead', 'topbar')}><p>{words(1, 6)}</p></div>"])
                case "footer":
                    return rng.choice([f"<footer>&copy; {words(3, 14)}</footer>", f"<footer><p>{words(3, 30)}</p><ul>{links()}</ul></footer>", f"<div{attr('footer', 'copyright')}><p>{words(3, 20)}</p></div>"])
                case "side":
                    return rng.choice([f"<aside><h3>{words(1, 3)}</h3><p>{words(4, 40)}</p></aside>", f"<div{attr('sidebar', 'widget', 'rail')}><h3>{words(1, 3)}</h3><ul>{links()}</ul><p>{words(4, 40)}</p></div>"])
                case "ad":
                    return rng.choice([f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'promo')}>{words(3, 60)}</div>", f"<aside{attr('ad', 'promo')}><p>{words(3, 40)}</p></aside>", f"<p{attr('ad', 'advert')}>{words(3, 40)}</p>"])
                case "notice":
                    return f"<div{attr('notice', 'cookie-banner', 'consent', 'alert', 'newsletter')}><p>{words(4, 50)}</p></div>"
                case "form":
                    return f"<form{rng.choice(['', attr('search', 'login')])}><label>{words(1, 3)}</label><input><p>{words(1, 12)}</p></form>"
                case "comments":
                    inner = "".join(f"<{t}{attr('comment', 'reply')}><p>{words(4, 60)}</p></{t}>" for t in ["div"] * rng.randint(1, 5))
                    return rng.choice([f"<section{attr('comments', 'discussion')}><h3>{words(1, 2)}</h3>{inner}</section>", f"<div{attr('comments', 'respond')}>{inner}</div>"])
                case _:
                    return f"<div{attr('share', 'related', 'social')}><ul>{links()}</ul></div>"

        parts = [f"<h{rng.choice([1, 1, 2])}>{block(1, 12)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(0, 14)):
            parts.append(rng.choices(
                [lambda: f"<p>{block(1, 140)}</p>", lambda: f"<p>{block(0, 4)}</p>", lambda: f"<p><b>{block(2, 90)}<br>", lambda: f"<h2>{block(1, 6)}</h2>", lambda: "<ul>" + "".join(f"<li>{block(1, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>",
                 lambda: f"<blockquote><p>{block(3, 40)}</p></blockquote>", lambda: f"<table><tr><td>{block(0, 6)}</td><td>{block(0, 6)}</td></tr></table>", lambda: f"<section><p>{block(2, 80)}</p></section>", lambda: boiler(rng.choice(["ad", "notice", "form", "side", "share"]))],
                [30, 8, 8, 4, 3, 2, 1, 2, 4])[0]())
        if rng.random() < 0.15:
            parts.append(boiler("comments"))
        if rng.random() < 0.12:
            parts.append(rng.choice([lambda: f"<pre>{block(1, 12)}</pre>", lambda: f"<figure><img src=x><figcaption>{block(1, 8)}</figcaption></figure>", lambda: f"<ol><li>{block(4, 40)}</li><li>{block(4, 40)}</li></ol>"])())
        if parts and parts[0].startswith("<h") and rng.random() < 0.15:
            parts[0] = f"<header>{parts[0]}</header>"
        inner = "".join(parts)
        anchors = lambda: " ".join(f'<a href="/{i}">{words(0, 2)}</a>' for i in range(rng.randint(2, 7)))
        if (odd := rng.random()) < 0.07:  # a layout by tables
            row = lambda cells: f"<tr>{''.join(f'<td>{c}</td>' for c in cells)}</tr>"
            page = f"<table>{row([anchors()])}{row(rng.sample([f'<ul>{links()}</ul>', inner], 2))}{row(['&copy; ' + words(2, 14)])}</table>"
        elif odd < 0.14:  # boxes without names
            plain = inner.replace("<p>", "<div>").replace("</p>", "</div>") if rng.random() < 0.7 else inner
            box = lambda text: f'<div{rng.choice(["", f""" id="b{rng.randint(1, 9)}\""""])}>{text}</div>'
            page = box("".join(f"<span>{a}</span>" for a in anchors().split(" <")) if rng.random() < 0.3 else anchors()) + box(plain) + "".join(box(x) for x in (f"<h3>{words(1, 3)}</h3>" + anchors(), f"<ul>{links()}</ul>") if rng.random() < 0.5) + box(anchors())
        elif odd < 0.2:  # boxes by role
            page = f'<div role="banner">{anchors()}</div><div role="navigation">{anchors()}</div><div role="main">{inner}</div><div role="complementary"><h3>{words(1, 3)}</h3>{anchors()}</div><div role="contentinfo">{words(2, 12)}</div>'
        else:
            page = ""
        body = rng.choice([f"<article>{inner}</article>"] * 3 + [f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div{attr('content', 'post', 'entry', 'article-body', 'main')}>{inner}</div>", f"<div{attr('wrapper', 'page', 'container')}><article>{inner}</article></div>"])
        top = [boiler(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.5]
        low = [boiler(k) for k in ("ad", "side", "share", "comments", "footer", "nav") if rng.random() < 0.45]
        rng.shuffle(top)
        page = page or "".join(top) + body + "".join(low)
        if rng.random() < 0.25:
            page = f"<div{attr('wrapper', 'page', 'container')}>{page}</div>"
        page = f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{}}</style></head><body>{page}</body></html>"
        yield (page[: rng.randint(len(page) * 3 // 4, len(page))] if rng.random() < 0.08 else page), main


def train(pages: int = 700, seed: int = 5) -> Trees:
    """Trees learned from generated pages; a node is positive if main text stands in it."""
    xs, ys = [], []
    for page, main in generated(pages, seed):
        nodes, events = parse(page)
        _measure(nodes, events)
        marks = {m.split()[0].rstrip(".,").lower() for m in main}
        for node, text in events:
            if text and (w := text.split()) and w[0].rstrip(".,").lower() in marks:
                while node:
                    node.index, node = -1, node.parent
        hit = {id(x) for x in nodes if x.index == -1}
        for node in nodes:
            for k, child in enumerate(node.children):
                child.index = k
        scored, rows = describe(nodes, len(page))
        keep = [i for i, x in enumerate(scored) if x.chars]
        xs.append(rows[keep])
        ys.append(np.array([id(scored[i]) in hit for i in keep], float))
    return boost(np.concatenate(xs), np.concatenate(ys))


def decode(nodes: list[Node], score: dict[int, float]) -> set[int]:
    """ids of the nodes that are left out. Nodes without a score follow their parent."""
    into, out = {}, {}
    for x in reversed(nodes):
        z = score.get(id(x))
        a, b = (-np.logaddexp(0, -z), -np.logaddexp(0, z)) if z is not None else (0.0, 0.0)
        out[id(x)] = b + sum(out[id(c)] for c in x.children)
        into[id(x)] = a + sum(max(into[id(c)], out[id(c)]) if id(c) in score else into[id(c)] for c in x.children)
    left: set[int] = set()
    for x in nodes[1:]:
        if id(x.parent) in left or (id(x) in score and out[id(x)] > into[id(x)]):
            left.add(id(x))
    return left


def extract_all(pages: list[str], trees: Trees) -> list[str]:
    """The main text of each page."""
    parsed, rows = [], []
    for page in pages:
        nodes, events = parse(page)
        _measure(nodes, events)
        scored, x = describe(nodes, len(page))
        parsed.append((nodes, events, scored))
        rows.append(x)
    logits = trees.logits(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes, events, scored in parsed:
        score = {id(x): float(z) for x, z in zip(scored, logits[at : at + len(scored)], strict=True) if x.chars}
        at += len(scored)
        left = decode(nodes, score)
        blocks, now = [], []
        for node, text in events:
            if text is None:
                blocks.append(" ".join("".join(now).split()))
                now = []
            elif id(node) not in left:
                now.append(text)
        blocks.append(" ".join("".join(now).split()))
        out.append("\n".join(b for b in blocks if b))
    return out


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), trees: Trees | None = None) -> DataFrame:
    """The ``keep`` columns, text and n_chars of every row.

    White space inside a block is one space, blocks stand in page order on lines of their own.
    Null and empty pages, and pages without main text, give the empty text; broken markup is
    read to its end; repeated rows and ids are rows of their own; an empty table gives none.
    Pages are whole, however long. Only the named columns are read.
    """
    trees = trees or train()
    ship(pages.sparkSession)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        out: list[str] = []
        for lo in range(0, len(column), 100):
            out += extract_all([x or "" for x in column.slice(lo, 100).to_pylist()], trees)
        return pa.array(out, pa.string())

    return pages.select(*keep, text(F.col(html_col)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
