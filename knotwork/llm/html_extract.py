"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the hierarchy.

Each block-level node is described by its subtree's density of text, links, marks and paragraphs, the tokens of
its tag, class, id and role, its depth, its siblings and the same for its parent. Boosted trees give the odds
that main text is in its subtree. Decoding takes the most likely set of kept nodes among the consistent ones: a
node is kept only with its ancestors, and what is under a dropped node is dropped.

The trees are trained here, on pages of a seeded generator (``drawn_page``) that lays out articles, menus, headers,
footers, sidebars, notices, adverts, forms and reader comments in many ways and knows which is which.

Defined cases: a null, empty or tagless text is treated like the text of a body (null: empty text); unclosed and
stray tags close as in browsers, roughly; comments, scripts, styles and the head are never text; character
references are decoded; white space, line breaks and block borders become one space; repeated rows are each
returned; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import functools
import html as references
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork.llm._shared import in_arrow, text_slices
from knotwork.llm._trees import BoostedTrees

# Kinds of elements, and tokens of class, id and role that tell of main text or of something else.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style template noscript title svg math iframe object textarea select datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input picture nobr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
GOOD_TOKENS = frozenset("article articlebody content contents main maincontent post postbody postcontent entry entrycontent story storybody text body bodytext page single hentry prose read reading blog news primary".split())
BAD_TOKENS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc pager pagination tabs topbar links skip".split(),
    "frame": "header head masthead footer foot bottom copyright colophon legal site brand logo banner top".split(),
    "side": "sidebar side aside widget widgets rail related recommended popular trending tags archive secondary complementary more teaser blogroll".split(),
    "advert": "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner-ad affiliate partner".split(),
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay dialog newsletter subscribe signup paywall message toast".split(),
    "form": "form search searchbox login signin contact input field register".split(),
    "comment": "comment comments commentlist reply replies respond disqus discussion responses reader readers feedback guestbook".split(),
    "share": "share sharing social follow like tweet author byline meta bio print tools".split(),
}
TAGS = "html body main article section div p h1 h2 h3 ul ol li table td nav header footer aside form blockquote pre figure figcaption button dl address details".split()

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,512}+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-label|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str]
    text: int = 0
    link: int = 0
    marks: int = 0
    tags: int = 0
    paragraphs: int = 0
    links: int = 0
    texts: int = 0
    own: int = 0
    children: list[int] = field(default_factory=list)


def _tokens(attributes: str) -> list[str]:
    found = []
    for name, value in _ATTR.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            for part in value.strip("\"'").split():
                words = _TOKEN.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", part).lower())
                found += words
                if len(words) > 1:
                    found.append("".join(words))
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            found.append("hidden")
    return found


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str, bool]]]:
    """Block-level nodes in page order, and the texts: node, decoded text, whether a break stands before it."""
    nodes = [Node("root", -1, 0, [])]
    texts: list[tuple[int, str, bool]] = []
    if not page:
        return nodes, texts
    # Open elements: tag, block node that they belong to, whether in a link, whether never text.
    stack = [("root", 0, False, False)]
    places: dict[str, list[int]] = {}  # of each open tag in the stack, from the bottom up
    broken = True

    def say(piece: str) -> None:
        nonlocal broken
        if stack[-1][3] or not piece:
            return
        piece = references.unescape(piece) if "&" in piece else piece
        bare = piece.strip()
        if bare:
            n = nodes[stack[-1][1]]
            n.own += len(bare)
            n.texts += 1
            n.marks += bare.count(",") + bare.count(".")
            if stack[-1][2]:
                n.link += len(bare)
        texts.append((stack[-1][1], piece, broken))
        broken = False

    def close(k: int) -> None:
        nonlocal broken
        for t, *_ in stack[k:]:
            broken |= t not in INLINE
            places[t].pop()
        del stack[k:]

    def innermost(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    # No tag ends behind the last ">", only a comment may begin there: looking for tags stops there.
    position, length, limit = 0, len(page), page.rfind(">") + 1
    while position < length:
        m = _TAG.search(page, position, limit)
        if not m:
            comment = page.find("<!--", max(position, limit))
            say(page[position : comment if comment >= 0 else length])
            break
        say(page[position : m.start()])
        position = m.end()
        if page.startswith("<!--", m.start()) and not page.endswith("-->", m.start() + 4, position):
            break
        name = m[2] or m[5]
        if not name:
            continue
        tag, ends, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ends:
            if k := innermost(tag):
                close(k)
            elif tag == "p":
                broken = True
            continue
        block = tag not in INLINE
        if block:
            if places.get("head") and tag not in NEVER and tag not in VOID:
                close(places["head"][0])
            if tag in CLOSES:
                ended, within = CLOSES[tag]
                floor = max(innermost(t) for t in within)
                above = [own[k] for t in ended if (own := places.get(t)) and (k := bisect_right(own, floor)) < len(own)]
                if above:
                    close(min(above))
            elif tag not in VOID:  # a block ends an open paragraph
                if k := innermost("p"):
                    close(k)
        never, linked, owner = stack[-1][3] or tag in NEVER, stack[-1][2] or tag == "a", stack[-1][1]
        if tag == "a":
            nodes[owner].links += 1
        if block and tag not in VOID and not never:
            nodes.append(Node(tag, owner, nodes[owner].depth + 1, _tokens(attributes) if attributes else []))
            nodes[owner].children.append(len(nodes) - 1)
            owner = len(nodes) - 1
        else:
            nodes[owner].tags += 1
        broken |= block or tag == "br"
        if tag in VOID or attributes.endswith("/") and block:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, position)
            position = end.end() if end else length
            broken = True
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, owner, linked, never))
    return nodes, texts


FAMILIES = list(BAD_TOKENS)
_FAMILY = {t: k for k, name in enumerate(FAMILIES) for t in BAD_TOKENS[name]}
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
_MEASURES = 22
WIDTH = _MEASURES + 2 * (len(FAMILIES) + 2) + len(TAGS)


def features(nodes: list[Node]) -> np.ndarray:
    """A row of measures for each node."""
    n = len(nodes)
    text, link, marks, tags, paragraphs, links, texts = (np.zeros(n) for _ in range(7))
    for k, x in enumerate(nodes):
        text[k], link[k], marks[k], tags[k], links[k], texts[k] = x.own, x.link, x.marks, x.tags + 1, x.links, x.texts
        paragraphs[k] = x.tag == "p"
    own = text.copy()
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        for total in (text, link, marks, tags, paragraphs, links, texts):
            total[p] += total[k]
    out = np.zeros((n, WIDTH))
    parent = np.array([max(0, x.parent) for x in nodes])
    place, count, same = np.zeros(n), np.ones(n), np.ones(n)
    for x in nodes:
        kinds: dict[str, int] = {}
        for c in x.children:
            kinds[nodes[c].tag] = kinds.get(nodes[c].tag, 0) + 1
        for j, c in enumerate(x.children):
            place[c], count[c], same[c] = j, len(x.children), kinds[nodes[c].tag]
    whole = max(1.0, text[0])
    size = np.maximum(1, text)
    density, linked = text / tags, link / size
    body = [own, text, text / whole, linked, links / tags, density, marks / size, paragraphs, paragraphs / tags, tags, texts, text / np.maximum(1, texts)]
    above = [text[parent] / whole, linked[parent], density[parent], paragraphs[parent]]
    around = [np.array([x.depth for x in nodes], float), place, count, place / count, same / count, text / np.maximum(1, text[parent])]
    for j, column in enumerate(body + above + around):
        out[:, j] = column
    base = _MEASURES
    kinds = len(FAMILIES) + 2
    for k, x in enumerate(nodes):
        for t in x.tokens:
            if t in _FAMILY:
                out[k, base + _FAMILY[t]] = 1
            if t in GOOD_TOKENS:
                out[k, base + kinds - 2] = 1
            if t == "hidden":
                out[k, base + kinds - 1] = 1
        if x.tag in ("nav", "header", "footer", "aside", "form"):
            out[k, base + {"nav": 0, "header": 1, "footer": 1, "aside": 2, "form": 5}[x.tag]] = 1
        if x.tag in ("article", "main"):
            out[k, base + kinds - 2] = 1
        if x.parent >= 0:  # what is above counts for what is below
            out[k, base + kinds : base + 2 * kinds] = np.maximum(out[x.parent, base : base + kinds], out[x.parent, base + kinds : base + 2 * kinds])
        if x.tag in _TAG_AT:
            out[k, base + 2 * kinds + _TAG_AT[x.tag]] = 1
    return out


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The likeliest set of kept nodes in which every kept node's ancestors are kept; the root is."""
    keep = -np.logaddexp(0, -odds)
    drop = -np.logaddexp(0, odds)
    best, gone = keep.copy(), drop.copy()
    for k in range(len(nodes) - 1, 0, -1):
        p = nodes[k].parent
        best[p] += max(best[k], gone[k])
        gone[p] += gone[k]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and best[k] > gone[k]
    return kept


def _joined(texts: list[tuple[int, str, bool]], kept: np.ndarray) -> str:
    parts, gap = [], False
    for node, piece, broken in texts:
        gap |= broken
        if kept[node]:
            parts.append(" " + piece if gap else piece)
            gap = False
        else:
            gap = True
    return _SPACE.sub(" ", "".join(parts)).strip()


# The generator of training pages.

_SYLLABLES = "an the ing re ti on es ver mi lo qua sen dor el fa un ke sch pa os".split()
_CONTAINERS = ["article", "article", "article", "main", "section", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'div class="entry-content"', 'div class="story"', 'section class="article-text"', 'div class="x12"', "div", 'td class="body"']
_BOILER = {
    "nav": ["nav", 'div class="menu"', 'div id="navbar"', 'ul class="nav-links"', 'div class="breadcrumbs"', 'div role="navigation"', 'ul class="c7"', 'section class="toc"'],
    "header": ["header", 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'div class="topbar"', 'header class="page-header"'],
    "footer": ["footer", 'div class="footer"', 'div id="site-footer"', 'div class="copyright"', 'section class="bottom"', 'div role="contentinfo"'],
    "side": ["aside", 'div class="sidebar"', 'div id="right-rail"', 'div class="related"', 'section class="recommended"', 'div class="widget"', 'aside class="popular"', 'div class="more-stories"'],
    "ad": ['div class="ad"', 'div class="advert"', 'div id="ad-top"', 'aside class="sponsored"', 'div class="promo"', 'section class="advertisement"', 'p class="ad"', 'ins class="adsbox"'],
    "notice": ['div class="cookie-notice"', 'div id="consent"', 'section class="notice"', 'div class="newsletter"', 'div class="alert"', 'p class="notice"', 'div role="dialog"', 'div class="paywall"', 'div class="popup"'],
    "form": ["form", 'form class="search"', 'div class="login-form"', 'form id="subscribe"'],
    "comment": ['section id="comments"', 'div class="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'section class="reader-comments"', 'div id="disqus"', 'div class="responses"'],
    "share": ['div class="share"', 'ul class="social"', 'div class="tools"'],
}


#: Stands at the start of every main text of a drawn page.
MARK = "\ue000"


def _prose(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.choice([1, 1, 2, 2, 3]))) for _ in range(r.randint(low, high))]
    for k in range(0, len(words), 9):
        words[k] = words[k].capitalize()
    return "".join(w + (". " if (k + 1) % 9 == 0 else ", " if r.random() < 0.08 else " ") for k, w in enumerate(words)).strip()


def _element(opening: str, inside: str) -> str:
    return f"<{opening}>{inside}</{opening.split()[0]}>"


def _boilerplate(r: random.Random, kind: str) -> str:
    opening = r.choice(_BOILER[kind])
    if kind in ("nav", "share"):
        links = [f'<a href="/{k}">{_prose(r, 1, 3)}</a>' for k in range(r.randint(3, 9))]
        inside = "".join(_element("li", x) for x in links)
        return _element(opening, inside if opening.startswith("ul") else _element("ul", inside) if r.random() < 0.7 else " | ".join(links))
    if kind == "header":
        inside = _element(r.choice(["h1", "h2", "div", "p"]), _prose(r, 1, 6)) + (_boilerplate(r, "nav") if r.random() < 0.4 else "")
    elif kind == "side":
        inside = _element("h3", _prose(r, 1, 3)) + "".join(_element("p", _prose(r, 5, 25)) if r.random() < 0.5 else f'<p><a href="#">{_prose(r, 3, 9)}</a></p>' for _ in range(r.randint(1, 5)))
    elif kind == "form":
        inside = f"<label>{_prose(r, 1, 4)}</label><input name=q>" + _element("button", _prose(r, 1, 2)) + (_element("p", _prose(r, 4, 20)) if r.random() < 0.5 else "")
    elif kind == "comment":
        row = r.choice(["div", "li", 'div class="comment"', "article", 'div class="reply"', "p"])
        inside = _element("h3", _prose(r, 1, 3)) + "".join(_element(row, (_element("b", _prose(r, 1, 2)) + " " if r.random() < 0.5 else "") + (_element("p", _prose(r, 5, 60)) if row != "p" else _prose(r, 5, 60))) for _ in range(r.randint(1, 6)))
    else:
        text = _prose(r, 3, 40)
        inside = text if r.random() < 0.5 or opening.startswith("p ") else _element("p", text)
        if kind == "footer":
            inside = "&copy; " + inside + (_boilerplate(r, "nav") if r.random() < 0.3 else "")
    return _element(opening, inside)


def drawn_page(r: random.Random) -> str:
    """A page whose main texts start with the mark U+E000."""
    parts = []
    for k in range(r.choice([0, 1, 1, 1, 2, 3, 5, 8, 14])):
        low, high = r.choice([(1, 3), (3, 12), (10, 40), (30, 120), (60, 300)])
        body = MARK + _prose(r, low, high)
        shape = r.random()
        if k and shape < 0.12:
            parts.append(_element(r.choice(["h2", "h3"]), MARK + _prose(r, 1, 8)))
        if shape < 0.7:
            parts.append(f"<p>{body}</p>")
        elif shape < 0.8:
            parts.append(f"<p><b>{body}<br>")
        elif shape < 0.85:
            parts.append(_element("ul", "".join(_element("li", MARK + _prose(r, 2, 25)) for _ in range(r.randint(2, 6)))))
        elif shape < 0.9:
            parts.append(_element(r.choice(["blockquote", "pre", "div", "section"]), body))
        elif shape < 0.94:
            parts.append(_element("table", _element("tr", _element("td", body) + _element("td", MARK + _prose(r, 1, 10)))))
        else:
            parts.append(f'<p>{body} <a href="/x">{_prose(r, 1, 4)}</a> {_prose(r, 2, 20)}</p>')
        if r.random() < 0.07:
            parts.append(_boilerplate(r, r.choice(["ad", "share", "form", "notice", "side"])))
    title = _element(r.choice(["h1", "h1", "h2"]), MARK + _prose(r, 1, 12)) if r.random() < 0.85 else ""
    tail = _boilerplate(r, "comment") if r.random() < 0.3 else ""
    main = r.choice(_CONTAINERS)
    article = _element(main, title + "".join(parts) + (tail if r.random() < 0.4 else ""))
    if main.startswith("td"):
        article = f"<table><tr><td>{_boilerplate(r, 'nav')}</td>{article}</tr></table>"
    if tail and tail not in article:
        article += tail
    before = [_boilerplate(r, k) for k in ("notice", "header", "nav", "ad", "form") if r.random() < 0.45]
    after = [_boilerplate(r, k) for k in ("side", "ad", "share", "form", "notice", "nav", "footer") if r.random() < 0.4]
    r.shuffle(before)
    if r.random() < 0.3:
        after.insert(0, after.pop()) if after else None
    page = "".join(before) + article + "".join(after)
    for _ in range(r.choice([0, 0, 1, 2])):
        page = _element(r.choice(["div", 'div class="wrap"', 'div id="page"', 'div class="container"']), page)
    return f"<html><head><title>{_prose(r, 2, 8)}</title><style>p{{}}</style></head><body><script>x('<p>')</script>{page}</body></html>"


@functools.cache
def trained(pages: int = 1200, seed: int = 11) -> BoostedTrees:
    """Trees fitted on drawn pages: a node is positive if main text is in its subtree."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes, texts = parse(drawn_page(r))
        y = np.zeros(len(nodes))
        for k, piece, _ in texts:
            if MARK in piece:
                while k >= 0:
                    y[k], k = 1, nodes[k].parent
        xs.append(features(nodes))
        ys.append(y)
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: list[str | None], trees: BoostedTrees) -> list[str]:
    parsed = [parse(p) for p in pages]
    odds = trees.score(np.concatenate([features(n) for n, _ in parsed])) if parsed else []
    out, at = [], 0
    for nodes, texts in parsed:
        out.append(_joined(texts, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def main_texts(pages: DataFrame, trees: BoostedTrees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    held = pages.sparkSession.sparkContext.broadcast(trees or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            texts = extract(part.column("html").to_pylist(), held.value)
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return in_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
