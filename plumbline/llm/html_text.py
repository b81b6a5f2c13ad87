"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page's block elements form a tree. Each node has features: its tag, groups of
its attributes' tokens and of its ancestors', depth, place among and likeness to
its siblings, and the density of text, links, sentences, lists and controls in
its subtree. Boosted trees give each node's odds of belonging to the article;
the labelling of the whole tree with the best total is taken in which nothing
below a dropped node is kept, so ancestors and descendants can't disagree.

The trees are trained here on pages that are composed at random from labelled
parts (articles of many shapes; menus, headers, footers, sidebars, notices,
adverts, forms, comments), always with the same seed.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rows, pieces, trimmed

MARKUP = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^"'>]++)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<!--.*?(?:-->|\Z)|<[!?/][^>]*+>?""", re.S)
#: As MARKUP, but a quote in a tag is like any other character.
PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|(?!)()()()|<!--.*?(?:-->|\Z)|<[!?/][^>]*+>?""", re.S)
#: Tags whose quotes don't end are read without them; where reading them has cost so many times the page (and so many characters more), quotes count no longer.
PATIENCE = 20, 1_000_000
UNENDED = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label|y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

#: Elements whose text is never shown as text.
UNSHOWN = {"script", "style", "head", "title", "noscript", "template", "svg", "iframe", "object", "annotation", "annotation-xml", "canvas", "audio", "video", "select", "textarea", "datalist"}
#: Their content is no markup.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe"}
#: What can stand in a head; any other start tag ends it.
IN_HEAD = set("html head title meta link base basefont bgsound style script noscript noframes template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr picture source area map param track embed math mi mn mo ms mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtext mspace mstyle mtable mtr mtd mpadded mphantom menclose mfenced mmultiscripts semantics".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("img hr input link meta base col".split())
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
TAGS = ["article", "main", "section", "p", "heading", "div", "list", "li", "nav", "header", "footer", "aside", "form", "table", "cell", "quote", "figure", "control", "body", "run", "other"]
TAG_OF = {t: t for t in TAGS} | {f"h{i}": "heading" for i in range(1, 7)} | dict(ul="list", ol="list", dl="list", menu="nav", dt="li", dd="li", tr="cell", td="cell", th="cell", tbody="table", thead="table", blockquote="quote", pre="quote", figcaption="figure", button="control", input="control", fieldset="form", html="body", center="div", details="section", summary="p", address="other", dialog="other")
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
GROUPS = {
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager toc tabs skip",
    "head": "header masthead topbar banner branding logo toolbar",
    "foot": "footer colophon copyright legal bottom imprint",
    "side": "sidebar aside rail related recommended recommendations widget widgets popular trending complementary secondary",
    "advert": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted dfp",
    "notice": "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup paywall warning disclaimer toast",
    "comment": "comment comments commentlist disqus reply replies discussion respond thread feedback",
    "social": "share sharing social follow facebook twitter",
    "form": "form search login register contact",
    "good": "article articles content post entry story main body text blog hentry prose",
}
GROUP_BITS = {w: 1 << i for i, words in enumerate(GROUPS.values()) for w in words.split()}
N_GROUPS = len(GROUPS)


@lru_cache(maxsize=50_000)
def groups_of(attributes: str) -> tuple[int, bool]:
    """Groups of the attributes' tokens as bits, and whether it is marked as boilerplate (training pages only)."""
    bits, marked = 0, False
    for name, value in ATTRIBUTE.findall(attributes):
        if name == "y":
            marked = True
        else:
            for token in WORD.findall(value):
                bits |= GROUP_BITS.get(token.lower(), 0)
    return bits, marked


class Page:
    """Block nodes of a page, parents before children, and its runs of text in page order."""

    __slots__ = ("parent", "tag", "bits", "marked", "depth", "runs", "controls", "images")

    def __init__(self, source: str):
        self.parent, self.tag, self.bits, self.marked, self.depth = [-1], [TAG_NUMBER["body"]], [0], [False], [0]
        self.controls, self.images = [0], [0]
        self.runs: list[list] = []  # [node, text, characters in links]
        self._parse(source)
        self._split_mixed()

    def _node(self, parent: int, tag: int, bits: int, marked: bool) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.bits.append(bits)
        self.marked.append(marked)
        self.depth.append(self.depth[parent] + 1)
        self.controls.append(0)
        self.images.append(0)
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        """One pass: each character is read a bounded number of times, however the markup is broken."""
        stack: list[tuple[str, int]] = [("html", 0)]
        places: dict[str, list[int]] = {}  # of the open elements of each name, in the stack
        unclosed: set[str] = set()  # names without an end tag in the rest of the page
        parts: list[str] = []
        at = links = linked = hidden = 0
        unshown = ""
        stop = source.rfind(">") + 1  # no tag ends behind it
        patience = PATIENCE[0] * len(source) + PATIENCE[1]
        markup = MARKUP

        def flush():
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.runs.append([stack[-1][1], text, min(linked, len(text))])
                parts.clear()
            linked = 0

        def leave(i: int):
            for name, _ in stack[i:]:
                places[name].pop()
            del stack[i:]

        def nearest(names) -> int:
            """The place of the innermost open element of these names, or 0."""
            return max((own[-1] for n in names if (own := places.get(n))), default=0)

        def end_of(name: str) -> int:
            """Where the next end tag of that name begins, or nowhere (-1)."""
            if name in unclosed:
                return -1
            found = re.compile(f"</{name}(?![a-z0-9-])", re.I).search(source, at)
            if not found:
                unclosed.add(name)
            return found.start() if found else -1

        while m := markup.search(source, at, stop):
            start = m.start()
            if start > at and not hidden:
                text = source[at:start]
                if "&" in text:
                    text = entities.unescape(text)
                parts.append(text)
                if links:
                    linked += len(text.strip())
            at = m.end()
            if m.group(2):
                end, name, attributes = m.group(1, 2, 3)
            else:
                end, name, attributes = m.group(4, 5, 6)
                if name and markup is MARKUP:
                    patience -= len(source) - start
                    if patience < 0:
                        markup = PLAIN
            if not name:
                if source.startswith("<!--", start) and not (at - start > 6 and source.endswith("-->", start, at)):
                    at = len(source)
                    break
                continue
            name = name.lower()
            if hidden:
                if name == unshown and name not in VOID:
                    hidden += -1 if end else 1
                    if end and hidden and end_of(name) < 0:
                        hidden = 0
                elif unshown == "head" and (name == "body" or not end and name not in IN_HEAD):
                    hidden, unshown = 0, ""
                elif unshown == "head" and not end and name in RAW:
                    close = end_of(name)
                    at = close if close >= 0 else len(source)
                    if close < 0:
                        break
                elif unshown == "head" and not end and name == "template":
                    unshown = name  # what can follow it in the head isn't shown anyway
                if hidden or unshown:
                    continue
            if name in UNSHOWN:
                if end or attributes.endswith("/") and name in ("svg", "iframe"):
                    continue
                if name == "select":
                    self.controls[stack[-1][1]] += 1
                close = end_of(name)
                if name in RAW:
                    at = close if close >= 0 else len(source)
                    if close < 0:
                        break
                elif close >= 0 or name == "head":
                    hidden, unshown = 1, name
                continue  # an element that nothing ends hides nothing but its own tag
            if name == "br":
                parts.append(" ")
                continue
            if name in INLINE:
                if name == "a":
                    links = 0 if end else 1
                continue
            if name == "img":
                self.images[stack[-1][1]] += 1
                continue
            if name == "input":
                self.controls[stack[-1][1]] += 1
                continue
            flush()
            if name in VOID:
                continue
            if end:
                if i := nearest(HEADINGS if name in HEADINGS else (name,)):
                    leave(i)
                continue
            links = 0
            if name in ("html", "body"):
                bits, marked = groups_of(attributes)
                self.bits[0] |= bits & 1 << N_GROUPS
                continue
            if name in CLOSED_BY_SAME:
                i = nearest((name,))
                if i > nearest(CLOSED_BY_SAME[name]):
                    leave(i)
            else:
                for i in range(len(stack) - 1, max(0, len(stack) - 3), -1):
                    if stack[i][0] == "p":
                        leave(i)
                        break
            bits, marked = groups_of(attributes) if attributes else (0, False)
            if name == "button":
                self.controls[stack[-1][1]] += 1
            places.setdefault(name, []).append(len(stack))
            stack.append((name, self._node(stack[-1][1], TAG_NUMBER[TAG_OF.get(name, "other")], bits, marked)))
        if at < len(source) and not hidden:
            rest = UNENDED.sub("", source[at:])
            parts.append(entities.unescape(rest) if "&" in rest else rest)
            if links:
                linked += len(rest.strip())
        flush()

    def _split_mixed(self) -> None:
        """Text beside blocks in the same parent becomes a node of its own."""
        inner = set(self.parent)
        for run in self.runs:
            if run[0] in inner:
                run[0] = self._node(run[0], TAG_NUMBER["run"], 0, False)


FEATURES = 21 + 2 * N_GROUPS + 8 + 22
ANCESTOR_TAGS = [TAG_NUMBER[t] for t in ("article", "main", "nav", "header", "footer", "aside", "form", "list")]


def features(page: Page) -> np.ndarray:
    """A row for each node."""
    n = len(page.parent)
    parent = page.parent
    chars, linked, runs, marks, words = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    before, seen = [0] * n, 0
    first = [None] * n
    for node, text, link in page.runs:
        size = len(text)
        chars[node] += size
        linked[node] += link
        runs[node] += 1
        marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        words[node] += text.count(" ") + 1
        if first[node] is None:
            first[node] = seen
        seen += size
    tag = page.tag
    P, H, LI = TAG_NUMBER["p"], TAG_NUMBER["heading"], TAG_NUMBER["li"]
    own = chars[:]
    paragraphs, headings, items, nodes = [int(t == P) for t in tag], [int(t == H) for t in tag], [int(t == LI) for t in tag], [1] * n
    controls, images, longest = page.controls[:], page.images[:], chars[:]
    children, last_child, index, previous, following = [0] * n, [-1] * n, [0] * n, [-1] * n, [-1] * n
    anc_bits, anc_tags = [0] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        index[i] = children[p]
        children[p] += 1
        if last_child[p] >= 0:
            previous[i], following[last_child[p]] = last_child[p], i
        last_child[p] = i
        anc_bits[i] = anc_bits[p] | page.bits[p]
        anc_tags[i] = anc_tags[p] | 1 << tag[p]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        runs[p] += runs[i]
        marks[p] += marks[i]
        words[p] += words[i]
        paragraphs[p] += paragraphs[i]
        headings[p] += headings[i]
        items[p] += items[i]
        nodes[p] += nodes[i]
        controls[p] += controls[i]
        images[p] += images[i]
        if longest[i] > longest[p]:
            longest[p] = longest[i]
        if first[i] is not None and (first[p] is None or first[i] < first[p]):
            first[p] = first[i]
    before = [0 if f is None else f for f in first]
    out = np.zeros((n, FEATURES), np.float32)
    t = np.array(tag)
    out[np.arange(n), t] = 1
    bits, above = np.array(page.bits), np.array(anc_bits)
    for g in range(N_GROUPS):
        out[:, 21 + g] = bits >> g & 1
        out[:, 21 + N_GROUPS + g] = above >> g & 1
    at = 21 + 2 * N_GROUPS
    tags_above = np.array(anc_tags)
    for k, a in enumerate(ANCESTOR_TAGS):
        out[:, at + k] = tags_above >> a & 1
    at += 8
    c, l, r = (np.array(x, np.float32) for x in (chars, linked, runs))
    total = max(1, seen)
    par = np.array([0, *parent[1:]])
    prev, foll = np.array(previous), np.array(following)
    density = c / np.array(nodes, np.float32)
    columns = [
        np.array(page.depth), np.log1p(c), c / total, l / np.maximum(c, 1), r, np.log1p(density), np.array(marks) / np.maximum(np.array(words), 1), np.array(words) / np.maximum(r, 1),
        np.array(paragraphs), np.array(headings), np.array(items) / np.array(nodes), np.log1p(np.array(nodes)), np.array(controls), np.array(images), np.log1p(np.array(longest)),
        np.array(before) / total, np.array(index) / np.maximum(np.array(children)[par], 1), np.array(children)[par], np.where(prev >= 0, np.log1p(c[prev]), -1), np.where(foll >= 0, np.log1p(c[foll]), -1),
        c / np.maximum(c[par], 1), np.log1p(np.array(own)),
    ]
    for k, column in enumerate(columns):
        out[:, at + k] = column
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth: cut feature and value of each inner node, log odds of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for f, v, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > v[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24) -> Trees:
    """Gradient-boosted trees for logistic loss, cut at quantiles of the features."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    width = bins + 1
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # x > c[b] iff code > b
    flat = code + np.arange(m) * width
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    f = np.full(n, start)
    inner = 2**depth - 1
    features_, cuts_, leaves_ = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(at == node)
                if len(own) >= 20:
                    codes = flat[own].ravel()
                    gs = np.bincount(codes, np.repeat(g[own], m), m * width).reshape(m, width).cumsum(1)
                    hs = np.bincount(codes, np.repeat(h[own], m), m * width).reshape(m, width).cumsum(1)
                    G, H = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1)
                    gain[(hs < 1) | (H - hs < 1)] = -1
                    best = int(gain.argmax())
                    j, b = divmod(best, width)
                    if gain[j, b] > (G[j] ** 2 / (H[j] + 1)).item() + 1e-6 and b < len(cuts[j]):
                        features_[t, node], cuts_[t, node] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), features_[t][at]] > cuts_[t][at])
        place = at - inner
        leaves_[t] = rate * np.bincount(place, g, 2**depth) / (np.bincount(place, h, 2**depth) + 1)
        f += leaves_[t][place]
    return Trees(features_, cuts_, leaves_, start)


def kept(page: Page, log_odds: np.ndarray) -> list[bool]:
    """The best labelling in which nothing below a dropped node is kept; the root is kept."""
    n = len(page.parent)
    yes, no = (-np.logaddexp(0, -log_odds)).tolist(), (-np.logaddexp(0, log_odds)).tolist()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        yes[p] += max(yes[i], no[i])
        no[p] += no[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[page.parent[i]] and yes[i] >= no[i]
    return out


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    rows = [features(p) for p in pages]
    odds = trees.log_odds(np.concatenate(rows))
    out, at = [], 0
    for page, row in zip(pages, rows):
        keep = kept(page, odds[at : at + len(row)])
        at += len(row)
        out.append(" ".join(text for node, text, _ in page.runs if keep[node]))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """Every page: page_id, url, text, n_chars (code points of text).

    Null and empty pages, and pages without an article, have an empty text.
    Broken markup is read as browsers would about do; a text without markup is
    its own main text. Repeated and null ids stay rows of their own; no rows
    give no rows; other columns are not carried. Nothing is shuffled.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trees or trained())
    kinds = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches):
            ids, urls, sources = batch.column(0), batch.column(1), batch.column(2)
            texts: list[str] = []
            lo, n = 0, len(sources)
            while lo < n:
                part, size = [], 0
                while lo < n and (not part or size < 4_000_000):
                    part.append(sources[lo].as_py() or "")
                    size += len(part[-1])
                    lo += 1
                texts += main_texts(part, sent.value)
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(trimmed(run), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def compose(rnd: random.Random) -> str:
    """A page of random parts; boilerplate carries the attribute y."""
    vocabulary = ["".join(rnd.choice("etaoinshrdlucmfwypvbgk") for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    word = lambda: rnd.choice(vocabulary)
    dotted = rnd.choice([0, 0, 0.05, 0.15, 0.3])  # punctuation is no sign of anything by itself
    mark = lambda: rnd.choice(".,.;:!") if rnd.random() < dotted else ""
    ends = rnd.choice([".", ".", ".!?", " ", ". "])
    sentence = lambda lo=4, hi=22: " ".join(word() + mark() for _ in range(rnd.randint(lo, hi))).capitalize() + rnd.choice(ends).strip()
    prose = lambda lo=1, hi=7: " ".join(sentence() for _ in range(rnd.randint(lo, hi)))
    link = lambda: f'<a href="/{word()}">{" ".join(word() + mark() for _ in range(rnd.randint(1, 3)))}</a>'

    def attribute(*names):
        own = rnd.choice(names + ("",) * 1 + (word(),))
        return f' {rnd.choice(["class", "id", "class"])}="{own}"' if own else ""

    def boiler(kind):
        k = rnd.random()
        if kind == "nav":
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 12))) + "</ul>" if k < 0.75 else " | ".join(link() for _ in range(rnd.randint(3, 9)))
            if rnd.random() < 0.05:
                return f"<table y=1 width=100%><tr><td{attribute('nav', 'menu')}>{inner}</td></tr></table>"
            return f"<nav y=1{attribute('menu', 'main-nav')}>{inner}</nav>" if rnd.random() < 0.6 else f'<div y=1 class="{rnd.choice(["menu", "navbar", "breadcrumb", "pagination", "top-nav"])}">{inner}</div>'
        if kind == "header":
            inner = rnd.choice(["", f"<h1>{word()}</h1>", f"<p>{sentence(2, 6)}</p>", f"<div>{link()} {link()}</div>"]) + rnd.choice(["", boiler("nav"), f"<span>{word()}</span>"])
            return f"<header y=1{attribute('masthead', 'site-header')}>{inner}</header>" if k < 0.6 else f'<div y=1 {rnd.choice(["class=header", "id=header", "class=masthead", "class=top-bar", "role=banner"])}>{inner}</div>'
        if kind == "footer":
            inner = rnd.choice([f"&copy; {word()}.example &middot; {sentence(2, 12)}", f"<p>&copy; {word()} {sentence(2, 9)}</p>", f"<ul><li>{link()}</li><li>{link()}</li></ul><p>{sentence(2, 12)}</p>", f"<p>{prose(1, 3)}</p>"])
            return f"<footer y=1{attribute('site-footer')}>{inner}</footer>" if k < 0.7 else f'<div y=1 {rnd.choice(["class=footer", "id=footer", "class=copyright", "class=legal"])}>{inner}</div>'
        if kind == "side":
            inner = f"<h3>{sentence(1, 4)}</h3>" * rnd.randint(0, 1) + rnd.choice(["<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 8))) + "</ul>", f"<p>{prose(1, 3)}</p>", f"<p>{link()} {sentence()}</p>" * rnd.randint(1, 4), f"{sentence()}"])
            return f"<aside y=1{attribute('sidebar', 'related')}>{inner}</aside>" if k < 0.6 else f'<div y=1 {rnd.choice(["class=sidebar", "id=sidebar", "class=related-posts", "class=widget", "class=rail", "class=recommended"])}>{inner}</div>'
        if kind == "advert":
            inner = rnd.choice([sentence(3, 16), f"<p>{prose(1, 3)}</p>", f"<a href=/x>{sentence(2, 8)}</a>", f"<h4>{sentence(1, 5)}</h4><p>{sentence()}</p>"])
            return f'<{rnd.choice(["div", "div", "section", "aside", "p"])} y=1 class="{rnd.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad", "advertisement"])}">{inner}</div>'
        if kind == "notice":
            inner = rnd.choice([f"<p>{prose(1, 3)}</p><button>{word()}</button>", f"{sentence()} <button>{word()}</button>", sentence(3, 20), f"<h3>{sentence(1, 4)}</h3><p>{prose(1, 2)}</p>"])
            return f'<{rnd.choice(["div", "section", "div"])} y=1 {rnd.choice(["class=cookie-notice", "id=cookie-banner", "class=consent", "class=notice", "role=alert", "class=newsletter-signup", "class=popup", "class=alert", "class=paywall"])}>{inner}</div>'
        if kind == "form":
            inner = "".join(rnd.choice([f"<label>{word()} <input name={word()}></label>", f"<p>{sentence(2, 8)}</p>", f"<label>{word()}</label><textarea>{word()}</textarea>", f"<select><option>{word()}<option>{word()}</select>"]) for _ in range(rnd.randint(1, 4)))
            return f"<form y=1{attribute('search-form', 'login')}>{inner}<button>{word()}</button></form>"
        if kind == "share":
            return f'<div y=1 class="{rnd.choice(["share", "social", "share-buttons"])}">' + " ".join(link() for _ in range(rnd.randint(2, 5))) + "</div>"
        one = lambda: rnd.choice(["<li>", "<div class=comment>", "<article class=comment>", "<div>"]) + f"<p>{rnd.choice(['<b>' + word() + '</b> ', ''])}{prose(1, 3)}</p>"
        opened = one()
        close = {"<li>": "</li>", "<di": "</div>", "<ar": "</article>"}
        inner = "".join(c + close[c[:4] if c[:4] == "<li>" else c[:3]] for c in [opened] + [one() for _ in range(rnd.randint(0, 5))])
        head = f"<h{rnd.choice('234')}>{sentence(1, 3)}</h3>" * rnd.randint(0, 1)
        return f'<{rnd.choice(["section", "div", "div"])} y=1 {rnd.choice(["class=comments", "id=comments", "id=disqus_thread", "class=comment-list", "class=discussion", "class=replies"])}>{head}{inner}</div>'

    def block():
        k = rnd.random()
        if k < 0.62:
            own = prose() if rnd.random() < 0.93 else f"{word().capitalize()}."
            return f"<p>{own}{rnd.choice(['</p>', '</p>', ''])}"
        if k < 0.70:
            return f"<p><b>{prose(1, 4)}<br>"
        if k < 0.78:
            return f"<h{rnd.choice('234')}>{sentence(1, 7)}</h2>"
        if k < 0.86:
            return f"<{(t := rnd.choice(['ul', 'ol']))}>" + "".join(f"<li>{rnd.choice([sentence(2, 14), link() + ' ' + sentence(2, 9)])}</li>" for _ in range(rnd.randint(2, 6))) + f"</{t}>"
        if k < 0.90:
            return f"<blockquote>{rnd.choice(['<p>', ''])}{prose(1, 3)}</blockquote>"
        if k < 0.93:
            return f"<pre>{prose(1, 2)}</pre>"
        if k < 0.96:
            return "<table>" + "".join(f"<tr><td>{word()}</td><td>{sentence(1, 6)}</td></tr>" for _ in range(rnd.randint(2, 5))) + "</table>"
        if k < 0.98:
            return f"<figure><img src=x><figcaption>{sentence(2, 10)}</figcaption></figure>"
        return f"<div>{prose(1, 5)}</div>"

    blocks = [block() for _ in range(rnd.choice([1, 2, 2, 4, 7, 12]))]
    if rnd.random() < 0.12:
        blocks = [f"<p>{sentence(1, 10)}</p>"]
    for kind in ("advert", "share", "side", "notice", "form"):
        if rnd.random() < 0.12:
            blocks.insert(rnd.randrange(len(blocks) + 1), boiler(kind))
    title = f"<h1>{sentence(2, 12)}</h1>" if rnd.random() < 0.8 else ""
    if title and rnd.random() < 0.15:
        title = f"<header>{title}{rnd.choice(['', f'<p>{sentence(2, 8)}</p>'])}</header>"
    body = title + "".join(blocks)
    if rnd.random() < 0.15:
        body += boiler("comment")
    k = rnd.random()
    if k < 0.5:
        body = f"<article{attribute('post', 'entry')}>{body}</article>"
    elif k < 0.65:
        body = f"<main{attribute('content')}>{body}</main>"
    elif k < 0.85:
        body = f'<div {rnd.choice(["class=content", "id=content", "class=post-body", "class=entry-content", "class=story", "id=main", "class=article-text"])}>{body}</div>'
    elif k < 0.95:
        body = f"<div{attribute()}>{body}</div>"
    if rnd.random() < 0.25:
        body = f"<{(t := rnd.choice(['main', 'div', 'section']))}>{body}{rnd.choice(['', boiler('side'), boiler('comment')])}</{t}>"
    top = "".join(boiler(kind) for kind, share in (("notice", 0.2), ("header", 0.45), ("nav", 0.7), ("form", 0.15), ("advert", 0.45), ("side", 0.15), ("share", 0.1)) if rnd.random() < share)
    end = "".join(boiler(kind) for kind, share in (("share", 0.12), ("comment", 0.3), ("side", 0.3), ("advert", 0.25), ("form", 0.15), ("notice", 0.15), ("nav", 0.15), ("footer", 0.75)) if rnd.random() < share)
    page = top + body + end
    if rnd.random() < 0.3:
        page = f"<div{attribute('wrapper', 'page', 'container')}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{sentence(2, 9)}</title><script>x</script></head><body>{page}</body></html>"


def examples(seed: int, pages: int) -> tuple[np.ndarray, np.ndarray, list[Page]]:
    """Features and labels of the nodes of composed pages."""
    rnd = random.Random(seed)
    made = [Page(compose(rnd)) for _ in range(pages)]
    labels = []
    for page in made:
        own: list[bool] = []
        for p, marked in zip(page.parent, page.marked):
            own.append(not marked and (p < 0 or own[p]))
        labels += own
    return np.concatenate([features(p) for p in made]), np.array(labels, float), made


@lru_cache(maxsize=1)
def trained(seed: int = 5, pages: int = 1_500) -> Trees:
    """Trees fitted to composed pages."""
    x, y, _ = examples(seed, pages)
    return boost(x, y)
