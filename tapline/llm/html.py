"""Main text of web pages: gradient-boosted trees over DOM nodes, and hierarchical decoding.

A page becomes a tree of nodes with features: tag, attribute tokens of the node and its ancestors, density of text,
links and marks in its subtree, depth, and its siblings' sizes. Boosted trees give each node the probability that
its subtree holds main text. A dynamic programme over the tree then keeps or drops nodes so that nothing below a
dropped node is kept, which single decisions could contradict.

The trees are fitted on generated layouts with known answers: a bounded, seeded set of pages in which menus,
headers, footers, sidebars, notices, adverts, forms and reader comments stand in many places and forms of markup.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, boost

_OPEN = re.compile(r"<(?:(!--|!\[CDATA\[|[!?])|(/?)([a-zA-Z][^\s/>]*))")
_OPEN_RUN = re.compile(r"<(!--|!\[CDATA\[)")
#: The rest of a tag in which quoted values hold no '>'; other tags are read value by value.
_SIMPLE_REST = re.compile(r"((?:[^>\"']|\"[^\">]*\"|'[^'>]*')*+)>")
_TO_VALUE = re.compile(r"[^>=]*(?:=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Fixed values of the HTML standard: element kinds.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes template".split())
_FOREIGN = frozenset(("svg", "math"))
_HEAD = frozenset("html base basefont bgsound link meta title noscript noframes style script template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp rb nobr math semantics annotation mrow mi mo mn ms mtext mspace msup msub msubsup mover munder munderover mfrac msqrt mroot mstyle mpadded mphantom menclose".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_HOLD = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": set(), "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_HOLD_P = ("table", "td", "th", "button")
#: Families of tags and of attribute tokens: one feature each.
TAGS = [{"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "input", "label", "legend"}, {"article", "main"}, {"section"}, {"div"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"table", "tbody", "tr", "thead"}, {"td", "th"}, {"body", "html"}, {"figure", "figcaption"}, {"address", "dialog", "details"}, {"object", "noscript", "canvas", "audio", "video", "svg", "select"}]
TOKENS = [
    "nav navigation navbar menu menubar topbar breadcrumb breadcrumbs crumbs pagination pager toc tabs links".split(),
    "header masthead banner logo branding top toolbar".split(),
    "footer foot contentinfo copyright colophon legal bottom imprint".split(),
    "sidebar side aside complementary widget widgets rail secondary column".split(),
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion dfp banner affiliate commercial outbrain taboola".split(),
    "cookie cookies consent gdpr notice notices alert warning disclaimer message announcement popup modal overlay dialog toast paywall privacy".split(),
    "form search login signin signup subscribe subscription newsletter register contact input feedback".split(),
    "comment comments commentlist disqus reply replies respond discussion discuss reviews feedback thread responses".split(),
    "share sharing social follow twitter facebook like buttons tools print".split(),
    "related recommended recommendations more popular trending also latest teaser teasers carousel tags tag category meta byline author".split(),
    "hidden skip sr visually offscreen".split(),
    "article post entry story blog news".split(),
    "content main body text maincontent primary prose richtext copy".split(),
]
_FAMILY = {t: [k for k, own in enumerate(TOKENS) if t in own] for t in {t for own in TOKENS for t in own}}
_TAG_FAMILY = {t: k for k, own in enumerate(TAGS) for t in own}
LABEL = "data-known-main"


def _tag_end(source: str, at: int) -> int:
    """Where the '>' of a tag is whose name ends at `at`: quoted values may hold others; there is one behind `at`.

    A quote that is never closed is taken for an ordinary character.
    """
    begin = at
    while True:
        at = _TO_VALUE.match(source, at).end()
        if at >= len(source):
            return source.find(">", begin)
        if source[at] == ">":
            return at
        if source[at] in "\"'":
            close = source.find(source[at], at + 1)
            if close < 0:
                return source.find(">", begin)
            at = close + 1
        else:
            at = _UNQUOTED.match(source, at).end()


def _skipped(source: str, m: re.Match, foreign: bool) -> int:
    """Where a comment, declaration or character data ends, as the standard has it.

    '<!-->' and '<!--->' are empty comments; outside svg and math '<![CDATA[' is a comment to the next '>'.
    """
    if m[1] == "!--":
        ends = [(source.find("-->", m.start() + 2), 3), (source.find("--!>", m.end()), 4)]
        stop, size = min((e for e in ends if e[0] >= 0), default=(-1, 0))
    else:
        mark = "]]>" if m[1] == "![CDATA[" and foreign else ">"
        stop, size = source.find(mark, m.end()), len(mark)
    return stop + size if stop >= 0 else len(source)


class Page:
    """The node arrays of a parsed page, and its text pieces: node, text, whether a block begins before it."""

    def __init__(self, source: str):
        self.parent, self.tag, self.families, self.label = [-1], ["#"], [()], [None]
        self.pieces: list[tuple[int, str, bool]] = []
        self.link = {}
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, at, links, fresh, lower = [0], 0, 0, True, None
        open_tags: list[str] = ["#"]
        where: dict[str, list[int]] = {}  # the places of each name among the open tags
        in_head = False
        last = source.rfind(">")  # a tag or declaration that begins behind it is text

        def close_last() -> str:
            nonlocal links
            top = open_tags.pop()
            stack.pop()
            where[top].pop()
            links -= top == "a"
            return top

        while True:
            m = _OPEN.search(source, at)
            if m and m.start() > last and m[1] in (None, "!", "?"):
                m = _OPEN_RUN.search(source, m.start())
            end = m.start() if m else len(source)
            if in_head and source[at:end].strip():
                in_head = False
            if end > at and not in_head:
                text = source[at:end]
                if text.strip():
                    self.pieces.append((stack[-1], _html.unescape(text), fresh))
                    if links:
                        self.link[len(self.pieces) - 1] = True
                    fresh = False
                elif not fresh:
                    self.pieces.append((stack[-1], " ", False))
            if not m:
                return
            if m[1]:
                at = _skipped(source, m, any(where.get(f) for f in _FOREIGN))
                continue
            name, closing = m[3].lower(), m[2]
            rest = _SIMPLE_REST.match(source, m.end())
            stop = rest.end() - 1 if rest else _tag_end(source, m.end())
            attributes, at = source[m.end() : stop], stop + 1
            if name == "head":
                in_head = not closing
                continue
            if name not in _HEAD and not closing:  # both tags around the head may be left out
                in_head = False
            if name in _RAW:
                if not closing and not attributes.endswith("/"):
                    lower = source.lower() if lower is None or len(lower) != len(source) else lower
                    found = lower.find("</" + name, at)
                    if len(lower) != len(source):  # a letter whose lower case is longer
                        close = re.compile("</" + name, re.I).search(source, at)
                        found = close.start() if close else -1
                    stop = source.find(">", found) if found >= 0 else -1
                    if found >= 0 or name != "template":  # a template that never ends is left open
                        at = stop + 1 if stop >= 0 else len(source)
                continue
            if name == "br":
                self.pieces.append((stack[-1], " ", False))
                continue
            if name in _VOID or attributes.endswith("/") and (name in _FOREIGN or any(where.get(f) for f in _FOREIGN)):
                fresh = fresh or name not in _INLINE
                continue
            inline = name in _INLINE
            if closing:
                while where.get(name):
                    top = close_last()
                    fresh = fresh or top not in _INLINE
                    if top == name:
                        break
                continue
            if not inline:
                fresh = True
                for names, hold in (({"p"}, _HOLD_P) if name in _CLOSES_P else ((), ()), (_SAME.get(name, ()), _HOLD.get(name, ()))):
                    # close down to the innermost of `names`, unless one of `hold` is inside it; repeatedly
                    innermost = lambda some: max((where[n][-1] for n in some if where.get(n)), default=-1)
                    while (floor := innermost(names)) >= 0 and floor > innermost(hold):
                        while len(open_tags) > floor:
                            close_last()
            marks = self._attributes(attributes) if attributes.strip(" /") else ((), None)
            if inline and not marks[0] and marks[1] is None:
                stack.append(stack[-1])
            else:
                self.parent.append(stack[-1])
                self.tag.append(name)
                self.families.append(marks[0])
                self.label.append(marks[1])
                stack.append(len(self.parent) - 1)
            where.setdefault(name, []).append(len(open_tags))
            open_tags.append(name)
            links += name == "a"

    @staticmethod
    def _attributes(source: str) -> tuple[tuple[int, ...], str | None]:
        words, label = [], None
        for name, value in _ATTRIBUTE.findall(source):
            name = name.lower()
            if name in ("class", "id", "role", "aria-label", "itemprop", "name"):
                words += _SPLIT.split(_CAMEL.sub(" ", value).lower())
            elif name in ("hidden",) or name == "style" and "display:none" in value.replace(" ", "").lower():
                words.append("hidden")
            elif name == LABEL:
                label = value.strip("\"'")
        return tuple(sorted({k for w in words for k in _FAMILY.get(w, ())} | ({len(TOKENS)} if len(words) > 0 else set()))), label


def _bits(masks: list[int], width: int) -> np.ndarray:
    return (np.array(masks, np.int64)[:, None] >> np.arange(width)) & 1


def node_features(page: Page) -> np.ndarray:
    """One row a node: tag and token families, those of its ancestors, densities, depth and siblings."""
    n, parent = len(page.parent), page.parent
    chars, linked, marks, words, parts = ([0] * n for _ in range(5))
    begin = [-1] * n
    total = 0
    for i, (node, text, _) in enumerate(page.pieces):
        size = len(text.strip())
        if size:
            chars[node] += size
            linked[node] += size * (i in page.link)
            marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            words[node] += text.count(" ") + 1
            parts[node] += 1
            if begin[node] < 0:
                begin[node] = total
            total += size
    own = np.log1p(chars)
    depth, tags, tokens, above, over, children = ([0] * n for _ in range(6))
    nodes, paragraphs = [1] * n, [t == "p" for t in page.tag]
    boiler = 1 << 0 | 1 << 2 | 1 << 3 | 1 << 4
    for i, (name, families) in enumerate(zip(page.tag, page.families)):
        k = _TAG_FAMILY.get(name)
        tags[i] = 0 if k is None else 1 << k
        for f in families:
            tokens[i] |= 1 << f
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            above[i] = above[p] | tokens[p]
            over[i] = over[p] | (tags[p] >> 5 & 1) | bool(tags[p] & boiler) << 1
            children[p] += 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        words[p] += words[i]
        parts[p] += parts[i]
        nodes[p] += nodes[i]
        paragraphs[p] += paragraphs[i]
        if begin[i] >= 0 and (begin[p] < 0 or begin[i] < begin[p]):
            begin[p] = begin[i]
    position, before, after, largest, last = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        if last[p]:
            position[i] = position[last[p]] + 1
            before[i], after[last[p]] = chars[last[p]], chars[i]
        last[p] = i
        largest[p] = max(largest[p], chars[i])
    up = np.maximum(parent, 0)
    depth, size, nodes, position = (np.array(v, float) for v in (depth, chars, nodes, position))
    siblings, whole = np.array(children, float)[up], max(1.0, size[0])
    ratio = lambda a, b: np.asarray(a) / np.maximum(1, b)
    rest = [depth, depth / max(1, depth.max()), np.log1p(size), size / whole, ratio(linked, size), ratio(np.array(marks) * 20, size), ratio(size, nodes), np.log1p(nodes), ratio(words, parts), own, children, paragraphs, position, siblings, position / np.maximum(1, siblings), np.log1p(before), np.log1p(after), ratio(size, np.array(largest)[up]), np.maximum(begin, 0) / whole]
    return np.column_stack([_bits(tags, len(TAGS)), _bits(tokens, len(TOKENS)), _bits(above, len(TOKENS)), *rest, _bits(over, 2)])


def decode(page: Page, probability: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the consistent choice of greatest likelihood. What is below a dropped node is dropped."""
    n = len(page.parent)
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p), np.log(1 - p)
    keep[0], best_drop = 0.0, drop.copy()
    best_keep = keep.copy()
    for i in range(n - 1, 0, -1):
        best_drop[page.parent[i]] += best_drop[i]
        best_keep[page.parent[i]] += max(best_keep[i], best_drop[i])
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and best_keep[i] >= best_drop[i]
    return kept


def text_of(page: Page, kept: np.ndarray) -> str:
    """The kept nodes' text: blocks in page order, white space in one space each, joined by one space."""
    blocks: list[list[str]] = []
    gap = True
    for node, text, fresh in page.pieces:
        gap = gap or fresh
        if kept[node]:
            if gap or not blocks:
                blocks.append([])
            blocks[-1].append(text)
            gap = False
        else:
            gap = True
    return " ".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


# ---- generated layouts ----------------------------------------------------------------------------------------------


class Layouts:
    """Seeded pages with known main text. LABEL marks nodes: 1 holds main text, 0 doesn't; others inherit."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        made = ["".join(r.choice(("th", "er", "on", "an", "re", "é", "ung", "que", "ci", "la", "ti", "sch", "o", "st", "ing")) for _ in range(r.choice((1, 1, 2, 2, 3)))) for _ in range(r.randint(low, high))]
        return " ".join(w + r.choice(("", "", "", "", "", ",", ".", " &amp;", "###")) if r.random() < 0.5 else w for w in made).capitalize() + r.choice((".", ".", "", "!"))

    def named(self, *names: str) -> str:
        r, name = self.r, self.r.choice(names)
        name = r.choice((name, name, f"{name}-{r.choice(('box', 'wrap', 'area', 'block', 'section', 'inner', 'x1'))}", f"{r.choice(('site', 'page', 'main', 'js', 'c'))}-{name}", f"{name} {r.choice(('clearfix', 'row', 'col', 'dark', 'u-12'))}"))
        return r.choice((f' class="{name}"', f' class="{name}"', f" id='{name}'", f' id="{name}" class="{r.choice(("b1", "grid", "wrapper"))}"'))

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(self.r.randint(low, high))]
        return self.r.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>", "".join(f"<div>{x}</div>" for x in items)))

    def part(self, tags: str, names: str, inside: str, plain: float = 0.0) -> str:
        tag = self.r.choice(tags.split())
        mark = "" if self.r.random() < plain else self.named(*names.split())
        return f'<{tag}{mark} {LABEL}="0">{inside}</{tag}>'

    def boilerplate(self, where: str) -> str:
        r, w = self.r, self.words
        sentence = r.choice((w(2, 6), w(5, 14), w(10, 40)))
        block = r.choice((sentence, f"<p>{sentence}</p>", f"<p>{sentence}</p><p>{w(4, 20)}</p>", f"<h3>{w(1, 3)}</h3><p>{sentence}</p>"))
        menu = lambda: r.choice((self.part("nav", "nav menu", self.links(), 0.6), self.part("div ul section", "nav menu navbar breadcrumbs pagination topmenu", self.links())))
        advert = lambda: r.choice((self.part("div aside section p", "ad ads advert sponsored promo advertisement banner-ad", block),) * 2 + (self.part("aside", "promo", block, 0.7),))
        notice = lambda: r.choice((self.part("div section aside p", "cookie-notice notice consent alert cookie-banner popup warning disclaimer newsletter-popup", block + r.choice(("", "<button>OK</button>", '<a href="#">OK</a>'))), f'<div role="{r.choice(("alert", "dialog"))}" {LABEL}="0">{block}</div>'))
        form = lambda: self.part("form div section", "form search newsletter subscribe login signup contact-form", f'<form action="/s" {LABEL}="0"><label>{w(1, 4)}</label><input type="text" name="q"><button>{w(1, 2)}</button></form>' + r.choice(("", f"<p>{w(4, 12)}</p>")), 0.3)
        plain_form = lambda: f'<form {LABEL}="0">{r.choice((f"<p>{sentence}</p>", sentence, f"<label>{w(1, 4)}</label>"))}<input name="e"><button>{w(1, 2)}</button></form>'
        side = lambda: r.choice((self.part("aside", "sidebar", f"<h3>{w(1, 3)}</h3>{self.links()}{r.choice(('', block))}", 0.5), self.part("div section", "sidebar side widget rail secondary related popular", f"<h4>{w(1, 3)}</h4>{r.choice((self.links(), block))}"), self.part("aside", "note", block, 0.9)))
        share = lambda: self.part("div ul p", "share social tags related meta", self.links(2, 5))
        comment = lambda: self.part(r.choice(("div", "section", "ol", "ul")), "comments comment-list commentlist reader-comments discussion responses disqus", r.choice(("", f"<h2>{w(1, 3)}</h2>", f"<h3>{w(1, 2)}</h3>")) + "".join(r.choice((f'<li class="comment"><p>{w(4, 45)}</p></li>', f'<div class="comment"><b>{w(1, 2)}</b><p>{w(4, 60)}</p></div>', f"<p>{w(4, 50)}</p>", f'<article class="comment"><header>{w(1, 2)}</header><p>{w(4, 40)}</p></article>', f'<div class="reply">{w(4, 30)}</div>')) for _ in range(r.randint(1, 6))))
        header = lambda: r.choice((self.part("header", "header masthead", r.choice((w(1, 5), f"<h1>{w(1, 4)}</h1>", f'<a href="/">{w(1, 3)}</a>{self.links()}', f"<p>{w(3, 10)}</p>")), 0.6), self.part("div", "header masthead topbar logo site-header", r.choice((w(1, 5), f"<h1>{w(1, 3)}</h1>", self.links()))), menu()))
        footer = lambda: r.choice((self.part("footer", "footer", f"&copy; {w(1, 4)} {r.choice((w(3, 12), self.links(), block))}", 0.7), self.part("div", "footer copyright legal colophon site-footer bottom", f"&copy; {w(2, 12)}{r.choice(('', self.links()))}")))
        return r.choice({"top": (header, menu, header, menu, advert, notice, form), "mid": (advert, notice, share, form, side, plain_form), "end": (footer, footer, comment, comment, side, share, form, plain_form, notice, menu, advert)}[where])()

    def article(self) -> str:
        r, w, out = self.r, self.words, []
        if r.random() < 0.8:
            out.append(f"<h1>{w(2, 9)}</h1>" if r.random() < 0.75 else f'<header {LABEL}="1"><h1>{w(2, 9)}</h1></header>')
        for _ in range(r.choice((1, 1, 1, 2, 2, 3, 4, 6, 9, 14))):
            k, size = r.random(), r.choice(((1, 6), (5, 20), (20, 60), (40, 160)))
            if k < 0.58:
                out.append(r.choice((f"<p>{w(*size)}</p>",) * 4 + (f"<p>{w(*size)}", f'<p>{w(*size)} <a href="/x">{w(1, 3)}</a> {w(*size)}</p>', f"<p><b>{w(*size)}<br>", f'<p class="{r.choice(("lead", "intro", "p1", "text"))}">{w(*size)}</p>')))
            elif k < 0.66:
                out.append(f"<h2>{w(1, 6)}</h2>")
            elif k < 0.73:
                out.append("<ul>" + "".join(f"<li>{w(2, 18)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.78:
                out.append(f"<blockquote><p>{w(6, 40)}</p></blockquote>")
            elif k < 0.82:
                out.append("<table>" + "".join(f"<tr><td>{w(1, 4)}</td><td>{w(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.86:
                out.append(f"<div>{w(*size)}</div>")
            elif k < 0.9:
                out.append(f"<section><h2>{w(1, 5)}</h2><p>{w(*size)}</p></section>")
            elif k < 0.93:
                out.append(f"<pre>{w(4, 20)}</pre>")
            elif k < 0.95:
                out.append(f"<figure><img src=x><figcaption>{w(3, 12)}</figcaption></figure>")
            else:
                out.append(self.boilerplate("mid"))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        body = self.article()
        tag, mark = r.choice((("article", ""), ("article", ""), ("main", ""), ("article", self.named("article", "post", "entry")), ("div", self.named("content", "main-content", "article-body", "entry-content", "post", "story")), ("section", self.named("content", "article")), ("div", ' role="main"'), ("div", "")))
        body = f'<{tag}{mark} {LABEL}="1">{body}</{tag}>'
        if r.random() < 0.35:
            extra = self.boilerplate(r.choice(("mid", "end")))
            outer, name = r.choice((("main", ""), ("div", self.named("content", "wrapper", "container", "layout")), ("div", "")))
            body = f'<{outer}{name} {LABEL}="1">' + r.choice((body + extra, extra + body, body)) + f"</{outer}>"
        top = "".join(self.boilerplate("top") for _ in range(r.randint(0, 3)))
        end = "".join(self.boilerplate("end") for _ in range(r.randint(0, 3)))
        if r.random() < 0.3:
            top += self.boilerplate("mid")
        page = f'<body {LABEL}="1">{top}{body}{end}'
        return "<!DOCTYPE html><html><head><title>x</title></head>" + page + r.choice(("</body></html>", ""))


#: Generated pages that the trees are fitted on.
LAYOUTS, SEED = 1000, 11


def labelled_nodes(page: Page) -> np.ndarray:
    """1 or 0 of every node: its own mark, or else that of the nearest node above it."""
    out = np.ones(len(page.parent))
    for i in range(1, len(out)):
        out[i] = float(page.label[i]) if page.label[i] is not None else out[page.parent[i]]
    for i in range(1, len(out)):  # a mark below dropped markup doesn't count
        out[i] = min(out[i], out[page.parent[i]])
    return out


@lru_cache(maxsize=2)
def model(layouts: int = LAYOUTS, seed: int = SEED) -> BoostedTrees:
    made = Layouts(seed)
    pages = [Page(made.page()) for _ in range(layouts)]
    return boost(np.vstack([node_features(p) for p in pages]), np.concatenate([labelled_nodes(p) for p in pages]))


def main_texts(sources: list[str], trees: BoostedTrees) -> list[str]:
    pages = [Page(s) for s in sources]
    sizes = [len(p.parent) for p in pages]
    p = trees.probability(np.vstack([node_features(x) for x in pages])) if pages else np.zeros(0)
    ends = np.cumsum(sizes)
    return [text_of(x, decode(x, p[e - s : e])) for x, s, e in zip(pages, sizes, ends)]


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars.

    Null or empty html, or one without main text, gives an empty text. Equal rows give equal results, an empty table
    an empty result; other columns are ignored. The whole html is read, whatever its length.
    """
    trees = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = main_texts([h.as_py() or "" for h in part.column(2)], trees.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
