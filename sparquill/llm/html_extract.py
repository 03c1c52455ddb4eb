"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text is a binary variable, content or not. A variable has a potential from its own
features (tag, words of its class, id and role, length, share of links) and each parent-child pair one from their states.
Sum-product messages, upward and then downward, give exact marginals on the tree; text whose marginal passes one half is
kept. The weights are fitted by gradient ascent on the likelihood of labelled pages, which `labelled_pages` writes from
templates: menus, headers, sidebars, notices, adverts, forms, reader comments and footers around articles.

Null, empty and tag-free pages have defined results: null and empty give the empty text, text without any tag is one block
judged by its own features. Repeated rows each get their row; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What a "<" may start: comments, sections and declarations whole, of tags the name alone.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose inside is no page text, void elements, inline elements.
SKIPPED = frozenset("script style noscript template svg iframe object canvas select textarea button head title audio video".split())
#: Those of them that stand within a line of text, and don't end its block.
WITHIN = frozenset("svg iframe object canvas select textarea button audio video".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover q s samp semantics small span strike strong sub sup time tt u var".split())
#: An opening tag that ends an open element of the named ones.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
WORD = re.compile(r"[a-z]+")
#: Words of class, id and role that speak against and for content.
AGAINST = frozenset("nav navigation navbar menu header masthead topbar footer sidebar side aside ad ads adv advert advertisement adsense banner promo sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay comment comments reply replies respond discussion disqus share sharing social related recommended breadcrumb breadcrumbs form login signup subscribe subscription newsletter widget copyright legal pagination pager tags toolbar search hidden contentinfo complementary".split())
#: Words that name the place or kind of a block and speak for neither.
PLAIN = frozenset("a all area author bar block body bottom box btn button buttons card center class column container contact count cta details end entry feed field footer form group head heading icon icons id info inner input item items label layout left level line link links list listing local logo main map meta mobile module more name new news outer page pages pane panel part popular post posts primary reader readers row section secondary set site size slot small span sticky sub support switch tab tabs text thread title to toggle tool top tree unit up user users view wide wrap wrapper zone".split())
FOR = frozenset("article content main post entry story body text prose hentry".split())
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "body", "html", "dl")
COMMENTS = frozenset("comment comments reply replies respond discussion disqus".split())
#: Words that say enough whatever stands beside them.
SURE = frozenset("navbar navigation sidebar topbar masthead adsense advert advertisement breadcrumb breadcrumbs disqus gdpr newsletter sponsored contentinfo complementary pagination".split())


def said(value: str) -> frozenset:
    """What the words of class, id and role say: "against", "comments", "for", or "hint" for a word of AGAINST that others
    with a meaning of their own stand beside, as in notice-of-award."""
    out = set()
    for name in value.lower().split():
        words = set(WORD.findall(name))
        if words & AGAINST:
            if words <= AGAINST | FOR | PLAIN or words & SURE:
                out.add("against")
                if words & COMMENTS:
                    out.add("comments")
            else:
                out.add("hint")
        if words & FOR:
            out.add("for")
    return frozenset(out)


class Node:
    __slots__ = ("at", "features", "label", "linked", "parent", "tag", "text", "up")

    def __init__(self, parent: int, tag: str, words: frozenset, at: int = -1):
        self.parent, self.tag, self.at, self.text, self.linked, self.label = parent, tag, at, None, 0, 0
        # a tag speaks for itself only where no word of its class speaks against it
        self.features = ["tag=marked" if "against" in words else f"tag={tag}" if tag in TAGS else "tag=other", *sorted(words)]


class Tags:
    """Where tags end. A quoted value counts where what follows it can follow a value; any other quote is an ordinary sign,
    and a tag that no ">" outside of values ends goes to its first ">". What follows a place outside of values is the same
    for every tag that comes by, so places known to lead to no end are remembered and each is passed once."""

    def __init__(self, html: str):
        self.html, self.lost = html, set()

    def end(self, at: int) -> int:
        html = self.html
        first = html.find(">", at)
        if first < 0 or (html.find('"', at, first) < 0 and html.find("'", at, first) < 0):
            return first
        passed = []
        while (m := SPECIAL.search(html, at)) and m.start() not in self.lost:
            at = m.start()
            if html[at] == ">":
                return at
            passed.append(at)
            close = html.find(html[at], at + 1)
            at = close + 1 if close > 0 and (html[close + 1 : close + 2] or " ") in " \t\n\r\f\v/>" else at + 1
        self.lost.update(passed)
        return first


def parse(html: str) -> list[Node]:
    """Block elements and runs of text in page order; a parent always comes before its children."""
    nodes = [Node(-1, "html", frozenset())]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, and their node or that of the block around them
    opened: dict[str, list[int]] = {}  # where elements of a name stand in it
    tags = Tags(html)
    pieces: list[tuple[str, bool]] = []
    skip = links = 0

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(t for t, _ in pieces)).split())
            if text:
                n = Node(stack[-1][1], "#text", frozenset(), len(nodes))
                n.text, n.linked = text, min(1.0, sum(len(t) for t, a in pieces if a) / max(1, len(text)))
                nodes.append(n)
            pieces.clear()

    def pop() -> None:
        nonlocal skip, links
        tag, _ = stack[-1]
        if tag not in INLINE and tag not in WITHIN and (not skip or tag in SKIPPED):
            flush()
        stack.pop()
        opened[tag].pop()
        skip -= tag in SKIPPED
        links -= tag == "a"

    def last_of(names: set | frozenset) -> int:
        return max((opened[t][-1] for t in names if opened.get(t)), default=0)

    def close(names: set | frozenset, stops: frozenset) -> None:
        k = last_of(names)
        if k > last_of(stops):
            while len(stack) > k:
                pop()

    at, end, last = 0, len(html), html.rfind(">")
    closing: dict[str, int] = {}  # where the last closing tag of a name is

    def closed_after(tag: str, at: int) -> bool:
        if tag not in closing:
            closing[tag] = max((m.start() for m in re.finditer(rf"</{tag}[\s/>]", html, re.I)), default=-1)
        return closing[tag] >= at

    while at < end:
        # a comment needs no ">" to end, everything else does
        m = MARKUP.search(html, at) if at <= last or html.find("<!--", at) >= 0 or html.find("<![CDATA[", at) >= 0 else None
        if m and m[2] is not None and (close_at := tags.end(m.end())) < 0:
            m = MARKUP.search(html, m.end()) if html.find("<!--", at) >= 0 or html.find("<![CDATA[", at) >= 0 else None
            while m and m[2] is not None:
                m = MARKUP.search(html, m.end())
        start = m.start() if m else end
        if start > at and not skip:
            pieces.append((html[at:start], links > 0))
        if not m:
            break
        if m[2] is None:
            at = m.end()
            continue
        inside, at = html[m.end() : close_at], close_at + 1
        tag = m[2].lower()
        if m[1]:
            if tag == "br" and not skip:
                pieces.append((" ", links > 0))
            close({tag}, frozenset() if tag not in INLINE else frozenset(["td", "table"]))
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif not skip:
                pieces.append((" ", False) if tag in ("br", "img", "input") else ("", False))
            continue
        if tag == "html":
            continue
        if skip and (tag == "body" or tag in ENDS_P) and any(t == "head" for t, _ in stack[1:3]):
            close({"head"}, frozenset())
        if tag == "button" and skip:
            close({"button"}, frozenset(["table", "form"]))
        if tag in SKIPPED and tag not in RAW and not closed_after(tag, at):
            continue  # an element that nothing ends can't hide the rest of the page
        if tag in ENDS_P:
            close({"p"}, frozenset(["table", "td", "article", "section", "div", "button"]))
        if tag in CLOSES:
            close(CLOSES[tag], frozenset(["ul", "ol", "table", "dl", "select"]))
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        block = stack[-1][1]
        if tag in WITHIN and not skip:
            pieces.append((" ", links > 0))
        if tag not in INLINE and tag not in WITHIN and not skip:
            flush()
            if tag not in SKIPPED:
                named = " ".join(b or c or d for a, b, c, d in ATTRIBUTE.findall(inside) if a.lower() in ("class", "id", "role", "itemprop")) if inside else ""
                words = said(named)
                if inside and re.search(r"display\s*:\s*none|\bhidden\b|aria-hidden\s*=\s*[\"']?true", inside, re.I):
                    words |= {"against"}
                nodes.append(Node(block, tag, words, len(nodes)))
                block = len(nodes) - 1
        if inside.endswith("/") and tag in INLINE:
            continue
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, block))
        skip += tag in SKIPPED
        links += tag == "a"
    while len(stack) > 1:
        pop()
    flush()
    for n in nodes:
        if n.text is not None:
            k = len(n.text)
            around = nodes[n.parent].tag if n.parent >= 0 else ""
            n.features += [f"length={min(6, int(math.log2(k + 1) // 1.5))}", f"links={int(n.linked * 3.99)}", "ends" if n.text[-1] in ".!?:" else "open", f"in={around}" if around in TAGS else "in=other"]
            if re.search(r"©|all rights reserved|copyright", n.text, re.I):
                n.features.append("rights")
    return nodes


def edge(parent: Node, child: Node) -> str:
    """Pairs share potentials by what the child is."""
    return "text" if child.text is not None else "comments" if "comments" in child.features else "against" if "against" in child.features else "block"


def marginals(nodes: list[Node], w: dict) -> tuple[list[float], list]:
    """Probability of content of each node, and of the four states of each node with its parent."""
    n = len(nodes)
    unary = [sum(w.get(f, 0.0) for f in x.features) for x in nodes]
    e = [None] + [[w.get((edge(nodes[x.parent], x), a, b), 0.0) for a in (0, 1) for b in (0, 1)] for x in nodes[1:]]
    low, high = [0.0] * n, [0.0] * n  # products of the messages from below, as logarithms
    up: list = [None] * n
    for k in range(n - 1, 0, -1):
        m0, m1 = low[k], high[k] + unary[k]
        f = e[k]
        a = [_add(f[0] + m0, f[1] + m1), _add(f[2] + m0, f[3] + m1)]
        up[k] = a
        low[nodes[k].parent] += a[0]
        high[nodes[k].parent] += a[1]
    down = [(0.0, 0.0)] * n
    p, pair = [0.0] * n, [None] * n
    for k in range(n):
        if k:
            q = nodes[k].parent
            r0 = down[q][0] + low[q] - up[k][0]
            r1 = down[q][1] + high[q] + unary[q] - up[k][1]
            f = e[k]
            down[k] = (_add(f[0] + r0, f[2] + r1), _add(f[1] + r0, f[3] + r1))
            c = [f[0] + r0 + low[k], f[1] + r0 + high[k] + unary[k], f[2] + r1 + low[k], f[3] + r1 + high[k] + unary[k]]
            top = max(c)
            c = [math.exp(x - top) for x in c]
            total = sum(c)
            pair[k] = [x / total for x in c]
        d = down[k][1] + high[k] + unary[k] - down[k][0] - low[k]
        p[k] = 1 / (1 + math.exp(-max(-500.0, min(500.0, d))))
    return p, pair


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


SYLLABLES = "ba con da el fer gin ho in jor ka lu men no os pra qui ren sti tor un ver wa".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)).capitalize() + rng.choice([".", ".", ".", ".", "", " |", "!"])


def labelled_pages(n: int = 300, seed: int = 11) -> list[str]:
    """Pages whose content stands marked: \\x02 starts each of its text runs."""
    rng = random.Random(seed)
    text = lambda a, b: prose(rng, rng.randint(a, b))
    keep = lambda a, b: "\x02" + (text(a, b).rstrip(".!| ") + rng.choice(ends))
    links = lambda k: "".join(f'<li><a href="/{i}">{text(1, 2)}</a></li>' for i in range(k))
    pages = []
    for _ in range(n):
        pick = rng.random
        ends = ([".", ".", ".", ".", "!", ""], ["", "", "", "", " |"])[pick() < 0.25]  # some pages hardly end a sentence
        name = lambda *x: rng.choice(x)
        nav = name(f"<nav><ul>{links(rng.randint(3, 8))}</ul></nav>", f'<div class="{name("menu", "navbar", "top-nav")}"><ul>{links(5)}</ul></div>')
        head = name("", f"<header><h1>{text(1, 3)}</h1><p>{text(3, 8)}</p></header>", f'<div id="header"><a href="/">{text(1, 2)}</a><p>{text(3, 9)}</p></div>')
        side_note = f'<div class="{name("promo-autumn", "ad-partner", "share-this", "cookie-hinweis")}">{text(3, 12)}</div>' if pick() < 0.2 else ""
        ad = side_note + name("", f'<div class="{name("ad", "ads banner", "sponsored", "promo")}">{text(3, 25)}</div>')
        note = name("", f'<div class="{name("cookie-notice", "alert", "consent")}"><p>{text(6, 20)}</p></div>')
        side = name("", f"<aside><h3>{text(1, 3)}</h3><p>{text(5, 40)}</p><ul>{links(4)}</ul></aside>", f'<div class="{name("sidebar", "widget", "related")}"><h2>{text(1, 3)}</h2><ul>{links(5)}</ul><p>{text(4, 30)}</p></div>')
        form = name("", f'<form action="/s"><label>{text(1, 3)}</label><input name="q"><p>{text(3, 12)}</p></form>', f'<div class="{name("newsletter", "login")}"><form><p>{text(4, 15)}</p></form></div>')
        blocks = [f"<p>{keep(4, name(30, 90, 90, 400))}</p>" if pick() < 0.8 else name(f"<h2>{keep(2, 6)}</h2>", f"<ul><li>{keep(2, 12)}</li><li>{keep(2, 12)}</li></ul>", f"<blockquote><p>{keep(8, 40)}</p></blockquote>", f"<p>{keep(1, 2)}</p>", f"<pre>{keep(4, 20)}</pre>", f"<table><tr><td>{keep(1, 4)}</td><td>{keep(1, 4)}</td></tr></table>", f"<p><b>{keep(3, 40)}<br><p>{keep(4, 30)}</p>") for _ in range(rng.randint(1, 12))]
        if pick() < 0.2:
            blocks += [f"<p>{keep(1, 4)}</p>" for _ in range(rng.randint(5, 60))]
        if pick() < 0.3:
            blocks.insert(rng.randint(0, len(blocks)), f'<div class="{name("ad", "promo", "share", "related", "newsletter")}"><p>{text(3, 30)}</p></div>')
        if pick() < 0.15:
            odd = name("notice-of-award", "comment-piece", "header-story", "alert-history", "related-work-study", "menu-of-the-day")
            blocks.insert(rng.randint(0, len(blocks)), f'<{(t := name("section", "div"))} class="{odd}"><p>{keep(12, 90)}</p><p>{keep(12, 90)}</p></{t}>')
        inner = f"<h1>{keep(2, 12)}</h1>" + "".join(blocks)
        talk = name("", "", f'<{(t := name("section", "div"))} {name("class", "id")}="{name("comments", "comment-list", "disqus")}"><h3>{text(1, 2)}</h3>' + "".join(f'<{(u := name("div", "article", "li"))} class="comment"><p>{text(4, 60)}</p></{u}>' for _ in range(rng.randint(1, 5))) + f"</{t}>")
        inside = pick() < 0.3
        inner += talk if inside else ""
        if pick() < 0.08:
            inner = f'<article class="{name("comment-piece", "notice-story", "header-feature")}">{inner}</article>'
        main = name(f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f"<main>{inner}</main>", f'<div class="{name("content", "post-body", "entry", "story")}">{inner}</div>', f'<div id="main"><div class="text">{inner}</div></div>', f"<article>{inner}</article>", f"<div>{inner}</div>", inner)
        foot = name(f"<footer>&copy; {text(1, 3)} {text(4, 15)}</footer>", f'<div id="footer"><p>&copy; {text(3, 10)}</p><ul>{links(3)}</ul></div>')
        before, after = [nav, head, ad, note], [form, side, "" if inside else talk]
        if pick() < 0.3:
            rng.shuffle(before)
        if pick() < 0.3:
            before.append(side)
            after.remove(side)
        pages.append(f"<!DOCTYPE html><html><head><title>{text(2, 6)}</title></head><body>" + "".join(before) + main + "".join(after) + foot + "</body></html>")
    return pages


@functools.cache
def fit(passes: int = 16, rate: float = 0.5, decay: float = 1e-4, seed: int = 5) -> dict:
    """Weights that maximise the likelihood of the labelled pages."""
    pages = []
    for html in labelled_pages():
        nodes = parse(html)
        for n in nodes:
            n.label = int(n.text is not None and "\x02" in n.text)
            if n.label:
                n.text = n.text.replace("\x02", "")
        for n in reversed(nodes[1:]):
            nodes[n.parent].label |= n.label
        pages.append(nodes)
    w: dict = {}
    rng = random.Random(seed)
    for t in range(passes):
        rng.shuffle(pages)
        step = rate / (1 + t / 3)
        for nodes in pages:
            p, pair = marginals(nodes, w)
            scale = step / math.sqrt(len(nodes))
            for k, n in enumerate(nodes):
                for f in n.features:
                    w[f] = w.get(f, 0.0) * (1 - step * decay) + scale * (n.label - p[k])
                if k:
                    q = nodes[n.parent]
                    for s in range(4):
                        f = (edge(q, n), s >> 1, s & 1)
                        w[f] = w.get(f, 0.0) * (1 - step * decay) + scale * ((q.label * 2 + n.label == s) - pair[k][s])
    return w


def main_text(html: str | None, w: dict) -> str:
    if not html:
        return ""
    nodes = parse(html)
    p, _ = marginals(nodes, w)
    return "\n\n".join(n.text for n, q in zip(nodes, p, strict=True) if n.text is not None and q > 0.5)


def extract_texts(w: dict):
    """mapInArrow function: html to main text."""

    def run(it):
        for b in common.slices(it):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x, w) for x in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return rows.mapInArrow(extract_texts(weights or fit()), "page_id bigint, url string, text string")
