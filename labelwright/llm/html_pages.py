"""HTML parsing for extraction, and labelled pages to train on.

`parse` builds a tree of elements from any text: end tags that fit nothing are ignored, elements left open are closed by
their ancestors, and elements whose end tag may be left out close as usual. A quotation mark matters only where it begins
an attribute's value and has a partner; else a tag ends at the next `>`. Text outside of all elements belongs to a body of
its own. Character references are decoded; comments,
declarations and the contents of scripts, styles and the like are no text.

`labelled_pages` writes pages in many layouts whose article is marked with the attribute `data-main="1"` and whose parts
that don't belong to it with `data-main="0"`. The marks are read for training and are no input of the model.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that don't end a run of text.
_WITHIN_RUN = (INLINE | VOID | RAW) - {"hr", "title"}
#: Start tag -> open elements that it ends, up to the elements that hold them.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("article aside body div footer form header html main nav section table td th button".split())


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    parent: int
    depth: int
    #: Pieces of text: (number in page order, number of the run between two edges of blocks, text). A line break is a blank.
    pieces: list[tuple[int, int, str]] = field(default_factory=list)
    children: list[int] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(page: str) -> list[Node]:
    """The elements of a page in page order; the first is a root that holds all others."""
    nodes = [Node("#root", {}, -1, 0)]
    stack = [0]
    place = run = 0

    bare = -1

    def say(text: str) -> None:
        nonlocal place, bare
        if text:
            to = stack[-1]
            if to == 0 and not text.isspace():
                if bare < 0:
                    bare = len(nodes)
                    nodes.append(Node("body", {}, 0, 1))
                    nodes[0].children.append(bare)
                to = bare
            nodes[to].pieces.append((place, run, text))
            place += 1

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            say(html.unescape(page[at:]))
            break
        if m.start() > at:
            say(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        run += tag not in _WITHIN_RUN
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and nodes[stack[k]].tag in _SCOPE:
                    break
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == "p":
                    del stack[k:]
                    break
                if nodes[stack[k]].tag in _SCOPE:
                    break
        if tag in _CLOSES:
            ends, holders = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in holders:
                    break
                if nodes[stack[k]].tag in ends:
                    del stack[k:]
        nodes.append(Node(tag, _attributes(m[3]), stack[-1], len(stack)))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(len(nodes) - 1)
    return nodes


# Labelled pages ------------------------------------------------------------------------------------------------------

_WORDS = "alo bera cinto dure elva forin gasta hemel iro jarn kelto lumen mira nesto orva pelin quora resta silva tamen urbo vexa wylan xerti yondo zeph".split()


def labelled_pages(n: int = 240, seed: int = 9) -> list[str]:
    """Pages with marks, in layouts drawn at random."""
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice(_WORDS) for _ in range(rng.randint(a, b)))

    def prose(a: int = 1, b: int = 6) -> str:
        return " ".join(words(4, 16).capitalize() + rng.choice(".,.!?.") for _ in range(rng.randint(a, b)))

    def links(a: int, b: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{rng.choice(_WORDS)}">{words(1, 3)}</a></{tag}>' for _ in range(rng.randint(a, b)))

    def named(name: str) -> str:
        return rng.choice([f'class="{name}"', f'id="{name}"', f'class="{name} {rng.choice(_WORDS)}"', f'class="{rng.choice(["block", "box", "c", "content", "article", "post"])}-{name}"'])

    def off(tag: str, inner: str, names: list[str] | None = None) -> str:
        attribute = f" {named(rng.choice(names))}" if names else ""
        return f'<{tag}{attribute} data-main="0">{inner}</{tag}>'

    def menu() -> str:
        return rng.choice([
            off("nav", f"<ul>{links(3, 9)}</ul>"),
            off("div", f"<ul>{links(3, 9)}</ul>", ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar"]),
            off("ul", links(3, 9), ["menu", "nav", "links"]),
            off("div", links(3, 6, "span"), ["menu", "nav", "toolbar", "pagination", "pager"]),
        ])

    def header() -> str:
        return rng.choice([off("header", f"<h1>{words(1, 3)}</h1><p>{words(3, 6)}</p>" + menu()), off("div", f"<span>{words(2, 4)}</span>" + menu(), ["header", "masthead", "banner", "site-header"]), ""])

    def footer() -> str:
        inner = rng.choice([f"&copy; {words(1, 2)} &middot; {prose(1, 2)}", f"<p>Copyright {words(1, 3)}.</p><p>{prose(1, 2)}</p>", f"<ul>{links(2, 5)}</ul>", f"<p>{prose(1, 3)}</p>"])
        return rng.choice([off("footer", inner), off("div", inner, ["footer", "site-footer", "copyright", "legal", "bottom", "colophon"])])

    def side() -> str:
        inner = rng.choice([f"<h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul>", f"<p>{prose(1, 3)}</p>", f"<h4>{words(1, 3)}</h4><p>{prose(1, 2)}</p><p><a href='#'>{words(1, 3)}</a></p>"])
        return rng.choice([off("aside", inner), off("div", inner, ["sidebar", "side", "related", "widget", "rail", "aside", "recommended", "promo", "share", "social", "newsletter", "tags", "author-bio"])])

    def advert() -> str:
        inner = rng.choice([prose(1, 2), f"<p>{prose(1, 3)}</p>", f"<a href='x'>{words(2, 6)}</a>", f"<span>{words(1, 2)}</span><p>{prose(1, 1)}</p>"])
        return off(rng.choice(["div", "div", "section", "p", "ins", "aside"]), inner, ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "banner-ad", "promo", "adsbygoogle"])

    def notice() -> str:
        inner = rng.choice([f"<p>{prose(1, 2)}</p><button>{words(1, 1)}</button>", prose(1, 2), f"<p>{prose(1, 2)} <a href='p'>{words(1, 2)}</a></p>"])
        return off(rng.choice(["div", "section", "dialog"]), inner, ["cookie", "cookies", "cookie-banner", "consent", "gdpr", "notice", "popup", "modal", "alert", "overlay", "paywall", "subscribe"])

    def comments() -> str:
        inner = "".join(rng.choice([f'<div class="comment"><p>{prose(1, 3)}</p></div>', f"<li><p>{prose(1, 3)}</p></li>", f"<article><p>{prose(1, 3)}</p></article>", f"<p>{prose(1, 2)}</p>"]) for _ in range(rng.randint(1, 5)))
        return off(rng.choice(["div", "section", "ol"]), f"<h3>{words(1, 2)}</h3>" + inner, ["comments", "comment-list", "discussion", "replies", "responses", "disqus", "reader-comments"])

    def form() -> str:
        return off("form", f"<label>{words(1, 3)}</label><input name=q><select><option>{words(1, 2)}<option>{words(1, 2)}</select><button>{words(1, 1)}</button>")

    def block() -> str:
        kind = rng.random()
        if kind < 0.7:
            text = prose()
            return rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br><p>{prose()}</p>", f"<p>{prose(1, 2)} <a href='z'>{words(1, 3)}</a> {prose(1, 2)}</p>", f"<div>{text}</div>", f"<p><em>{words(1, 4)}</em> {text}</p>"])
        return rng.choice([
            f"<h2>{words(2, 6)}</h2>", f"<h3>{words(1, 5)}</h3>", f"<blockquote><p>{prose()}</p></blockquote>", "<ul>" + "".join(f"<li>{words(2, 9)}</li>" for _ in range(3)) + "</ul>", "<ol>" + "".join(f"<li>{prose(1, 1)}" for _ in range(3)) + "</ol>",
            f"<pre>{words(4, 12)}</pre>", f"<table><tr><td>{words(1, 3)}<td>{words(1, 3)}</table>", f"<figure><img src=a><figcaption>{words(3, 8)}</figcaption></figure>", f"<section><h2>{words(1, 4)}</h2><p>{prose()}</p></section>", f"<p>{words(1, 4)}.</p>",
        ])

    def article() -> str:
        parts = [f"<h1>{words(2, 9)}</h1>"] if rng.random() < 0.8 else []
        if rng.random() < 0.2:
            parts = [f"<header><h1>{words(2, 9)}</h1></header>"]
        parts += [block() for _ in range(rng.randint(1, 9))]
        for part, often in ((advert, 0.25), (side, 0.15), (form, 0.1), (notice, 0.1), (menu, 0.07)):
            if rng.random() < often:
                parts.insert(rng.randint(1, len(parts)), part())
        if rng.random() < 0.15:
            parts.append(comments())
        inner = "".join(parts)
        return rng.choice([
            f'<article data-main="1">{inner}</article>', f'<article data-main="1">{inner}</article>', f'<article {named("post")} data-main="1"><div>{inner}</div></article>', f'<main data-main="1">{inner}</main>',
            f'<main data-main="1"><article>{inner}</article></main>', f'<div {named(rng.choice(["content", "article", "post", "entry", "main", "story", "article-body", "entry-content"]))} data-main="1">{inner}</div>', f'<section {named("article")} data-main="1">{inner}</section>',
        ])

    pages = []
    for _ in range(n):
        before = "".join(x() for x, often in ((notice, 0.2), (header, 0.5), (menu, 0.8), (advert, 0.5), (form, 0.15), (side, 0.15)) if rng.random() < often)
        after = "".join(x() for x, often in ((comments, 0.3), (side, 0.3), (form, 0.15), (advert, 0.3), (notice, 0.15), (footer, 0.9)) if rng.random() < often)
        body = before + article() + after
        if rng.random() < 0.3:
            body = f'<div {named(rng.choice(["page", "wrapper", "container"]))}>{body}</div>'
        head = f"<head><title>{words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        pages.append(f"<!DOCTYPE html><html>{head}<body>{body}" + ("</body></html>" if rng.random() < 0.9 else ""))
    # Pages whose text, or its blocks, stand in the body itself, alone or beside parts that don't belong to it.
    for _ in range(n // 6):
        texts = [prose(1, 9) for _ in range(rng.randint(1, 3))]
        parts = [x() for x, often in ((menu, 0.3), (advert, 0.1), (footer, 0.3)) if rng.random() < often]
        if rng.random() < 0.4:
            inner = f"<h1>{words(1, 6)}</h1>" + "".join(block() for _ in range(rng.randint(1, 7)))
        else:
            inner = rng.choice(["<br>", "<br><br>", "<hr>", "\n"]).join(texts)
        pages.append(f'<body data-main="1">{inner}{"".join(parts)}</body>')
    return pages
