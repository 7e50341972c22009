"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

A page is parsed into elements and, below them, text blocks. Every node gets features of
its subtree (text, link and tag density), its attribute tokens and those above it, its
depth and its siblings; the trees turn them into log odds that the node holds main text.
Decoding chooses a set of nodes that is closed towards the root: a node is kept only with
its parent, and a subtree is kept when the sum of its best choice is positive, so a kept
block never stands in a dropped section and a section is never kept for nothing.

The trees are trained on pages that `synthetic_page` writes, in many layouts and with
known answers, once in a process and always alike.

Reading takes time in proportion to the page, whatever its markup: every character is read
once, and what is open is looked up by name. Nodes are scored in slices, so a page needs
memory for its nodes but not for all their features.

Defined cases: a null or empty page has no text; text that is not in any element is a
block of the page; unclosed, misnested and unknown tags are read as browsers do in outline,
but a quote that never ends is an ordinary character; a tag that never ends is markup to
the end of the page; formulas, drawings, embedded objects and what stands in for scripts are
read like other elements; rows are independent, so repeated rows and null ids need nothing;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import ship

# Names of the HTML vocabulary.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd mark noscript object output picture q rp rt ruby s samp small span strike strong sub sup svg template time tt u var video wbr math semantics annotation mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose g path circle ellipse rect line polyline polygon text tspan defs use symbol desc".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}

# Groups of tags and of attribute words.
TAGS = ["#text", "p", "h1", "h2 h3 h4 h5 h6", "li", "ul ol menu dl", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form fieldset label button option optgroup select datalist legend", "table tbody thead tfoot tr td th caption", "blockquote pre figure figcaption dt dd details summary", "html", "body"]
WORDS = [
    "content article post entry story main body text maincontent copy prose page",
    "nav navigation navbar menu menubar breadcrumb breadcrumbs crumbs pagination pager toc links tabs skip",
    "header head masthead top topbar logo brand hero branding",
    "footer foot copyright legal bottom colophon imprint credits",
    "sidebar side aside widget widgets rail related recommended recommendations popular trending more read secondary",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner teaser dfp adsbygoogle",
    "cookie cookies consent notice notices alert gdpr modal popup overlay paywall warning message privacy disclaimer dialog toast",
    "form search login signup signin register subscribe subscription newsletter contact poll survey",
    "comment comments reply replies respond discussion disqus feedback thread reactions commentlist reader",
    "share sharing social tags meta byline author date follow toolbar actions",
]
TAG_OF = {name: k for k, names in enumerate(TAGS) for name in names.split()}
WORD_OF = {word: k for k, words in enumerate(WORDS) for word in words.split()}
OTHER = len(TAGS)

_NAMED = frozenset("class id role aria-label itemprop itemtype".split())

# No part of these can give back what it has read.
_OPEN = re.compile(r"[a-zA-Z][^\s/>]*+")
_SIMPLE = re.compile(r"((?:\s++[^\s=>\"'/<]++(?:=(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s>\"'<=`]++))?)*+)\s*+/?>")
_GAP, _NAME, _EQUALS, _VALUE = (re.compile(p) for p in (r"[\s/]*+", r"=?[^\s/>=]*+", r"\s*+=\s*+", r"[^\s>]*+"))
_PAIR = re.compile(r"(?<![^\s\"'/])([^\s=\"'/<]++)=(?:\"([^\"]*+)\"|'([^']*+)'|(\S++))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{8,}));?")
_PAUSE = re.compile(r"[.,;:!?。、]")


def _groups(pairs: list[tuple[str, str]]) -> int:
    """Bits of the groups that the words of some attributes are in."""
    mask = 0
    for name, value in pairs:
        if name in _NAMED or name.startswith("data-"):
            for token in _TOKEN.findall(value):
                group = WORD_OF.get(token.lower())
                if group is not None:
                    mask |= 1 << group
    return mask


@functools.lru_cache(4096)
def _attribute_groups(attributes: str) -> int:
    return _groups([(name.lower(), "".join(values)) for name, *values in _PAIR.findall(attributes)])


def _small(found: re.Match) -> str:
    """A long number of a character reference without its leading zeros."""
    digits, base = (found[1], "") if found[1] else (found[2], "x")
    digits = digits.lstrip("0")
    return f"&#{base}{digits or 0};" if len(digits) < 8 else "\ufffd"


class Page:
    """The nodes of a page in page order, parents before children; blocks are leaves with text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.words = [-1], ["#page"], [0]
        self.links, self.blocks, self.link_chars = [0], {}, {}
        self.source, self.last_quote = source, {q: source.rfind(q) for q in "\"'"}
        #: Open elements, and for each name where it stands among them.
        self.stack, self.where = [(0, "#page")], {}
        self.buffer, self.linked, self.inlines = [], 0, {}
        self._read()

    def _add(self, tag: str, words: int = 0) -> int:
        self.parent.append(self.stack[-1][0])
        self.tag.append(tag)
        self.words.append(words)
        self.links.append(0)
        return len(self.parent) - 1

    def _open(self, name: str, words: int) -> None:
        self.where.setdefault(name, []).append(len(self.stack))
        self.stack.append((self._add(name, words), name))

    def _flush(self) -> None:
        text = "".join(self.buffer)
        if "&" in text:
            text = html.unescape(_NUMBER.sub(_small, text))
        text = " ".join(text.split())
        self.buffer.clear()
        if text:
            node = self._add("#text")
            self.blocks[node], self.link_chars[node] = text, min(self.linked, len(text))
        self.linked = 0

    def _close(self, names: tuple, stop: tuple = ()) -> None:
        """Close the innermost element of some names, unless one of the others is further in."""
        last = lambda some: max((self.where[x][-1] for x in some if self.where.get(x)), default=0)
        at = last(names)
        if not at or stop and last(stop) > at:
            return
        self._flush()
        self.inlines.clear()
        while len(self.stack) > at:
            self.where[self.stack.pop()[1]].pop()

    def _attributes(self, at: int) -> tuple[int, int]:
        """Where a tag ends whose attributes begin here, and their groups; the end of the page if it never does."""
        source, pairs = self.source, []
        while True:
            at = _GAP.match(source, at).end()
            if at >= len(source):
                return len(source), 0
            if source[at] == ">":
                return at + 1, _groups(pairs)
            found = _NAME.match(source, at)
            name, at, value = found[0].lower(), found.end(), ""
            found = _EQUALS.match(source, at)
            if found:
                at = found.end()
                quote = source[at : at + 1]
                if quote in ("'", '"') and self.last_quote[quote] > at:
                    end = source.index(quote, at + 1)
                    value, at = source[at + 1 : end], end + 1
                else:
                    found = _VALUE.match(source, at)
                    value, at = found[0], found.end()
            pairs.append((name, value))

    def _after(self, name: str, at: int) -> int:
        """Where raw text ends, after its closing tag."""
        over = re.compile(f"</{name}(?=[\\s/>])", re.I).search(self.source, at)
        if not over:
            return len(self.source)
        end = self.source.find(">", over.end())
        return len(self.source) if end < 0 else end + 1

    def _text(self, piece: str) -> None:
        self.buffer.append(piece)
        if self.inlines.get("a"):
            self.linked += len(piece.strip())

    def _read(self) -> None:
        source, at, size, find = self.source, 0, len(self.source), self.source.find
        head_ends = True
        while at < size:
            start = find("<", at)
            if start < 0:
                self._text(source[at:])
                break
            if start > at:
                self._text(source[at:start])
            mark = source[start + 1 : start + 2]
            if mark in ("!", "?"):
                if source.startswith("<!--", start):
                    end = start + 4 if source.startswith((">", "->"), start + 4) else find("-->", start + 4)
                else:
                    end = start
                end = find(">", end) if end >= 0 else -1
                at = size if end < 0 else end + 1
                continue
            closing = mark == "/"
            found = _OPEN.match(source, start + 1 + closing)
            if not found:
                if closing and start + 2 < size:  # not a tag, but not text either
                    end = find(">", start)
                    at = size if end < 0 else end + 1
                else:
                    self._text("<")
                    at = start + 1
                continue
            name, at = found[0].lower(), found.end()
            simple = _SIMPLE.match(source, at)
            if simple:
                attributes, at = simple[1], simple.end()
                words = _attribute_groups(attributes) if attributes and not closing else 0
            else:
                at, words = self._attributes(at)
                if at == size and source[-1] != ">":
                    break
            if closing:
                if name == "br":
                    self.buffer.append(" ")
                elif name in INLINE:
                    if self.inlines.get(name):
                        self.inlines[name] -= 1
                else:
                    self._close((name,))
            elif name in RAW:
                at = self._after(name, at)
            elif name == "head":
                if head_ends:
                    over = re.compile(r"</head(?=[\s/>])|<body(?=[\s/>])", re.I).search(source, at)
                    head_ends = bool(over)
                    if over:
                        at = over.start()
            else:
                self._element(name, words)
        self._flush()

    def _element(self, name: str, words: int) -> None:
        if name in ("br", "img", "wbr"):
            if name == "br":
                self.buffer.append(" ")
            return
        if name in INLINE:
            self.inlines[name] = self.inlines.get(name, 0) + 1
            if name == "a":
                self.links[self.stack[-1][0]] += 1
            return
        self._flush()
        if name in VOID:
            if name == "hr":
                self._close(("p",), ("td", "th", "button"))
            elif name == "input":
                self._add("button")
            return
        if name in CLOSES_P:
            self._close(("p",), ("td", "th", "button", "table"))
        if name in CLOSES_SAME:
            these, stop = CLOSES_SAME[name]
            self._close(tuple(these.split()), tuple(stop.split()))
        self.inlines.clear()
        self._open(name, words)


class Features:
    """The features of a page's nodes, one row per node, made in slices."""

    def __init__(self, page: Page):
        n = len(page.parent)
        parent = np.array(page.parent)
        tag = np.array([TAG_OF.get(t, OTHER) for t in page.tag])
        up = np.maximum(parent, 0)
        chars, linked, pauses = np.zeros(n), np.zeros(n), np.zeros(n)
        for node, text in page.blocks.items():
            chars[node], linked[node], pauses[node] = len(text), page.link_chars[node], len(_PAUSE.findall(text))
        own, links, leaves, tags = chars.copy(), np.array(page.links, float), (chars > 0).astype(float), np.ones(n)
        depth, above, tags_above, index, siblings = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        kinds: dict[tuple[int, str], int] = {}
        words, bits = page.words, (1 << tag).tolist()
        for k in range(1, n):
            p = page.parent[k]
            depth[k], above[k] = depth[p] + 1, above[p] | words[k]
            tags_above[k] = tags_above[p] | bits[k]
            index[k] = siblings[p]
            siblings[p] += 1
            key = (p, page.tag[k])
            kinds[key] = kinds.get(key, 0) + 1
        before = np.concatenate([[0.0], np.cumsum(own)[:-1]])
        for sums in (chars, linked, pauses, links, leaves, tags):
            listed = sums.tolist()
            for k in range(n - 1, 0, -1):
                listed[page.parent[k]] += listed[k]
            sums[:] = listed
        alike = np.array([kinds.get((page.parent[k], page.tag[k]), 1) for k in range(n)], float)
        depth, index, siblings = (np.array(x, float) for x in (depth, index, siblings))
        total, text = max(chars[0], 1), np.maximum(chars, 1)
        words = np.array(words)
        # a block counts as its element, so the tag of a block is that of its parent
        self.shown = np.where(tag == 0, tag[up], tag)
        self.near = np.where(tag == 0, words[up], words)
        self.above, self.tags_above = np.array(above), np.array(tags_above)
        self.numbers = [
            np.log1p(chars), linked / text, links / text * 100, tags / text * 100, pauses / text * 100, chars / np.maximum(leaves, 1),
            depth, index, siblings[up], index / np.maximum(siblings[up], 1), alike, siblings, chars / total, before / total,
            chars[up] / total, linked[up] / np.maximum(chars[up], 1), leaves, np.log1p(chars[up]), (tag == 0).astype(float),
        ]

    def __len__(self) -> int:
        return len(self.shown)

    def rows(self, low: int, high: int) -> np.ndarray:
        bits = lambda x, m: (x[low:high, None] >> np.arange(m) & 1).astype(float)
        groups = len(WORDS)
        numbers = np.stack([x[low:high] for x in self.numbers], axis=1)
        return np.concatenate([numbers, np.eye(OTHER + 1)[self.shown[low:high]], bits(self.near, groups), bits(self.above, groups), bits(self.tags_above, OTHER + 1)], axis=1)


def decode(parent: list[int], gain: np.ndarray) -> np.ndarray:
    """The best set of nodes that holds the parent of each of its nodes."""
    best = gain.copy()
    for k in range(len(parent) - 1, 0, -1):
        if best[k] > 0:
            best[parent[k]] += best[k]
    keep = np.zeros(len(parent), bool)
    keep[0] = True
    for k in range(1, len(parent)):
        keep[k] = keep[parent[k]] and best[k] > 0
    return keep


def _say(rng: random.Random, low: int, high: int) -> str:
    parts = "the er on an re ti in en st ou th ion al ar que de le und ge sch ver ado la es é ü ñ".split()
    out = []
    for _ in range(rng.randint(low, high)):
        sentence = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 16))]
        out.append((" ".join(w + rng.choice(["", "", "", "", ","]) for w in sentence)).capitalize().rstrip(",") + ".")
    return html.escape(" ".join(out), quote=False)


def _name(rng: random.Random, tag: str, group: int, chance: float = 0.85) -> str:
    """An opening tag with attribute words of a group, or with none."""
    noise = rng.choice(["", "", "c-", "js-", "x1 ", "wrapper ", "box-", "m_"])
    if rng.random() > chance:
        return f"<{tag}>" if rng.random() < 0.6 else f'<{tag} class="{rng.choice(["row", "col-8", "x9f", "wrap", "box"])}">'
    word = rng.choice(WORDS[group].split())
    return f'<{tag} {rng.choice(["class", "class", "id"])}="{noise}{word}{rng.choice(["", "-1", " clearfix", "-wrap", "Box"])}">'


def synthetic_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and its main blocks."""
    r, main = rng.random, []
    link = lambda: f'<a href="/{rng.randint(1, 999)}">{_say(rng, 1, 1)[: rng.randint(3, 24)]}</a>'
    some = lambda make, low, high: "".join(make() for _ in range(rng.randint(low, high)))

    def plain(tag: str, group: int, inside: str, sure: bool = False) -> str:
        """A section by its own tag, or a div that only its attributes tell."""
        if tag != "div" and r() < 0.6:
            return f"{_name(rng, tag, group, 0.3)}{inside}</{tag}>"
        return f"{_name(rng, rng.choice(['div', 'div', 'section']), group, 1.0 if sure else 0.92)}{inside}</div>"

    def menu() -> str:
        items = some(lambda: f"<li>{link()}</li>", 3, 9) if r() < 0.7 else some(lambda: link() + " ", 3, 9)
        return plain("nav", 1, f"<ul>{items}</ul>" if items.startswith("<li") else items)

    def advert() -> str:
        return plain("div", 5, f"<p>{_say(rng, 1, 3)}</p>" if r() < 0.4 else _say(rng, 1, 4) + (link() if r() < 0.4 else ""), True)

    def notice() -> str:
        return plain("div", 6, f"<p>{_say(rng, 1, 3)}</p>" * rng.randint(1, 2) + (f"<button>{_say(rng, 1, 1)[:8]}</button>" if r() < 0.6 else ""), True)

    def form() -> str:
        choice = f"<select>{some(lambda: f'<option>{_say(rng, 1, 1)[:12]}</option>', 2, 6)}</select>" if r() < 0.3 else ""
        inside = some(lambda: f"<label>{_say(rng, 1, 1)[:14]}</label><input name=x>", 1, 4) + choice + f"<button>{_say(rng, 1, 1)[:9]}</button>"
        return f"{_name(rng, 'form', 7, 0.5)}{f'<p>{_say(rng, 1, 2)}</p>' if r() < 0.5 else ''}{inside}</form>"

    def side() -> str:
        body = f"<h3>{_say(rng, 1, 1)[:20]}</h3>" + (f"<ul>{some(lambda: f'<li>{link()}</li>', 2, 7)}</ul>" if r() < 0.6 else some(lambda: f"<p>{_say(rng, 1, 3)}</p>", 1, 4))
        return plain("aside", 4, body, True)

    def comments() -> str:
        one = lambda: f"{rng.choice(['<div class=comment>', '<li>', '<article class=comment>', '<div>'])}<b>{_say(rng, 1, 1)[:10]}</b> {f'<p>{_say(rng, 1, 5)}</p>' if r() < 0.8 else _say(rng, 1, 4)}{rng.choice(['</div>', '</li>', '</article>'])}"
        close = rng.choice(["section", "div", "ol"])
        return f"{_name(rng, close, 8, 1.0)}<h2>{_say(rng, 1, 1)[:14]}</h2>{some(one, 1, 7)}</{close}>"

    def head() -> str:
        return plain("header", 2, rng.choice([f"<h1>{link()}</h1>", f"<div class=logo>{link()}</div>", f"<p>{_say(rng, 1, 1)}</p>", f"<span>{_say(rng, 1, 1)[:20]}</span>"]) + (menu() if r() < 0.5 else "") + (form() if r() < 0.2 else ""), True)

    def foot() -> str:
        return plain("footer", 3, rng.choice(["", "<p>"]) + f"&copy; {_say(rng, 1, 2)}" + (some(lambda: link() + " ", 0, 5)) + (menu() if r() < 0.2 else ""), True)

    def share() -> str:
        return plain("div", 9, some(lambda: link() + " ", 2, 5), True)

    def aside_of_text(text: str) -> str:
        """A paragraph with a formula, or a text that stands in for an object or a script."""
        words, k = text.split(" "), rng.randint(0, text.count(" "))
        kind = rng.choice(["math", "object", "noscript", "canvas"])
        words[k] = f"<{kind}>{'<mi>' + words[k] + '</mi>' if kind == 'math' else words[k]}</{kind}>"
        return " ".join(words)

    def block(kind: str) -> str:
        if kind == "list":
            said = [_say(rng, 1, 2) for _ in range(rng.randint(2, 6))]
            main.extend(said)
            return "<ul>" + "".join(f"<li>{x}{rng.choice(['</li>', ''])}" for x in said) + "</ul>"
        if kind == "table":
            said = [_say(rng, 1, 1) for _ in range(4)]
            main.extend(said)
            return f"<table><tr><td>{said[0]}</td><td>{said[1]}</td></tr><tr><td>{said[2]}<td>{said[3]}</table>"
        text = _say(rng, 1, 1) if kind[0] == "h" or r() < 0.25 else _say(rng, 1, 9)
        if kind[0] == "h" and r() < 0.5:
            text = text[: rng.randint(8, 60)].rstrip() if "&" not in text else text
        main.append(text)
        if r() < 0.04:
            text = aside_of_text(text)
        if kind == "p" and r() < 0.15:
            return f"<p><b>{text}<br>"
        return f"<{kind}>{text}" + ("" if kind == "p" and r() < 0.15 else f"</{kind}>")

    def story() -> str:
        out = [block("h1")] if r() < 0.85 else []
        if r() < 0.15:
            out.append(share())
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 12, 20])):
            out.append(block(rng.choices(["p", "h2", "list", "blockquote", "pre", "table", "div"], [14, 1, 1, 0.5, 0.3, 0.4, 0.6])[0]))
            if r() < 0.06:
                out.append(rng.choice([advert, notice, side, form, share])())
        tag, group = rng.choice([("article", 0), ("article", 0), ("main", 0), ("div", 0), ("section", 0)])
        inside = "\n".join(out) if r() < 0.5 else "".join(out)
        if r() < 0.15:
            inside += comments()
        return f"{_name(rng, tag, group, 0.4 if tag in ('article', 'main') else 0.95)}{inside}</{tag}>"

    if r() < 0.08:  # nothing but text, in a plain element or in none
        tag = rng.choice(["div", "p", "section", "article", "main", ""])
        inside = "".join(block(rng.choice(["p", "p", "div", "h2"])) for _ in range(rng.randint(1, 4))) if r() < 0.5 else ""
        if not inside:
            main.append(_say(rng, 1, 2)[: rng.randint(6, 200)].rpartition("&")[0] or "Short.")
            inside = main[-1]
        body = f"<{tag}>{inside}</{tag}>" if tag else inside
        return (f"<html><body>{body}</body></html>" if r() < 0.5 else body), [" ".join(html.unescape(x).split()) for x in main]
    parts = [rng.choice([menu, head])() if r() < 0.8 else ""]
    parts += [f() for f, p in ((notice, 0.3), (advert, 0.4), (menu, 0.2), (form, 0.1), (side, 0.15)) if r() < p]
    body = story()
    parts.append(f"<main>{body}</main>" if r() < 0.2 else f'<div class="{rng.choice(["container", "wrap", "page", "layout"])}">{body}{side() if r() < 0.4 else ""}</div>' if r() < 0.4 else body)
    parts += [f() for f, p in ((share, 0.15), (comments, 0.35), (side, 0.35), (advert, 0.25), (form, 0.2), (notice, 0.1)) if r() < p]
    parts.append(foot() if r() < 0.85 else "")
    clean = [" ".join(html.unescape(x).split()) for x in main]
    return f"<!DOCTYPE html><html><head><title>{_say(rng, 1, 1)}</title></head><body>{''.join(parts)}" + ("</body></html>" if r() < 0.9 else ""), clean


def _labelled(source: str, main: list[str]) -> tuple[np.ndarray, np.ndarray]:
    page = Page(source)
    left, y = list(main), np.zeros(len(page.parent))
    for node in sorted(page.blocks):  # in page order; equal texts are told apart by it
        if left and page.blocks[node] == left[0]:
            y[node] = 1
            left.pop(0)
    for k in range(len(page.parent) - 1, 0, -1):
        y[page.parent[k]] = max(y[page.parent[k]], y[k])
    known = Features(page)
    return known.rows(0, len(known)), y


#: Nodes whose features are held at a time.
NODES = 8192
PAGES = 1000
SEED = 11


@functools.lru_cache(1)
def model(pages: int = PAGES, seed: int = SEED) -> boosting.Trees:
    """The trees, trained on synthetic pages."""
    rng = random.Random(seed)
    rows = [_labelled(*synthetic_page(rng)) for _ in range(pages)]
    return boosting.fit(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))


def _scored(features: list[Features], trees: boosting.Trees) -> list[np.ndarray]:
    """Log odds of the nodes of some pages, scored together in slices of NODES."""
    cuts = np.cumsum([0, *map(len, features)])
    out, rows, held = [], [], 0
    for known in features:
        low = 0
        while low < len(known):
            high = min(len(known), low + NODES - held)
            rows.append(known.rows(low, high))
            held += high - low
            low = high
            if held == NODES:
                out.append(trees.margin(np.concatenate(rows)))
                rows, held = [], 0
    if rows:
        out.append(trees.margin(np.concatenate(rows)))
    margins = np.concatenate(out)
    return [margins[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def extract(sources: list[str | None], trees: boosting.Trees) -> list[str]:
    """Main texts of some pages; the nodes of small ones are scored together."""
    out, pages, nodes = [], [], 0

    def done() -> None:
        for page, margins in zip(pages, _scored([Features(p) for p in pages], trees), strict=True):
            keep = decode(page.parent, margins)
            out.append("\n".join(page.blocks[k] for k in sorted(page.blocks) if keep[k]))
        pages.clear()

    for source in sources:
        pages.append(Page(source or ""))
        nodes += len(pages[-1].parent)
        if nodes >= NODES:
            done()
            nodes = 0
    if pages:
        done()
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    trees = model()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series(extract(list(sources), trees), dtype="object")

    text = F.pandas_udf(run, "string")(F.coalesce(F.col("html").cast("string"), F.lit("")))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
