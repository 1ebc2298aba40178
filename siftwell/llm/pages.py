"""Main text of web pages by two-pass block rules.

First pass: each block of text is decided alone by its stop-word density, length and link density. Blocks of many
stop words are good, those mostly of links are bad. On a page whose language the stop words aren't of, length and
sentences decide. What lies in elements whose tag, role, class or id names them as something else than the text (menus,
adverts, forms, comments) isn't a block at all; if some article of the page isn't bad, neither is what lies outside.

Second pass: short blocks, on which those figures say nothing, take the label of the nearest decided block of their
container, or of the innermost container around it that has one; long blocks of few stop words only that of their own
container, else they are bad.

A page is gone through once, in time linear in its length, whatever is left unclosed.
"""

from __future__ import annotations

import functools
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters below which a block is short, and from which a block of many stop words is good.
SHORT, LONG = 70, 200
#: Share of characters in links above which a block is bad, and shares of stop words. A page of less than the low share
#: is in a language of which the stop words aren't known.
LINKS, LOW_STOPS, HIGH_STOPS = 0.33, 0.12, 0.2

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in
into is it its just like more most my no not of on one only or other our out over she so some such than that the their
them then there these they this to up was we were what when which who will with would you your
au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me mes ne nous on ou par
pas plus pour qu que qui sa se ses si son sont sur te tu un une vous y
aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im
ist ja kann mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wie wir wird zu zum zur über
al como con del el ella entre era esta este fue ha hay las lo los mi muy nos o para pero por sin sobre su sus también
tiene todo una uno ya
""".split()
)

_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
# A quote counts only after an equals sign, and only if it is closed.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?…。！？।؟]\W*(?:\s|\Z)")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html head hr label legend li main menu nav ol optgroup
    option p pre search section select summary table tbody td tfoot th thead tr ul""".split()
)
#: Blocks that aren't containers of others, or only of parts of one.
_LEAVES = frozenset("address blockquote body caption center dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup hr html legend li option p pre summary tbody td tfoot th thead tr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_OTHER_TAGS = frozenset("aside button dialog fieldset footer form head menu nav search select option canvas svg math object audio video map".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
_OTHER_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc
    sidebar aside widget widgets related recommended recommendations teaser teasers
    header masthead topbar footer foot colophon copyright
    comment comments commentlist disqus reply replies respond
    cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer
    newsletter subscribe subscription signup login search share sharing social follow form""".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _other(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element isn't part of the text. A header within an article may hold its heading, which may be so named."""
    if tag in _OTHER_TAGS or tag == "header" and not inside:
        return True
    if not attrs:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _OTHER_ROLES:
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif name in ("class", "id") and tag not in ("body", "html"):
            words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", a or b or c).lower()))
            if words & _OTHER_WORDS and not (words & _OTHER_WORDS <= {"header"} and (tag in _HEADINGS or inside and tag == "header")):
                return True
    return False


def _pieces(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text, tag, whether it ends one, attributes) in turn; the tag is empty after a comment and at the end."""
    begin = at = 0
    tag = _TAG
    while (i := page.find("<", at)) >= 0:
        first, second = page[i + 1 : i + 2], page[i + 2 : i + 3]
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            yield page[begin:i], "", False, ""
            begin = at = j + 3 if j >= 0 else len(page)
        elif first in ("!", "?") or first == "/" and not _letter(second):
            j = page.find(">", i)
            if j < 0:
                break
            yield page[begin:i], "", False, ""
            begin = at = j + 1
        elif _letter(first) or first == "/":
            m = tag.match(page, i)
            if not m:  # each tag's end is among quotes, or there is none: from here on quotes are letters like any
                tag = _PLAIN_TAG
                m = tag.match(page, i)
            if not m:
                break
            name = m[2].lower()
            yield page[begin:i], name, bool(m[1]), m[3]
            begin = at = m.end()
            if name in _RAW and not m[1]:
                end = _end_of(name).search(page, at)
                j = page.find(">", end.end()) if end else -1
                begin = at = j + 1 if j >= 0 else len(page)
        else:
            at = i + 1
    yield page[begin:], "", False, ""


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


@functools.cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


class _Block(NamedTuple):
    text: str
    linked: int  # characters in links
    article: int  # its number, or 0
    container: int


class _Blocks:
    """The blocks of a page outside of what isn't its text, and its containers: parent, first block, end."""

    def __init__(self, page: str) -> None:
        self.out: list[_Block] = []
        self.containers: list[list[int]] = [[-1, 0, 0]]
        self.parts: list[str] = []
        self.linked = 0
        self.stack: list[tuple[str, bool, bool]] = []  # tag, whether it isn't text, whether it is a container
        self.open: Counter[str] = Counter()
        self.inside = [0]
        self.skips = self.link = self.article = self.articles = self.breaks = self.heads = 0
        for text, tag, end, attrs in _pieces(page):
            if text:
                self._text(text)
            if tag:
                self._tag(tag, end, attrs)
        self._flush()
        while self.stack:
            self._pop()
        self.containers[0][2] = len(self.out)

    def _text(self, raw: str) -> None:
        if self.skips:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if not text.isspace():
            self.breaks = 0
        if self.link:
            self.linked += len(text)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append(_Block(text, self.linked, self.article, self.inside[-1]))
        self.parts, self.linked, self.breaks = [], 0, 0

    def _push(self, tag: str, other: bool) -> None:
        box = tag in _BLOCKS and tag not in _LEAVES
        self.stack.append((tag, other, box))
        self.open[tag] += 1
        self.skips += other
        self.heads += other and tag in ("nav", "header")
        if box:
            self.containers.append([self.inside[-1], len(self.out), 0])
            self.inside.append(len(self.containers) - 1)

    def _pop(self) -> None:
        tag, other, box = self.stack.pop()
        self.open[tag] -= 1
        self.skips -= other
        self.heads -= other and tag in ("nav", "header")
        if box:
            self.containers[self.inside.pop()][2] = len(self.out)
        if tag in ("article", "main") and not self.open["article"] + self.open["main"]:
            self.article = 0

    def _tag(self, tag: str, end: bool, attrs: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            self.breaks += 1
            if self.breaks > 1 and not self.skips:
                self._flush()
            return
        if tag == "a":
            self.link = 0 if end else 1
            return
        block = tag in _BLOCKS
        if block:
            self._flush()
            self.link = 0
        if tag in _VOID:
            return
        if end:
            if self.open[tag]:
                while self.stack[-1][0] != tag:
                    self._pop()
                self._pop()
            return
        other = _other(tag, attrs, self.article > 0)
        if not block and not other:
            return
        if block:
            while self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] in _CLOSES.get(tag, ())):
                self._pop()
        if tag in ("article", "main") and not other:
            while self.skips and self.heads:  # never closed
                self._pop()
            if not self.article and not self.skips:
                self.articles += 1
                self.article = self.articles
        if attrs.endswith("/") and not block:
            return
        self._push(tag, other)


GOOD, BAD, THIN, SHORT_ONE = "good", "bad", "thin", "short"


def _stops(text: str) -> tuple[int, int]:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _decided(b: _Block, stops: float, known: bool) -> str:
    """The first pass: good, bad, thin (long, but of few stop words) or short (ambiguous), by the block alone."""
    n = len(b.text)
    if b.linked > LINKS * n or "©" in b.text and n < LONG and not b.article:
        return BAD
    if n < SHORT:
        return SHORT_ONE
    if not known:
        return GOOD if n >= LONG or _SENTENCE.search(b.text) else SHORT_ONE
    if stops >= (LOW_STOPS if n >= LONG else HIGH_STOPS):
        return GOOD
    return SHORT_ONE if stops >= LOW_STOPS else THIN


def _labelled(blocks: list[_Block], containers: list[list[int]], labels: list[str], at: list[int]) -> list[bool]:
    """The second pass: ``at`` are the blocks that take part, ``labels`` theirs; which of them are text."""
    if GOOD not in labels:
        labels = [GOOD if x == THIN or x == SHORT_ONE and len(blocks[i].text) >= SHORT else x for x, i in zip(labels, at, strict=True)]
    place = [i for i, x in zip(at, labels, strict=True) if x in (GOOD, BAD)]
    good = {i for i, x in zip(at, labels, strict=True) if x == GOOD}
    has = [bisect_left(place, end) > bisect_left(place, first) for _, first, end in containers]
    up: list[int] = []
    for c, (parent, _, _) in enumerate(containers):
        up.append(c if has[c] else up[parent] if parent >= 0 else -1)
    out = []
    for i, label in zip(at, labels, strict=True):
        c = blocks[i].container
        c = up[c] if label == SHORT_ONE or has[c] else -1
        if label in (GOOD, BAD):
            out.append(label == GOOD)
        elif c < 0:
            out.append(label == SHORT_ONE)
        else:
            k = bisect_left(place, i)
            near = [j for j in place[max(0, k - 1) : k + 1] if containers[c][1] <= j < containers[c][2]]
            least = min(abs(i - j) for j in near)
            out.append(any(j in good for j in near if abs(i - j) == least))
    return out


def main_text(page: str | None) -> str:
    """The page's text, one block a line; empty for a null or empty page and for one of no text."""
    found = _Blocks(page or "")
    blocks = found.out
    stops = [_stops(b.text) for b in blocks]
    plain = [s for s, b in zip(stops, blocks, strict=True) if b.linked <= LINKS * len(b.text)]
    known = sum(s for s, _ in plain) >= LOW_STOPS * max(1, sum(n for _, n in plain))
    labels = [_decided(b, s / max(1, n), known) for b, (s, n) in zip(blocks, stops, strict=True)]
    at = [i for i, b in enumerate(blocks) if b.article]
    if all(labels[i] == BAD for i in at):
        at = list(range(len(blocks)))
    kept = _labelled(blocks, found.containers, [labels[i] for i in at], at)
    return "\n".join(blocks[i].text for i, good in zip(at, kept, strict=True) if good)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` with ``text`` (the main text) and ``n_chars`` (its code points) of each row's whole page.

    A null page is empty and gives an empty text. Markup that is never closed, repeated rows, null keys, very long
    pages and empty tables pass. Other columns are dropped; one named text or n_chars among ``keep`` is a ValueError.
    """
    if {"text", "n_chars"} & set(keep):
        raise ValueError("text and n_chars are the result's own columns")

    def f(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kept = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("_html"))
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(f, f"{fields}, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
