"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block-level tags from the root. For every path the characters and
the punctuation of all its blocks are added up and divided by the number of blocks: paragraphs share a path with much text
and punctuation for each block, menus and notices do not. The two ratios are fused by their product, smoothed over
neighbouring blocks with a Gaussian, and blocks above a threshold select their path. The content root is the deepest
element that holds all selected blocks, or the articles that hold them; all blocks below are the text, so headings, short
paragraphs, lists and tables of an article stay, and so do first headings beside it. Without an article, blocks that are
mostly links go if they stand before or after the selected blocks and outside the elements around these.

Elements that are no content by their kind (menus, headers, footers, scripts, ...) are left out before. So are forms, asides and
dialogs, and elements that say so in a role, class or id (adverts, notices, comments, ...), unless they hold half or more of the text
of the articles and main parts or, on a page that does not say where its content is, half of the text or more. Inside an article
every word of a class must say so: "related-work" is a section, "related-posts" is not. Boxes inside an article that hold no
selected block and mostly links are left out too. Graphics and controls inside a line do not end its block. White space inside
a block, line breaks included, becomes one space; blocks are joined by one line end. Nothing is cut or limited.

Defined cases: a null page is empty; a page without content has the text ""; unclosed and stray tags and comments are
read as a browser would roughly do; rows that repeat are pages of their own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import in_small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element of the kinds named.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Kinds of elements that are never content.
OUT = frozenset("head nav footer script style noscript template menu title".split())
#: The same within a line of text, which they do not end.
MUTED = frozenset("svg math button select input textarea iframe object canvas audio video".split())
#: Kinds that are no content unless they hold the article or most of the text.
SOFT = frozenset("form aside dialog".split())
#: Words that say nothing next to a hint.
NEUTRAL = frozenset(
    "box block container wrapper wrap inner outer list section area bar item items link links post posts button buttons slot unit "
    "content title text top bottom left right small large main js is has the and for of by".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id that mark what is not content.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies "
    "consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription sidebar "
    "widget widgets menu nav navbar navigation breadcrumb breadcrumbs toolbar masthead footer comment comments disqus reply "
    "replies respond share sharing social related recommended recommendations pagination pager login signup skip".split())
#: These count only outside an article.
OUTSIDE = frozenset({"header", "topbar"})
CONTENT = frozenset({"article", "main"})
#: Elements of the page itself, and parts of a text that never hold all of it alone.
SHELL = frozenset({"#root", "html", "body"})
PARTS = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption".split())
PUNCTUATION = frozenset(".,;:!?…。，、；：！？")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>", re.S)
_ATTR = re.compile(r"""(?P<name>[^\s=/"'<>]+)(?:\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s"'>]+)))?""", re.S)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SIGMA = 1.0
THRESHOLD = 0.5


class _Page:
    """Blocks of a page and the elements they stand in."""

    def __init__(self):
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [0]
        self.paths: list[int] = [0]
        self.hints: list[int] = [0]
        self.dead: list[bool] = [False]
        self.known: dict[tuple[int, str], int] = {}
        self.text: list[str] = []
        self.where: list[int] = []
        self.links: list[int] = []
        self.stack = [0]
        self.open: dict[str, int] = {}
        self.buffer: list[str] = []
        self.linked = 0
        self.mute: int | None = None  # place in the stack of the first open element of a muted kind

    def read(self, source: str) -> _Page:
        at = 0
        while True:
            m = _TAG.search(source, at)
            if not m:
                self.say(source[at:])
                break
            self.say(source[at:m.start()])
            at = m.end()
            if m["end"]:
                self.close(m["end"].lower())
            elif m["tag"]:
                tag = m["tag"].lower()
                self.start(tag, m["attrs"])
                if tag in RAW:
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
                    at = stop.end()
                    self.close(tag)
        self.flush()
        return self

    def say(self, text: str) -> None:
        if text and self.mute is None:
            self.buffer.append(text)
            if self.open.get("a"):
                self.linked += len(text.strip())

    def flush(self) -> None:
        if self.buffer:
            text = _SPACE.sub(" ", html.unescape("".join(self.buffer))).strip()
            if text:
                where = self.stack[-1]
                while self.tags[where] in INLINE:
                    where = self.parents[where]
                self.text.append(text)
                self.where.append(where)
                self.links.append(self.linked)
            self.buffer.clear()
        self.linked = 0

    def start(self, tag: str, attrs: str) -> None:
        if self.mute is None and tag not in INLINE and tag not in MUTED:
            self.flush()
            ends = ENDS.get(tag, ())
            for i in range(len(self.stack) - 1, 0, -1):
                kind = self.tags[self.stack[i]]
                if kind == "p" or kind in ends:
                    self.cut(i)
                    if kind == "p":
                        break
                elif kind not in INLINE:
                    break
        elif tag in ("br", "wbr"):
            if tag == "br" and self.mute is None:
                self.buffer.append(" ")
            return
        if tag in VOID:
            return
        parent = self.stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        path = self.paths[parent]
        self.paths.append(path if tag in INLINE else self.known.setdefault((path, tag), len(self.known) + 1))
        gone, hint = self.judge(tag, attrs)
        self.dead.append(self.dead[parent] or gone)
        self.hints.append(hint)
        if tag in MUTED and self.mute is None:
            self.mute = len(self.stack)
        self.stack.append(len(self.tags) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1

    def judge(self, tag: str, attrs: str) -> tuple[bool, int]:
        """(out by kind, out unless it holds the article: 1 by its own words, 2 by its kind or role)."""
        inside = any(self.open.get(c) for c in CONTENT)
        if tag in OUT or tag in MUTED:
            return True, 0
        soft = tag in SOFT or tag in OUTSIDE and not inside
        if not attrs.strip():
            return False, 2 * soft
        hinted = False
        for m in _ATTR.finditer(attrs):
            name, value = m["name"].lower(), m["a"] or m["b"] or m["c"] or ""
            if name == "role" and value.lower() in ROLES:
                soft = True
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hinted = True
            if name in ("class", "id"):
                for token in html.unescape(value).split():
                    words = {w.lower() for w in _PARTS.findall(token)}
                    says = words & HINTS or not inside and words & OUTSIDE
                    hinted = hinted or bool(says) and (not inside or words <= HINTS | NEUTRAL)
        return False, 2 if soft else int(hinted)

    def cut(self, i: int) -> None:
        for e in self.stack[i:]:
            self.open[self.tags[e]] -= 1
        del self.stack[i:]
        if self.mute is not None and i <= self.mute:
            self.mute = None

    def close(self, tag: str) -> None:
        if not self.open.get(tag):
            if tag not in INLINE and self.mute is None:
                self.flush()
            return
        i = len(self.stack) - 1
        while self.tags[self.stack[i]] != tag:
            i -= 1
        if self.mute is not None:
            if i >= self.mute:
                self.cut(i)
                return
            self.cut(self.mute)
        if tag not in INLINE:
            self.flush()
        self.cut(i)


def _alive(page: _Page) -> list[bool]:
    """Elements that may hold content.

    Hints count unless the element holds half of what articles and main parts hold, or the first heading, or, where no article
    or section of a first heading says what the content is, half of the text. A first heading does not save forms and their like.
    """
    n = len(page.tags)
    out, weight = list(page.dead), [0] * n
    for text, e, links in zip(page.text, page.where, page.links):
        if not out[e]:
            weight[e] += max(0, len(text) - links)
    heading = [t == "h1" for t in page.tags]
    for e in range(n - 1, 0, -1):
        weight[page.parents[e]] += weight[e]
        if heading[e] and not out[e]:
            heading[page.parents[e]] = True
    # Articles that are marked as something else, as comments are, count only if there are no others.
    marked = [e for e in range(1, n) if page.tags[e] in CONTENT and not out[e]]
    plain = [e for e in marked if not page.hints[e] and weight[e]] or marked
    content, total = [0] * n, 0
    for e in plain:
        up = page.parents[e]
        while up and not (page.tags[up] in CONTENT and up in plain):
            up = page.parents[up]
        content[e] = 0 if up else weight[e]
        total += content[e]
    holds = list(content)
    for e in range(n - 1, 0, -1):
        holds[page.parents[e]] += holds[e]
    told = any(
        not o and (t in CONTENT or t == "h1" and page.tags[up] not in SHELL and 5 * weight[up] >= weight[0])
        for t, o, up in zip(page.tags, out, page.parents))
    alive = [True] * n
    for e in range(1, n):
        much = not told and 0 < weight[0] <= 2 * weight[e]
        kept = not page.hints[e] or much or total and 2 * holds[e] >= total or page.hints[e] == 1 and heading[e]
        alive[e] = bool(alive[page.parents[e]] and not out[e] and kept)
    return alive


def _smooth(x: np.ndarray) -> np.ndarray:
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel)[reach:reach + len(x)]
    return np.convolve(x, kernel)[reach:reach + len(x)] / weight


def extract(source: str | None) -> str:
    """The main text of a page."""
    if not source:
        return ""
    page = _Page().read(source)
    alive = _alive(page)
    blocks = [i for i, e in enumerate(page.where) if alive[e]]
    if not blocks:
        return ""
    path = np.array([page.paths[page.where[i]] for i in blocks])
    chars = np.array([max(0, len(page.text[i]) - page.links[i]) for i in blocks], float)
    marks = np.array([sum(map(page.text[i].count, PUNCTUATION)) for i in blocks], float)
    _, which = np.unique(path, return_inverse=True)
    count = np.bincount(which)
    text_ratio = (np.bincount(which, chars) / count)[which]
    mark_ratio = (np.bincount(which, marks) / count)[which]
    fused = _smooth(text_ratio * (1.0 + mark_ratio))
    bar = min(THRESHOLD * float(fused.std()), float(fused.max()))
    voted = np.bincount(which, (fused >= bar) * chars) >= 0.5 * np.maximum(np.bincount(which, chars), 1.0)
    chosen = voted[which]
    roots, article = _roots(page, [page.where[i] for i in blocks], chars * chosen, chosen)
    inside, heading, home = [False] * len(page.tags), [False] * len(page.tags), [False] * len(page.tags)
    for i, c in zip(blocks, chosen):
        if c:
            home[_section(page, page.where[i])] = True
    for e, tag in enumerate(page.tags):
        up = page.parents[e]
        inside[e] = e in roots or e > 0 and inside[up]
        heading[e] = tag == "h1" or e > 0 and heading[up]
        home[e] = home[e] and tag not in SHELL or e > 0 and home[up]
    boxes = _link_boxes(page, [page.where[i] for i in blocks], chars, np.array([page.links[i] for i in blocks]), chosen, roots) if article else set()
    picked, kept = np.flatnonzero(chosen), []
    for k, i in enumerate(blocks):
        e, linked = page.where[i], 2 * page.links[i] > len(page.text[i])
        near = home[e] or len(picked) > 0 and picked[0] <= k <= picked[-1]
        if inside[e] and _section(page, e) not in boxes and (article or near or not linked) or heading[e] and not article and not linked:
            kept.append(page.text[i])
    return "\n".join(kept)


def _section(page: _Page, e: int) -> int:
    """The element itself or, for a paragraph or a part of a list or table, the nearest other one around it."""
    while e and page.tags[e] in PARTS:
        e = page.parents[e]
    return e


def _link_boxes(page: _Page, elements: list[int], chars: np.ndarray, links: np.ndarray, chosen: np.ndarray, roots: set[int]) -> set[int]:
    """Elements below the roots that hold no selected block and more of links than of other text."""
    n = len(page.tags)
    plain, linked, any_chosen = [0.0] * n, [0.0] * n, [False] * n
    for e, c, l, picked in zip(elements, chars.tolist(), links.tolist(), chosen.tolist()):
        plain[e] += c
        linked[e] += l
        any_chosen[e] |= picked
    for e in range(n - 1, 0, -1):
        up = page.parents[e]
        plain[up] += plain[e]
        linked[up] += linked[e]
        any_chosen[up] |= any_chosen[e]
    found: set[int] = set()
    for e in range(1, n):
        up = page.parents[e]
        if up in found or page.tags[e] not in PARTS and page.tags[e] not in INLINE and e not in roots and not any_chosen[e] and linked[e] > plain[e]:
            found.add(e)
    return found - roots


def _roots(page: _Page, elements: list[int], chars: np.ndarray, chosen: np.ndarray) -> tuple[set[int], bool]:
    """(elements whose blocks are the text, whether these are articles or main parts).

    Articles and main parts that hold selected blocks are the text if they hold half of it or more; else it is what stands
    in the lowest common ancestor of the selected blocks.
    """
    content = [0] * len(page.tags)
    for e in range(1, len(page.tags)):
        content[e] = content[page.parents[e]] or (e if page.tags[e] in CONTENT else 0)
    marked = np.array([content[e] > 0 for e in elements])
    if marked.any() and 2 * chars[marked].sum() >= chars.sum():
        return {content[e] for e, c in zip(elements, chosen) if content[e] and (c or not chosen.any())}, True
    picked = [e for e, c in zip(elements, chosen) if c]
    if not picked:
        return {0}, False
    low = picked[0]
    for e in picked[1:]:
        while low != e:  # of two elements the later one is never above the other
            low, e = (page.parents[low], e) if low > e else (low, page.parents[e])
    return {_section(page, low)}, False


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with a column ``text`` instead of one of that name."""
    @F.pandas_udf("string")
    def run(sources: pd.Series) -> pd.Series:
        return pd.Series([extract(s) for s in sources], dtype=object)

    return in_small_batches(pages).withColumn("text", run(F.col(html_col)))


def texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars)."""
    out = main_text(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


