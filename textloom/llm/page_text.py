"""Main text of raw web pages, by paths on which the pages of a host agree.

1. Each page is read as a light tree of its block elements. Menus, headers, footers, asides,
   forms, scripts, styles, adverts, notices and reader comments are left out, by tag or by a
   word of their class or id. Of the other containers, the deepest that still holds nearly all
   text outside links is found; the nearest article around it, else the nearest main element, else
   it itself is the page's best. Its path of generalised tags and classes is the vote. What lies beside
   a best container (less than a tenth of the text, or links) is not part of the article.
2. Spark sums the votes per host and path, before and after the shuffle, and each host's
   winner is the path with most pages.
3. Every page is read again and gives the text below its host's path. A page without
   that path, or with little of its text there, gives the text of its own best container.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by line feeds in page order. Null or empty html gives an empty text. A null url is a
host of its own name, the empty one. Rows that repeat a page_id are returned each; other
columns are ignored. Tags that are not closed end with their parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.scratch import settle

HOLD = 0.9  # share of the text that the best container must hold
AGREE = 0.3  # share of the page's best text that the host's path must give
BROADCAST_HOSTS = 100_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|math|select|object|title|button)\b(?>[^>\"']+|\"[^\"]{0,65536}\"|'[^']{0,65536}')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-z][^\s/>]*)((?>[^>\"']+|\"[^\"]{0,65536}\"|'[^']{0,65536}')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\shidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

CONTAINERS = frozenset(
    "html body main article section div center table tbody tr td th ul ol dl figure details fieldset form nav header footer "
    "aside dialog menu hgroup search".split()
)
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote address figcaption caption summary hr br option legend thead tfoot".split())
LEFT_OUT = frozenset("nav header footer aside form dialog menu search head fieldset".split())
KEPT = frozenset("html body main article".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets related "
    "recommended recommendations share sharing social comment comments respond replies disqus newsletter subscribe signup login search "
    "form pagination pager toolbar tags toc skip complementary contentinfo dialog".split()
)
NEUTRAL_WORDS = frozenset("with has no without".split())


def _names(attributes: str) -> tuple[str, list[str]]:
    """The classes, generalised, and all words of class, id and role."""
    classes, words = "", []
    for m in NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        words += value.split()
        if m[1].lower() == "class":
            classes = ".".join(sorted(re.sub(r"\d+", "#", c) for c in value.split()))
    return classes, words


def left_out(tag: str, attributes: str, words: list[str]) -> bool:
    if tag in LEFT_OUT:
        return True
    if tag in KEPT or not attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    for w in words:
        parts = re.split(r"[-_]+", w)
        if (parts[0] in LEFT_OUT_WORDS or parts[-1] in LEFT_OUT_WORDS) and not NEUTRAL_WORDS.intersection(parts):
            return True
    return False


class Page:
    """Containers with paths and weights, and text blocks in page order."""

    def __init__(self, html: str):
        self.parents, self.paths, self.weights = [-1], [""], [0]
        self.blocks: list[tuple[int, str]] = []
        self._open = [("", 0, False)]  # tag, container, left out
        self._text: list[str] = []
        self._linked, self._in_link = 0, False
        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self._say(html[at : m.start()])
            at = m.end()
            tag = (m[3] or m[6] or "").lower()
            if tag:
                if m[2] or m[5]:
                    self._end(tag)
                else:
                    self._begin(tag, m[4] or m[7] or "")
        self._say(html[at:])
        self._break()
        for i in range(len(self.parents) - 1, 0, -1):
            self.weights[self.parents[i]] += self.weights[i]

    def _say(self, raw: str) -> None:
        if raw and not self._open[-1][2]:
            text = unescape(raw) if "&" in raw else raw
            self._text.append(text)
            if self._in_link:
                self._linked += len(text)

    def _break(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                place = self._open[-1][1]
                self.blocks.append((place, text))
                self.weights[place] += max(len(text) - self._linked, 0)
            self._text = []
        self._linked = 0

    def _begin(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self._in_link = True
        elif tag in BLOCKS:
            self._break()
            self._in_link = False
            _, words = _names(attributes) if attributes else ("", [])
            if tag not in ("br", "hr"):
                while len(self._open) > 1 and self._open[-1][0] in BLOCKS and (tag != "p" or self._open[-1][0] == "p"):
                    self._open.pop()
                _, place, out = self._open[-1]
                self._open.append((tag, place, out or left_out(tag, attributes, words)))
        elif tag in CONTAINERS or tag == "head":
            self._break()
            self._in_link = False
            while len(self._open) > 1 and self._open[-1][0] == "p":
                self._open.pop()
            _, place, out = self._open[-1]
            classes, words = _names(attributes) if attributes else ("", [])
            self.parents.append(place)
            self.paths.append(f"{self.paths[place]}/{tag}" + (f".{classes}" if classes else ""))
            self.weights.append(0)
            self._open.append((tag, len(self.parents) - 1, out or left_out(tag, attributes, words)))
        elif attributes and left_out(tag, attributes, _names(attributes)[1]):
            _, place, out = self._open[-1]
            self._say(" ")
            self._open.append((tag, place, True))

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._in_link = False
            return
        if tag in BLOCKS or tag in CONTAINERS or tag == "head":
            self._break()
            self._in_link = False
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == tag:
                if tag not in BLOCKS or all(t not in CONTAINERS for t, _, _ in self._open[k:]):
                    del self._open[k:]
                return
            if self._open[k][0] in CONTAINERS and tag not in CONTAINERS and tag != "head":
                return

    def best(self) -> int:
        """The article or main element around the deepest container with nearly all text, or else that container."""
        at = self._deepest()
        for tag in ("article", "main"):
            up = at
            while up >= 0 and self.paths[up].rsplit("/", 1)[-1].split(".", 1)[0] != tag:
                up = self.parents[up]
            if up >= 0:
                return up
        return at

    def _deepest(self) -> int:
        at, children = 0, {}
        for i, p in enumerate(self.parents[1:], 1):
            children.setdefault(p, []).append(i)
        while True:
            heavy = [c for c in children.get(at, []) if self.weights[c] >= HOLD * self.weights[0] and self.weights[c]]
            if not heavy:
                return at
            at = heavy[0]

    def below(self, roots: set[int]) -> tuple[str, int]:
        """Text below some containers, and their weight."""
        inside = [i in roots for i in range(len(self.parents))]
        weight = 0
        for i in range(1, len(self.parents)):
            if inside[i] and not inside[self.parents[i]]:
                weight += self.weights[i]
            inside[i] = inside[i] or inside[self.parents[i]]
        if inside[0]:
            inside, weight = [True] * len(inside), self.weights[0]
        return "\n".join(t for place, t in self.blocks if inside[place]), weight


def main_text(html: str, path: str | None) -> str:
    page = Page(html)
    own = page.best()
    if path is not None:
        text, weight = page.below({i for i, p in enumerate(page.paths) if p == path})
        if weight and weight >= AGREE * page.weights[own]:
            return text
    return page.below({own})[0]


def host_of(url):
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container path with most pages of each host."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], list[int]] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = Page(html or "")
                best = page.best()
                if page.weights[best]:
                    c = counts.setdefault((host, page.paths[best]), [0, 0])
                    c[0] += 1
                    c[1] += page.weights[best]
            rows = [(h, p, n, w) for (h, p), (n, w) in counts.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))],
                ["host", "path", "pages", "weight"],
            )

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, pages long, weight long")
    votes = votes.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.sum("weight").alias("weight"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("pages", "weight", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    winners = settle(host_paths(pages), "paths")
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(winners, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    out = rows.select("page_id", "url", "html", "path").mapInArrow(read, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
