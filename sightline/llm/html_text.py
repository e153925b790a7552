"""Main text of web pages by rules on single elements and removal of site templates.

Each page is read by a small tolerant scan into blocks of text and the elements around them (end tags that HTML implies are
supplied, raw text elements skipped). Elements that are never article text are left out with all they hold: by tag
(``DROPPED``) or by a name in class, id or role whose words are all of ``BOILERPLATE`` and ``PLACES``, at least one of the former; so
has-sidebar or entry-header name no such element. A name of ``COMMENTS`` always removes, whatever the element is and holds. Any other
leaves article and main, and an element that holds all articles and mains of the page. A form, and an element with a name of ``LAYOUT`` alone, also
stays if it holds all top headings and more than half of the text outside of links; of a form that stays, the controls
go. Sidebars, notices and adverts get no such grace, however long they are. If the page marks its article (``article``,
``main``, role main), only text within counts, else blocks that are mostly links go too.

*Templates.* The subtree of every remaining block-level element is hashed (tag and texts). Spark counts per host on how many
different pages each subtree occurs; pages with the same main text count once, so that copies of an article do not make it
a template. Subtrees on at least ``PAGES`` such pages and the share ``SHARE`` of the host's are deleted in a second scan. The
hashes of a host are few by definition (at most 1 / SHARE times those of an average page); all together they are broadcast
if there are at most ``BROADCAST``, and joined by shuffle beyond that.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by a line feed
in page order; nothing is cut or capped. Defined results: null html gives an empty text, null or broken URLs are one host;
text outside of any element is a block; an unclosed element ends with its parent; a tag whose end or whose quoted value is
missing takes the rest of the page, as in browsers; repeated pages give equal results; an
empty table gives no rows; other columns are not read. A page takes time in proportion to its length.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import columns_of
from sightline.session import cut

PAGES = 8
SHARE = 0.5
BROADCAST = 1_000_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math xmp".split())
DROPPED = RAW | frozenset("nav footer aside dialog menu button select label datalist legend output head object canvas audio video".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Words of class, id or role that mark an element as no part of the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert"
    " popup modal overlay newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs"
    " pagination pager header masthead footer comment comments commentlist respond reply replies disqus discussion share sharing social related"
    " recommended widget widgets toolbar login search copyright complementary contentinfo".split()
)
#: Words that may stand beside them in a name.
PLACES = frozenset(
    "area bar block body bottom box btn button buttons container content count form global group icon icons inner item items left link links list"
    " page panel posts right row section site slot text title top unit wrap wrapper".split()
)
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
#: Words of names that layouts also give to what holds the article.
LAYOUT = frozenset("widget banner header masthead social share sharing toolbar toolbars".split())
_KEPT = frozenset(("html", "body", "main"))
_VALUE = r"""=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?"""
_TAG = re.compile(rf"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|{_VALUE})*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_MAIN = re.compile(r"""(?:^|[\s"'])role\s*=\s*["']?main\b""", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true)""", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _named(tag: str, attributes: str) -> frozenset[str]:
    """The words of names that mark the element as no part of the article."""
    out: set[str] = set()
    if attributes and tag not in _KEPT:
        for value in _NAMES.findall(attributes):
            for name in value.lower().strip("\"'").split():
                found = set(_WORD.findall(name))
                if not found <= PLACES and found <= BOILERPLATE | PLACES:
                    out |= found - PLACES
    return frozenset(out if tag != "article" else out & COMMENTS)


class _Held(NamedTuple):
    """What an element, or the page, holds: text outside of links, marked articles, top headings; comments left out."""

    chars: int
    mains: int
    heads: int


def _hidden(tag: str, attributes: str) -> bool:
    return bool(attributes) and tag not in _KEPT and bool(_HIDDEN.search(attributes))


class _Page:
    """Blocks of a page in order, and the block range of every element that holds any."""

    def __init__(self, source: str, spared: frozenset[int] | None = frozenset()) -> None:
        """``spared``: which of the named elements, by number, stay; all of them if it is None."""
        self.blocks: list[str] = []
        self.elements: list[tuple[str, int, int]] = []
        self._marked: list[bool] = []  # block within article or main
        self._links: list[float] = []
        self._text: list[str] = []
        self._linked = 0
        self._stack: list[tuple[str, int, bool]] = []  # tag, first block, dropped
        self._dropped = self._articles = self._anchors = 0
        self._spared = spared
        self._held = _Held(0, 0, 0)
        self._comments = 0
        self._open_tags: Counter[str] = Counter()
        self._open_names: list[tuple[int, int, bool, _Held]] = []  # depth, number, whether of comments, what the page held before
        self._names = 0
        self.holds: list[tuple[int, bool, _Held]] = []  # number, whether layout only, and what it holds, of each named element
        self._layout: dict[int, bool] = {}
        self._scan(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(references.unescape("".join(self._text)).split())
            if text:
                self.blocks.append(text)
                self._marked.append(self._articles > 0)
                self._links.append(self._linked / max(len("".join(self._text)), 1))
            self._text.clear()
        self._linked = 0

    def _add(self, text: str) -> None:
        if text and not self._dropped:
            self._text.append(text)
            if self._anchors:
                self._linked += len(text)
            else:
                self._hold(chars=len("".join(text.split())))

    def _hold(self, chars: int = 0, mains: int = 0, heads: int = 0) -> None:
        if not self._comments and not self._dropped:
            held = self._held
            self._held = _Held(held.chars + chars, held.mains + mains, held.heads + heads)

    def _pop(self) -> None:
        tag, first, dropped = self._stack.pop()
        self._open_tags[tag] -= 1
        if self._open_names and self._open_names[-1][0] == len(self._stack):
            _, number, comments, before = self._open_names.pop()
            self._comments -= comments
            if not comments:
                self.holds.append((number, self._layout[number], _Held(*(a - b for a, b in zip(self._held, before, strict=True)))))
        if tag not in INLINE:
            self._flush()
        self._dropped -= dropped
        if tag in ("article", "main", "main!"):
            self._articles -= 1
        elif tag == "a":
            self._anchors -= 1
        if tag not in INLINE and len(self.blocks) > first:
            self.elements.append((tag, first, len(self.blocks)))

    def _close(self, names: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Ends the innermost element of ``names`` that is open, unless one of ``within`` is nearer."""
        if not any(self._open_tags[n] for n in names):
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in names:
                while len(self._stack) > k:
                    self._pop()
                return
            if self._stack[k][0] in within:
                return

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._add(" ")
        if tag not in INLINE:
            self._close(("p",), ("button", "table", "object", "div", "section", "article", "td", "li", "blockquote", "form", "aside", "nav"))
            if tag == "li":
                self._close(("li",), ("ul", "ol", "menu"))
            elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                self._close(("td", "th") if tag in ("td", "th") else ("tr",) if tag == "tr" else ("tbody", "thead", "tfoot"), ("table",))
            elif tag in ("dt", "dd"):
                self._close(("dt", "dd"), ("dl",))
            self._flush()
        if tag in VOID:
            return
        dropped = tag in DROPPED or tag == "header" and not self._articles or _hidden(tag, attributes)
        main = tag in ("article", "main") or bool(_MAIN.search(attributes))
        words = _named(tag, attributes) if not dropped else frozenset()
        if words or tag == "form" and not dropped:
            number, comments = self._names, bool(words & COMMENTS)
            self._open_names.append((len(self._stack), number, comments, self._held))
            self._layout[number] = words <= LAYOUT
            self._names += 1
            self._comments += comments
            dropped = comments or self._spared is not None and number not in self._spared and not main
        if not dropped:
            self._hold(mains=main, heads=tag == "h1")
        self._dropped += dropped
        if main:
            self._articles += 1
            tag = tag if tag in ("article", "main") else "main!"
        elif tag == "a":
            self._anchors += 1
        self._stack.append((tag, len(self.blocks), dropped))
        self._open_tags[tag] += 1

    def _scan(self, source: str) -> None:
        at = 0
        while found := _TAG.search(source, at):
            self._add(source[at : found.start()])
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                self._close((tag, "main!") if tag in ("div", "section") else (tag,), ())
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[^>]*+(?:>|\Z)", re.I).search(source, at) if not found[3].endswith("/") else None
                at = end.end() if end else at if found[3].endswith("/") else len(source)
            else:
                self._open(tag, found[3])
                if found[3].endswith("/") and tag not in VOID and tag in ("svg", "math"):
                    self._close((tag,), ())
        self._add(source[at:])
        while self._stack:
            self._pop()
        self._flush()
        self.holding = self._held

    def kept(self) -> list[bool]:
        if any(self._marked):
            return self._marked
        return [x <= 0.6 for x in self._links]


_PRIME = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E687 % _PRIME


def _subtrees_of(page: _Page) -> list[int]:
    """Hash of the tag and the blocks of each element, from running hashes of the blocks."""
    run, power = [0], [1]
    for block in page.blocks:
        run.append((run[-1] * _BASE + xxhash.xxh3_64_intdigest(block)) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    out = []
    for tag, a, z in page.elements:
        blocks = (run[z] - run[a] * power[z - a]) % _PRIME
        out.append(xxhash.xxh3_64_intdigest(f"{tag} {z - a} {blocks}") - (1 << 63))
    return out


def _read(source: str | None) -> tuple[_Page, list[bool]]:
    page = _Page(source or "", None)
    if page.holds:
        whole = page.holding
        spared = frozenset(
            number for number, layout, held in page.holds
            if whole.mains and held.mains == whole.mains or layout and held.heads == whole.heads and 2 * held.chars > whole.chars
        )
        page = _Page(source or "", spared)
    return page, page.kept()


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for url, source in zip(batch["url"], batch["html"], strict=True):
            page, kept = _read(source)
            print_ = xxhash.xxh3_64_intdigest("\n".join(b for b, k in zip(page.blocks, kept, strict=True) if k)) - (1 << 63)
            host = host_of(url)
            before = [0, *accumulate(kept)]
            seen = {x for x, (_, a, z) in zip(_subtrees_of(page), page.elements, strict=True) if before[z] > before[a]}
            rows += [(host, x, print_) for x in seen]
        yield pd.DataFrame(rows, columns=["host", "subtree", "page"])


def templates(pages: DataFrame, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """(host, subtrees): hashes of the subtrees that recur across the pages of a host. ``pages``: url, html."""
    seen = pages.mapInPandas(_subtrees, "host string, subtree long, page long").distinct()
    seen = cut(seen, "subtrees")
    often = seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sizes = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    found = often.join(sizes, "host").where(F.col("n") >= F.col("pages") * share)
    return cut(found.groupBy("host").agg(F.collect_list("subtree").alias("subtrees")), "templates")


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for source, gone in zip(batch["html"], batch["subtrees"], strict=True):
            page, kept = _read(source)
            if gone is not None and len(gone):
                gone = set(map(int, gone))
                edges = [0] * (len(kept) + 1)
                for x, (_, a, z) in zip(_subtrees_of(page), page.elements, strict=True):
                    if x in gone:
                        edges[a], edges[z] = edges[a] + 1, edges[z] - 1
                kept = [k and not inside for k, inside in zip(kept, accumulate(edges), strict=False)]
            out.append("\n".join(b for b, k in zip(page.blocks, kept, strict=True) if k))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out, "n_chars": [len(t) for t in out]})


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast: int = BROADCAST) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    pages = columns_of(pages, page_id=id_col, url=url_col, html=html_col)
    found = templates(pages.select("url", "html"))
    n = found.agg(F.coalesce(F.sum(F.size("subtrees")), F.lit(0))).first()[0]
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.withColumn("host", host).join(F.broadcast(found) if n <= broadcast else found, "host", "left")
    return rows.select("page_id", "url", "html", "subtrees").mapInPandas(_texts, "page_id long, url string, text string, n_chars long")
