"""Main text of web pages by differencing each page with its nearest neighbour on the site.

Pages are laid in the order of host and url path. A page is compared with the neighbour of its
host whose path agrees longest, by a longest common subsequence over their lines of text: what
both share is template and is deleted. Lines inside an article element are text of the page even
where a neighbour repeats them (quotations do), unless it repeats the whole article beside a longer
text of the page's own in the main element; lines of menus, forms and the like are none even where
nothing repeats them.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import numbered, staged
from .url_trust import split_url

GROUP = 32  # consecutive pages of one group, besides one at each edge
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(script|style|noscript|template|iframe|svg|textarea|object|title)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
_NOISE_TAGS = frozenset("nav footer aside form button select dialog menu head".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "discussion footer gdpr login menu modal nav navbar navigation newsletter notice notices notification notifications pager pagination "
    "popup promo promoted recommended related replies reply respond responses share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar widget widgets".split()
)
_NOISE_BEGINNINGS = ("advert", "breadcrumb", "comment", "cookie", "navbar", "newsletter", "sidebar")
_TELLS_OF_OTHERS = frozenset("has is no not with without".split())  # "has-sidebar" names the element beside one
_NOISE_ARTICLES = frozenset("ad ads advert comment comments promo promoted recommended related reply sponsored".split())
_NOISE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
_CONTENT_WORDS = frozenset("article content entry post story".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass
class Line:
    text: str
    noise: bool
    region: int  # 3 article, 2 main, 1 element named as content, 0 none


def _traits(tag: str, attributes: str, region: int) -> tuple[bool, int]:
    """Whether an element is noise, and the region that begins with it (0: none)."""
    begins = 3 if tag == "article" else 2 if tag == "main" else 0
    noise = tag in _NOISE_TAGS or (tag == "header" and not region)
    if attributes:
        for m in _NAMED.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role":
                noise |= value in _NOISE_ROLES
                begins = max(begins, 3 if value == "article" else 2 if value == "main" else 0)
            elif name in ("class", "id"):
                words = {w for part in value.split() if (found := _WORD.findall(part)) and found[0] not in _TELLS_OF_OTHERS for w in found}
                if tag == "article":
                    noise |= bool(words & _NOISE_ARTICLES)
                elif tag not in ("body", "html", "main"):
                    noise |= bool(words & _NOISE_WORDS) or any(w.startswith(_NOISE_BEGINNINGS) for w in words)
                if words & _CONTENT_WORDS and tag in ("div", "section", "td"):
                    begins = max(begins, 1)
            elif name == "style":
                noise |= "display:none" in value.replace(" ", "")
            else:
                noise |= name == "hidden" or value == "true"
    return noise, begins


def lines_of(page: str | None) -> list[Line]:
    """The blocks of a page that hold text, in order."""
    out: list[Line] = []
    if not page:
        return out
    opened: list[tuple[str, bool, int]] = []  # tag, noise and region inside it
    noise, region, parts, at = False, 0, [], 0

    def flush():
        if parts:
            text = _SPACE.sub(" ", references.unescape("".join(parts))).strip()
            if text:
                out.append(Line(text, noise, region))
            parts.clear()

    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            if m[1]:
                parts.append(" ")
            continue
        tag = tag.lower()
        block = tag in _BLOCKS
        if block:
            flush()
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if tag in _VOID or m[4].endswith("/") and not block:
            continue
        if m[2]:
            for depth in range(len(opened) - 1, -1, -1):
                if opened[depth][0] == tag:
                    if not block and noise:
                        flush()
                    del opened[depth:]
                    break
        else:
            if block and opened and opened[-1][0] in ("p", "li") and (opened[-1][0] == "p" or tag == "li"):
                opened.pop()  # ended by the next block
                _, noise, region = opened[-1] if opened else ("", False, 0)
            own, begins = _traits(tag, m[4], region)
            if block or own:
                if own and not block:
                    flush()
                opened.append((tag, noise or own, max(region, begins)))
        _, noise, region = opened[-1] if opened else ("", False, 0)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of both, by bit-parallel rows."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    found = [*range(low), *range(len(a) - high, len(a))]
    where: dict[int, int] = {}
    for i, v in enumerate(x):
        where[v] = where.get(v, 0) | 1 << i
    y = [v for v in y if v in where]
    full = (1 << len(x)) - 1
    row, rows = full, []
    for v in y:
        both = row & where[v]
        row = ((row + both) | (row - both)) & full
        rows.append(row)
    i, j = len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            found.append(low + i)
            i, j = i - 1, j - 1
    return sorted(found)


def best_region(lines: list[Line]) -> int:
    return max((x.region for x in lines if not x.noise), default=0)


def main_lines(lines: list[Line], shared: set[int]) -> list[str]:
    """Lines of the best region that are neither noise nor shared template.

    Outside of articles and main elements shared lines go; if nearly all lines are shared the
    neighbour is a copy of the page and shows no template. An article that the neighbour has word for
    word is a teaser of the site where the main element around it holds more text that is the page's own.
    """
    clean = [(i, x) for i, x in enumerate(lines) if not x.noise]
    best = best_region(lines)
    if best == 3 and all(i in shared for i, x in clean if x.region == 3):
        own = sum(len(x.text) for i, x in clean if x.region == 2 and i not in shared)
        if own > sum(len(x.text) for _, x in clean if x.region == 3):
            best = 2
    inside = [(i, x) for i, x in clean if x.region == best]
    if best < 2 and sum(i in shared for i, _ in inside) < 0.9 * len(inside):
        inside = [(i, x) for i, x in inside if i not in shared]
    return [x.text for _, x in inside]


def _page_key(url: str, html: str) -> Column:
    return F.xxhash64(split_url(url)[0], F.coalesce(html, F.lit("")))


def shared_lines(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """key and ``shared``: numbers of a page's lines that its nearest neighbour shares in order.

    Only hashes of lines travel. Equal pages of a host are one, at the first of their paths, so a
    neighbour is always another page. Pages get gapless numbers in the order of host, path and
    key; neighbours are the pages before and after of the same host. Numbers are cut into groups
    and a page at the edge of one is also laid into the next, so no task sees a whole host and no
    pair is lost. Of two whose paths agree as far, the one that shares more lines counts. Every page
    is compared; those that share nothing get no row.
    """

    @F.pandas_udf("array<long>")
    def hashes(htmls: pd.Series) -> pd.Series:
        return pd.Series([[xxhash.xxh64_intdigest(x.text) - (1 << 63) for x in lines_of(h)] for h in htmls])

    host, path = split_url(url)
    narrow = pages.select(_page_key(url, html).alias("key"), host.alias("host"), path.alias("path"), hashes(F.col(html)).alias("lines"))
    distinct = narrow.groupBy("key", "host").agg(F.min(F.struct("path", "lines")).alias("first"))
    placed = numbered(distinct.select("key", "host", "first.*"), ["host", "path", "key"], "number", "page-lines")
    home, place = F.floor(F.col("number") / GROUP), F.col("number") % GROUP
    groups = F.array_compact(F.array(home, F.when(place == 0, home - 1), F.when(place == GROUP - 1, home + 1)))
    group = Window.partitionBy("group").orderBy("number")
    near = F.struct("host", "path", "lines")
    laid = placed.select("*", F.explode(groups).alias("group"))
    sides = laid.select("*", F.lag(near).over(group).alias("a"), F.lead(near).over(group).alias("b")).where(F.col("group") == home)

    def same(side: str) -> Column:
        return F.when(F.col(f"{side}.host") == F.col("host"), F.col(side))

    @F.pandas_udf("array<int>")
    def shared(lines: pd.Series, path: pd.Series, a_path: pd.Series, a_lines: pd.Series, b_path: pd.Series, b_lines: pd.Series) -> pd.Series:
        out = []
        for own, at, *neighbours in zip(lines, path, a_path, a_lines, b_path, b_lines, strict=True):
            sides = [(len(commonprefix([at, p])), list(x)) for p, x in (neighbours[:2], neighbours[2:]) if p is not None]
            longest = max((n for n, _ in sides), default=0)
            both = [common_subsequence(list(own), x) for n, x in sides if n == longest]
            out.append(np.array(max(both, key=len, default=[]), np.int32))
        return pd.Series(out)

    joined = sides.withColumn("a", same("a")).withColumn("b", same("b"))
    found = joined.select("key", shared("lines", "path", "a.path", "a.lines", "b.path", "b.lines").alias("shared"))
    return found.where(F.size("shared") > 0)


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page row; null and empty pages have an empty text.

    White space inside a block becomes one blank, blocks are joined by line ends, character
    references are decoded. Rows of one host with the same html come out alike. Other columns are
    not read.
    """
    @F.pandas_udf("string")
    def extract(htmls: pd.Series, shared: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(main_lines(lines_of(h), set(() if s is None else s))) for h, s in zip(htmls, shared, strict=True)])

    found = staged(shared_lines(pages, url=url, html=html), "shared-lines")
    keyed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), _page_key(url, html).alias("key"))
    joined = keyed.join(found, "key", "left").select("page_id", "url", extract("html", "shared").alias("text"))
    return joined.withColumn("n_chars", F.length("text").cast("long"))
