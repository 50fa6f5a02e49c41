"""The structure pass over page markup: one Arrow-batched step that reads nesting.

Only what needs a document tree happens here. Every rule on the pieces is a Column
expression in ``operators.extract``.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache
from html import unescape
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without an end tag, and subtrees that are not listing text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN_TAGS = frozenset(("script", "style", "noscript", "svg"))
HIDDEN_CLASSES = frozenset(("similar-ads", "cards"))
DETAILS_ID, COMMENTS_ID, LABEL_CLASS = "scroll_car_detail", "scroll_seller_comments", "ad-data"

_TEXTS = T.ArrayType(T.StringType())
STRUCTURE = (
    T.StructType().add("title", "string").add("price_box", "string").add("text", "string").add("objects", _TEXTS)
    .add("details", T.ArrayType(T.StructType().add("label", "string").add("value", "string"))).add("comments", _TEXTS)
)
_CLOSES = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset(("ul", "ol", "table", "div", "body", "html", "select"))
_NO_ATTRIBUTES: tuple[dict[str, str], tuple] = ({}, ())
# Attributes of templates repeat; as many short ones are kept.
_KEPT_ATTRIBUTES, _SHORT = 4096, 256


class _Element:
    __slots__ = ("tag", "attrs", "parent", "place", "children", "classes", "in_well")

    def __init__(self, tag, attrs, classes, parent, place, in_well):
        self.tag, self.attrs, self.classes, self.parent, self.place, self.in_well = tag, attrs, classes, parent, place, in_well
        self.children = []

    def elements(self):
        """Elements below this element in document order."""
        stack = self.children[::-1]
        while stack:
            item = stack.pop()
            if item.__class__ is not str:
                yield item
                stack += item.children[::-1]

    def text(self, separator=" ", skip=None):
        parts, stack = [], self.children[::-1]
        while stack:
            item = stack.pop()
            if item.__class__ is str:
                item = item.strip()
                if item:
                    parts.append(item)
            elif not (skip and skip(item)):
                stack += item.children[::-1]
        return separator.join(parts)

    def following(self):
        """Elements beside this one that come after it."""
        siblings = self.parent.children
        places = range(self.place + 1, len(siblings))
        return (siblings[i] for i in places if isinstance(siblings[i], _Element))


# How a token begins: a comment, another declaration, or the name of an end or start tag, with its
# rest where that holds no bracket and no single quote.
_OPENING = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/<>]*)([^<>"']*+(?:"[^"<>]*"[^<>"']*+)*+>)?)""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_RAW_TEXT = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in ("script", "style")}


_TAG_REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>""")


class _TagEnds:
    """Where the start tags of a page end: at the first ``>`` outside quoted values.

    Once a tag has no end, ends are linked backwards over all quotes and brackets, so a page of
    unclosed tags or quotes is still read in linear time.
    """

    def __init__(self, html):
        self.html, self.places, self.ends = html, None, None

    def after(self, at):
        """Place of the bracket that ends a tag whose name ends at ``at``, or -1."""
        if self.ends is None:
            rest = _TAG_REST.match(self.html, at)
            if rest:
                return rest.end() - 1
            self._link()
        return self.ends[bisect_left(self.places, at)]

    def _link(self):
        self.places = [mark.start() for mark in re.finditer("[>\"']", self.html)]
        self.ends, following = [-1] * (len(self.places) + 1), {}
        for i in range(len(self.places) - 1, -1, -1):
            mark = self.html[self.places[i]]
            if mark == ">":
                self.ends[i] = self.places[i]
                continue
            if mark in following:
                self.ends[i] = self.ends[following[mark] + 1]
            following[mark] = i


def _attributes(source):
    """The attributes any rule looks at, with character references resolved, and the classes."""
    found = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        name = name.lower()
        if name in ("id", "class", "type"):
            found.setdefault(name, unescape(double or single or bare))
    return found, tuple(found.get("class", "").split())


_short_attributes = lru_cache(_KEPT_ATTRIBUTES)(_attributes)


def build_tree(html):
    """Root of the page's elements and texts, and its elements in document order.

    Unclosed items, paragraphs and cells end where they must. Linear in the length of the page,
    whatever its markup: a tag that never ends is text.
    """
    root = _Element("", *_NO_ATTRIBUTES, None, 0, False)
    # Open elements, the depths at which each tag lies open, and text still to be added.
    opened, depths, texts, elements = [root], {}, [], []
    ends, last, search = _TagEnds(html), html.rfind(">"), _OPENING.search
    depth_of = lambda name: found[-1] if (found := depths.get(name)) else 0
    at = begin = 0
    while (token := search(html, at)) is not None:
        comment, declaration, slash, name, rest = token.groups()
        start, at = token.span()
        if rest:
            end = at - 1
        elif comment:
            end = html.find("-->", at)
            end = end + 2 if end >= 0 else len(html) - 1
        else:
            end = ends.after(at) if name and not slash else html.find(">", at) if at <= last else -1
            if end < 0:
                continue
        if start > begin:
            text = html[begin:start]
            texts.append(unescape(text) if "&" in text else text)
        attributes = "" if slash or not name else rest[:-1] if rest else html[at:end]
        at = begin = end + 1
        if not name:
            continue
        tag = name.lower()
        if slash:
            depth = depth_of(tag)
        else:
            closed = _CLOSES.get(tag)
            depth = max(map(depth_of, closed)) if closed else 0
            if depth and depth <= max(map(depth_of, _SCOPES)):
                depth = 0
        if texts and (depth or not slash):
            opened[-1].children.append("".join(texts))
            texts.clear()
        if depth:
            for element in opened[depth:]:
                depths[element.tag].pop()
            del opened[depth:]
        if slash:
            continue
        parent = opened[-1]
        if "=" in attributes:
            attrs, classes = _short_attributes(attributes) if len(attributes) < _SHORT else _attributes(attributes)
        else:
            attrs, classes = _NO_ATTRIBUTES
        element = _Element(tag, attrs, classes, parent, len(parent.children), parent.in_well or "price-well" in classes)
        parent.children.append(element)
        elements.append(element)
        raw = _RAW_TEXT.get(tag)
        if raw:
            closing = raw.search(html, at) if at <= last else None
            element.children.append(html[at:closing.start() if closing else len(html)])
            at = begin = closing.end() if closing else len(html)
        elif tag not in VOID and not attributes.endswith("/"):
            depths.setdefault(tag, []).append(len(opened))
            opened.append(element)
    if begin < len(html):
        texts.append(unescape(html[begin:]))
    if texts:
        opened[-1].children.append("".join(texts))
    return root, elements


def _hidden(element):
    return element.tag in HIDDEN_TAGS or bool(element.classes) and not HIDDEN_CLASSES.isdisjoint(element.classes)


def _nested_objects(value):
    """Objects of a JSON-LD document, through lists and graphs."""
    pending = [value]
    while pending:
        item = pending.pop()
        if isinstance(item, list):
            pending.extend(reversed(item))
        elif isinstance(item, dict):
            yield item
            pending.append(item.get("@graph", []))


_SORTED = json.JSONEncoder(sort_keys=True, ensure_ascii=False)


def _objects_of(script):
    """JSON texts of a script's objects; none if it is broken or nested beyond what can be read."""
    try:
        found = [_SORTED.encode(item) for item in _nested_objects(json.loads(script))]
    except (ValueError, RecursionError):
        return []
    # Half of a surrogate pair is no text that could leave Python.
    return [item.encode("utf-8", "replace").decode() for item in found]


def _price_box(elements):
    """Text of the main price: inside the price well if there is one."""
    boxes = [e for e in elements if e.tag == "strong" and e.parent is not None and "price-box" in e.parent.classes]
    if not boxes:
        return None
    return next((box for box in boxes if box.parent.parent is not None and box.parent.parent.in_well), boxes[0]).text()


def _scripts(elements):
    scripts = (e for e in elements if e.tag == "script" and e.attrs.get("type") == "application/ld+json")
    return ["".join(c for c in e.children if isinstance(c, str)) for e in scripts]


def _details(block):
    found = []
    for element in block.elements() if block is not None else ():
        if element.tag == "li" and LABEL_CLASS in element.classes:
            value = next((e for e in element.following() if e.tag == "li"), None)
            if value is not None and LABEL_CLASS not in value.classes:
                found += [element.text(), value.text()]
    return found


def _comments(marker):
    following = next(marker.following(), None) if marker is not None else None
    return following.text("\n") if following is not None and following.tag == "div" else None


PARTS = tuple(STRUCTURE.names)


def _collected(html, parts):
    """Texts of the page that make up each of the named ``parts``: one, none or a list."""
    return _gathered(*build_tree(html), parts)


def _gathered(root, elements, parts):
    first = lambda wanted, default=None: next((e for e in elements if wanted(e)), default)
    collect = {
        "title": lambda: None if (h := first(lambda e: e.tag == "h1")) is None else h.text(),
        "price_box": lambda: _price_box(elements),
        "text": lambda: "" if _hidden(body := first(lambda e: e.tag == "body", root)) else body.text(skip=_hidden),
        "objects": lambda: _scripts(elements),
        "details": lambda: _details(first(lambda e: e.attrs.get("id") == DETAILS_ID)),
        "comments": lambda: _comments(first(lambda e: e.attrs.get("id") == COMMENTS_ID)),
    }
    found = [collect[part]() for part in parts]
    for element in elements:
        element.parent = None  # without cycles a tree is freed at once
    return found


def _squashed(text):
    return None if text is None else " ".join(text.split())


def _labelled(texts):
    texts = [" ".join(text.split()) for text in texts]
    found = {label.rstrip(":").casefold(): value for label, value in zip(texts[::2], texts[1::2], strict=True)}
    return [{"label": label, "value": value} for label, value in found.items()]


_FINISH = {
    "title": _squashed, "price_box": _squashed, "text": _squashed, "details": _labelled,
    "objects": lambda scripts: [item for script in scripts for item in _objects_of(script)],
    "comments": lambda text: None if text is None else [_squashed(line) for line in text.splitlines()],
}


# The text of a script or style, and a tag or declaration (without its brackets) that ends at its first
# bracket whatever follows it.
_ATTRIBUTES_REST = r"""[^<>"']*+(?:"[^"<>]*"[^<>"']*+)*+"""
_RAW_PIECE = re.compile(rf"""(<((?i:script|style))(?=[\s/>]){_ATTRIBUTES_REST}>)([^<]*+(?:<(?!/(?i:\2)\b)[^<]*+)*+)(?=<)""")
_PLAIN_TAG = re.compile(rf"""/?[a-zA-Z][^\s/<>"']*+(?=[\s/]|\Z){_ATTRIBUTES_REST}|![a-zA-Z][^<>]*""")
# Markup whose brackets open and close in turn.
_IN_TURN = re.compile("(?:<[^<>]*+>[^<>]*+)*+")
# Pages of one template have the same tags. So many layouts of pages with few tags are kept.
_KEPT_LAYOUTS, _SHORT_PAGE, _FEW_TAGS, _SHORT_TAGS = 2048, 16_384, 256, 4096
_MARK = re.compile("\x01(\\d+)\x02")


@lru_cache(_KEPT_LAYOUTS)
def _layout(joined, parts):
    """Where the texts of a page with these tags (joined by opening brackets) belong: the numbers of its raw texts, and what fills each part.

    None if a tag may end elsewhere, or if a script or style holds more than one text.
    """
    tags = joined.split("<")
    if not all(map(_PLAIN_TAG.fullmatch, tags)):
        return None
    marked = "".join([f"<{tag}>\x01{i}\x02" for i, tag in enumerate(tags)])
    root, elements = build_tree(marked)
    raw = [_MARK.fullmatch("".join(e.children)) for e in elements if e.tag in _RAW_TEXT]
    collected = _gathered(root, elements, parts)
    if not all(raw):
        return None

    def places(found, separator):
        return tuple(tuple(map(int, _MARK.findall(item))) for item in found.split(separator) if item)

    def filled(found, part):
        if found is None or isinstance(found, list):
            items = found and [filled(item, part) for item in found]
            return (lambda texts: [item(texts) for item in items]) if items else lambda texts: found
        separator = "\n" if part == "comments" else " "
        at = places(found, separator)
        if len(at) == 1 and len(at[0]) == 1 and part != "objects":
            return lambda texts, only=at[0][0]: texts[only].strip()
        pick = _picked(at)
        if part == "objects":
            return lambda texts: "".join(pick(texts))
        return lambda texts: separator.join(filter(None, map(str.strip, pick(texts))))

    return [int(mark[1]) for mark in raw], [filled(found, part) for part, found in zip(parts, collected, strict=True)]


def _picked(places):
    """A function that takes from all texts of a page those at the places, joined where one has several."""
    if any(len(at) != 1 for at in places):
        return lambda texts: ["".join([texts[i] for i in at]) for at in places]
    numbers = [i for (i,) in places]
    if len(numbers) > 1:
        return itemgetter(*numbers)
    return lambda texts: [texts[i] for i in numbers]


def _from_layout(html, parts):
    """What ``_collected`` gives, for a page of plain tags whose like was read before; else None."""
    if len(html) > _SHORT_PAGE or "<!--" in html:
        return None
    seen = _layout.cache_info()
    if seen.misses > _KEPT_LAYOUTS and seen.hits < seen.misses:
        return None  # these pages share no layouts
    around = _RAW_PIECE.split(html)
    raw = around[3::4]
    if raw:
        around[2::4] = around[3::4] = [""] * len(raw)
        html = "".join(around)
    if _IN_TURN.fullmatch(html):
        pieces = html.replace(">", "<").split("<")
        tags, texts = pieces[1::2], pieces[2::2]
    else:
        pieces = [piece.partition(">") for piece in html.split("<")]
        if not html.startswith("<") or not all(end for _, end, _ in pieces[1:]):
            return None  # a bracket that ends nowhere
        tags, texts = [tag for tag, _, _ in pieces[1:]], [text for _, _, text in pieces[1:]]
    joined = "<".join(tags)
    if not tags or len(tags) > _FEW_TAGS or len(joined) > _SHORT_TAGS:
        return None
    layout = _layout(joined, parts)
    if layout is None or len(layout[0]) != len(raw):
        return None
    if "&" in html:
        texts = [unescape(text) if "&" in text else text for text in texts]
    for i, text in zip(layout[0], raw, strict=True):
        texts[i] = text
    return [fill(texts) for fill in layout[1]]


def read_page(html: str | None, parts: Sequence[str] = PARTS):
    """The named ``parts`` of a page: title, price box, visible text, JSON-LD objects, details, comment lines.

    The nesting of a page follows from its tags; pages with the tags of an earlier one only fill in its texts.
    """
    html, parts = html or "", tuple(parts)
    found = _from_layout(html, parts)
    if found is None:
        found = _collected(html, parts)
    return tuple(_FINISH[part](texts) for part, texts in zip(parts, found, strict=True))


def page_structure(html: Column, parts: Sequence[str] = PARTS) -> Column:
    """Struct of the named pieces of a page; only the markup column crosses to Python."""
    names = [name for name in PARTS if name in parts]

    @F.pandas_udf(T.StructType([STRUCTURE[name] for name in names]))
    def structure(markup: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(page, names) for page in markup], columns=names)

    return structure(html)


def with_structure(pages: DataFrame, html: str = "html", parts: Sequence[str] = PARTS) -> DataFrame:
    """Pages with the named pieces of their markup as ``page``, and without the markup.

    Each piece costs a walk over the page; with none there is no ``page`` and no pass.
    """
    return (pages.withColumn("page", page_structure(F.col(html), parts)) if parts else pages).drop(html)
