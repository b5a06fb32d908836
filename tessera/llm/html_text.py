"""Main text of web pages by tag-path ratios: text and punctuation are summed for each path of tags, smoothed, fused, and thresholded."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: Elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title select canvas audio video".split())
BLOCK = frozenset("html body article section main div p ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 header footer nav aside form fieldset address details summary center hr dialog menu search".split())
ENDS_PARAGRAPH = BLOCK - {"html", "body"}
#: Elements that end an open one of these kinds, up to a container.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table body article section div main td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, and words of a class, id or role, that name what an article is without: menus, headers, footers, sidebars, notices,
#: adverts, forms and reader comments. A name that has a word of LAYOUT says something about a whole page.
NAMED = frozenset("nav footer aside form dialog menu search button fieldset header".split())
WORDS = frozenset("""ad ads advert advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay
sidebar side aside widget widgets related recommend recommended recommendations share sharing social nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar
comment comments commentlist respond reply replies discussion disqus newsletter subscribe signup login search searchbox pagination pager copyright skip""".split())
OUTSIDE = frozenset("header head logo".split())
LAYOUT = frozenset("has no not with without is layout page site wrapper wrap container content main body app root article post entry".split())
#: Weight of what is so named, and of what isn't.
UNLIKELY = 0.001
#: A path is content from this part of the highest value on; inside the element that holds the part MOST of that content, from the lower part on.
SHARE, INSIDE, MOST = 0.25, 0.01, 0.8
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*)/?>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？;]")


class Element:
    """An element that is open or was: its parent, its path of block elements as a number, its weight."""

    __slots__ = ("name", "parent", "path", "depth", "weight", "own_weight", "article", "number")

    def __init__(self, name, parent, path, number):
        self.name, self.parent, self.path, self.number = name, parent, path, number
        self.depth = parent.depth + 1 if parent else 0
        self.article = name in ("article", "main") or bool(parent and parent.article)
        self.own_weight = self.weight = 1.0


class Node:
    """A run of text within one block."""

    __slots__ = ("element", "parts", "linked", "text")

    def __init__(self, element):
        self.element, self.parts, self.linked, self.text = element, [], 0, ""


def unlikely(names: str, inside: bool) -> bool:
    """Whether a class, id or role names what isn't the article."""
    for name in names.split():
        words = [w.lower() for w in _PARTS.findall(name)]
        known = WORDS if inside else WORDS | OUTSIDE
        if not LAYOUT.isdisjoint(words):
            known = frozenset(w for w in known if words[-1] == w) if words[0] in ("page", "site", "post", "article", "entry", "main") else frozenset()
        if not known.isdisjoint(words):
            return True
    return False


def parsed(page: str) -> tuple[list[Node], list[Element]]:
    """The page's runs of text in order, and its elements, parents first. Time is linear in the page, also where elements nest deeply."""
    paths: dict[tuple[int, str], int] = {}
    root = Element("", None, 0, 0)
    elements, stack, opened, blocks = [root], [root], {}, [root]
    nodes: list[Node] = []
    current: Node | None = None
    links, at, n, unended = 0, 0, len(page), set()

    def text(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if not raw.strip():
                return
            current = Node(stack[-1])
            nodes.append(current)
        raw = html.unescape(raw)
        current.parts.append(raw)
        if links:
            current.linked += len(raw.strip())

    def close(name: str) -> None:
        nonlocal links
        if not opened.get(name) or name not in BLOCK and not any_inline(name):
            return
        while True:
            gone = stack.pop()
            opened[gone.name] -= 1
            links -= gone.name == "a"
            if gone is blocks[-1]:
                blocks.pop()
            if gone.name == name:
                return

    def any_inline(name: str) -> bool:
        """An inline end doesn't close blocks."""
        for e in reversed(stack):
            if e.name == name:
                return True
            if e.name in BLOCK:
                return False
        return False

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if name in BLOCK:
                current = None
            close(name)
            continue
        if name == "br":
            text(" ")
            continue
        if name in RAW:
            end = None if name in unended else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if not end:
                unended.add(name)
            at = end.end() if end else n if name in ("script", "style", "textarea", "title") else at
            continue
        if name in BLOCK:
            current = None
        if name in VOID or m[0].endswith("/>") and name not in BLOCK:
            continue
        if name in ENDS_PARAGRAPH and blocks[-1].name == "p":
            close("p")
        if name in SIBLINGS and any(opened.get(x) for x in SIBLINGS[name]):
            for e in reversed(blocks):
                if e.name in SIBLINGS[name]:
                    close(e.name)
                    break
                if e.name in SCOPE:
                    break
        own = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
        label = name
        if name in ("div", "section", "ul", "td") and own.get("class", "").split():
            label = f"{name}.{own['class'].split()[0]}"
        up = stack[-1]
        path = paths.setdefault((up.path, label), len(paths) + 1) if name in BLOCK else up.path
        e = Element(name, up, path, len(elements))
        if "hidden" in own and own["hidden"].lower() != "until-found" or own.get("aria-hidden", "").lower() == "true" or _NONE.search(own.get("style", "")):
            e.own_weight = 0.0
        elif name in NAMED and not (name == "header" and e.article):
            e.own_weight = UNLIKELY
        elif name not in ("html", "body", "article", "main") and unlikely(" ".join(filter(None, map(own.get, ("class", "id", "role")))), e.article):
            e.own_weight = UNLIKELY
        if name == "a":
            links += 1
        elements.append(e)
        stack.append(e)
        opened[name] = opened.get(name, 0) + 1
        if name in BLOCK:
            blocks.append(e)
    for node in nodes:
        node.text = " ".join("".join(node.parts).split())
    return [node for node in nodes if node.text], elements


def totals(elements: list[Element], nodes: list[Node], amounts) -> np.ndarray:
    """What each element's nodes amount to, those of elements in it included."""
    out = np.zeros(len(elements))
    for node, x in zip(nodes, amounts):
        out[node.element.number] += x
    for e in reversed(elements[1:]):
        out[e.parent.number] += out[e.number]
    return out


def smoothed(x: np.ndarray) -> np.ndarray:
    """Means of each value and its neighbours, the value itself counted twice."""
    total, weight = 2 * x, np.full(len(x), 2.0)
    for to, of in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
        total[to] += x[of]
        weight[to] += 1
    return total / weight


def ratios(path: np.ndarray, free: np.ndarray, size: np.ndarray, punctuation: np.ndarray) -> np.ndarray:
    """Value of each node's path. Text outside links and punctuation a node of the path are smoothed over the page's nodes in their order, averaged
    over the path again and multiplied, text as the geometric mean with its unsmoothed ratio; a path loses by its share of links, squared."""
    count = np.bincount(path)
    per = lambda x: (np.bincount(path, x) / np.maximum(count, 1))[path]
    long, marks = np.sqrt(per(free) * per(smoothed(per(free)))), per(smoothed(per(punctuation)))
    return long * (1 + marks) * (per(free) / np.maximum(per(size), 1)) ** 2


def extract(page: str | None) -> str:
    """The article's blocks, joined by two newlines; empty if there are none.

    A node is content if the value of its tag path, times its weight, is SHARE of the highest one or more. An element that holds most of that
    content bounds the article: in it the part INSIDE is enough, and headings go with it. Elements and class names of what the contract leaves
    out only weigh on the value, unless they hold most of the page's text, or its article element.
    """
    nodes, elements = parsed(page or "")
    if not nodes:
        return ""
    size = np.array([len(x.text) for x in nodes], float)
    free = np.maximum(size - [x.linked for x in nodes], 0)
    punctuation = np.array([len(_PUNCTUATION.findall(x.text)) for x in nodes]) * free / size
    held = totals(elements, nodes, size)
    holds = np.zeros(len(elements), bool)
    for e in elements:
        if e.name in ("article", "main"):
            holds[e.parent.number] = True
    for e in reversed(elements[1:]):
        holds[e.parent.number] |= holds[e.number]
    for e in elements[1:]:
        whole = holds[e.number] or held[e.number] > held[0] / 2
        e.weight = e.parent.weight * (1.0 if whole and e.own_weight else e.own_weight)
    weight = np.array([x.element.weight for x in nodes])
    path = np.unique([x.element.path for x in nodes], return_inverse=True)[1]
    value = ratios(path, free, size, punctuation) * weight
    top = value.max()
    if not top > 0:
        return ""
    content = value >= SHARE * top
    own = totals(elements, nodes, size * content)
    bound = max((e for e in elements if own[e.number] >= MOST * own[0]), key=lambda e: (e.depth, -e.number))
    runs = totals(elements, nodes, np.ones(len(nodes)))
    while bound.parent and (bound.name not in SCOPE or runs[bound.number] < 2):  # a paragraph alone doesn't bound an article
        bound = bound.parent
    inner = np.zeros(len(elements), bool)
    for e in elements[bound.number :]:
        inner[e.number] = e is bound or bool(e.parent and inner[e.parent.number])
    inside = np.array([inner[x.element.number] for x in nodes])
    beside = {e.parent.number for x, c in zip(nodes, content) if c for e in [block(x.element)] if e.parent}
    heading = np.array([block(x.element).name in HEADINGS for x in nodes])
    if bound.name not in ("", "html", "body"):
        content |= inside & (value >= INSIDE * top)
        heading &= inside
    else:
        heading &= np.array([bool(block(x.element).parent) and block(x.element).parent.number in beside for x in nodes])
    content |= heading & (weight >= weight[content].max())
    return "\n\n".join(x.text for x, c in zip(nodes, content) if c)


def block(e: Element) -> Element:
    while e.parent and e.name not in BLOCK:
        e = e.parent
    return e


@arrow_udf(StringType())
def main_text(page: pa.Array) -> pa.Array:
    return pa.array([extract(x) for x in page.to_pylist()], pa.string())


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars (code points).

    Null, empty or textless html: empty text. Pages are read whole, however long or deeply nested. Nulls in the other columns stay; repeated
    rows: one row each. Of elements that hold the same content the innermost bounds it. Empty table: no rows. Other columns are ignored.
    """
    return pages.select("page_id", "url", main_text(F.col("html")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
