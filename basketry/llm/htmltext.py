"""Main text of web pages by tag-path ratios.

The page is read once into its elements and text nodes. A text node's path runs from the
root to its element and names each element by tag and class. Per distinct path the text
length and the punctuation are aggregated over the page:

    text ratio   characters of the path's nodes / number of its nodes
    mark ratio   punctuation characters of the path's nodes / number of its nodes

Both are smoothed with the paths next to it in page order, fused as their product, and
compared with a threshold set from the fused values of the page (their mean and spread,
weighted by text). The nodes of the paths above the threshold are the content.

Short parts of the content (headings, one-word paragraphs, lists) can't pass on their
own; they stay by their place: with a content node directly in the same sectioning
element, in an article element that holds one, as the direct text of a titled element
around it, or as a title alone in its element right before it. A list that is mostly
links stays only inside an article element.

Before that, the word lists take out what is never content: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments. A word of a class or id
marks no element that holds most of the page's text, unless an article or main element
lies outside it.

Character references are decoded, white space inside a block becomes one space,
blocks are joined in page order by one newline.

Defined results: a null or empty page gives empty text; broken markup is read the
way browsers do for the cases that matter here (unclosed paragraphs, list items,
table cells and inline elements; a quote without an end; a cut-off page). Time and memory
are linear in the page's length, however deep its elements are nested. Rows are kept one
for one, repeated ones too; no rows give no rows; an existing column ``main_text`` is
replaced. A page is one row, so a task holds one Arrow batch of pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import bound_batches

# Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend"}
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"},
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
# Boilerplate by element, role and by words of class and id.
BOILERPLATE_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe button select option textarea input label svg math "
    "head title menu dialog object embed canvas audio video map noembed noframes xmp fieldset datalist".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing "
    "shareaside sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription teaser toolbar "
    "topbar widget widgets hidden".split()
)

# elements that group blocks; text belongs to the nearest one
SECTIONS = frozenset("address article body center details div header hgroup html main section td th".split())
LISTS = frozenset("ul ol dl menu dir".split())
TITLES = frozenset(("h1", "h2"))
#: A path is content if its fused ratio is not below the mean by more than this many deviations.
SPREAD = 0.5
#: The share of link text from which a list counts as a menu.
LINK_SHARE = 0.8

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKS = re.compile(r"[,.;:!?…。，、；：！？]")


def _boilerplate(tag: str, attrs: str, inside_article: bool) -> tuple[str, str]:
    """(mark, class): the mark is ``-`` for boilerplate, ``~`` if only a word of class or id
    says so, or nothing."""
    if tag in BOILERPLATE_TAGS or (tag == "header" and not inside_article):
        return "-", ""
    if not attrs or tag in ("html", "body", "article", "main"):
        return "", ""
    named = style = ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if name == "class":
                style = value
            if any(w.lower() in BOILERPLATE_WORDS for w in _NAME_WORDS.findall(value)):
                named = "~"
        elif name == "role":
            if value.lower() in BOILERPLATE_ROLES:
                return "-", ""
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "-", ""
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "-", ""
    return named, style


class _Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self) -> None:
        self.elements: list[int] = []
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def push(self, element: int, tag: str) -> None:
        at = len(self.tags)
        self.elements.append(element)
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)

    def close(self, down_to: int) -> None:
        while len(self.tags) > down_to:
            tag = self.tags.pop()
            self.elements.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()


class PageTree:
    """Elements and text nodes of a page; element 0 is the page itself.

    Of each element: ``parent`` (a smaller number), ``tag``, ``mark`` and ``path``, the
    number of its path of tags and classes. ``nodes`` lists (element, block, raw text) in
    page order; a block ends where a block element opens or closes.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.mark, self.path = [0], [""], [""], [0]
        self.nodes: list[tuple[int, int, str]] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._block = 0
        self._read(page)
        self._settle()

    def _element(self, parent: int, tag: str, mark: str, style: str) -> int:
        key = (self.path[parent], f"{tag}.{style}" if style else tag)
        self.parent.append(parent)
        self.tag.append(tag)
        self.mark.append(mark)
        self.path.append(self._paths.setdefault(key, len(self._paths) + 1))
        return len(self.tag) - 1

    def _text(self, element: int, raw: str) -> None:
        if raw and not raw.isspace():
            self.nodes.append((element, self._block, raw))
        elif raw and self.nodes and self.nodes[-1][1] == self._block:
            self.nodes.append((self.nodes[-1][0], self._block, " "))

    @staticmethod
    def _tag_end(page: str, pos: int, last_quote: dict[str, int]) -> tuple[int, int]:
        """(end of the attributes, end of the tag) of a tag whose attributes start at ``pos``.
        A quote opens a value only after ``=``; one without an end is an ordinary character."""
        n = len(page)
        while True:
            pos = _PLAIN.match(page, pos).end()
            if pos >= n:
                return n, n
            c = page[pos]
            if c == ">":
                return pos, pos + 1
            before = pos - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and pos < last_quote[c]:
                pos = page.index(c, pos + 1)
            pos += 1

    def _read(self, page: str) -> None:
        opened, pos, n = _Open(), 0, len(page)
        opened.push(0, "")
        last_quote = {q: page.rfind(q) for q in "\"'"}
        start = 0  # of the text not yet added
        while True:
            at = page.find("<", pos)
            if at < 0:
                break
            following = page[at + 1 : at + 2]
            closing = following == "/"
            name = _NAME.match(page, at + 1 + closing)
            if not name and following not in ("!", "?"):
                pos = at + 1  # an ordinary character
                continue
            self._text(opened.elements[-1], page[start:at])
            if not name:  # comment or declaration
                end = "-->" if page.startswith("<!--", at) else ">"
                stop = page.find(end, at + 2)
                start = pos = n if stop < 0 else stop + len(end)
                continue
            stop, pos = self._tag_end(page, name.end(), last_quote)
            start = pos
            tag = name[0].lower()
            if closing:
                if tag in BLOCK:
                    self._block += 1
                if opened.places.get(tag):
                    opened.close(opened.places[tag][-1])
                continue
            if tag == "br":
                self._text(opened.elements[-1], " ")
                continue
            if tag in BLOCK:
                self._block += 1
            if tag in VOID:
                continue
            p = opened.last(("p",))
            if tag in CLOSES_P and p >= 0 and opened.blocks[-1] == p:
                opened.close(p)
            ends = opened.last(CLOSED_BY.get(tag, ()))
            if ends > opened.last(SCOPE.get(tag, ())):
                # the outermost of the elements that this tag ends
                scope = opened.last(SCOPE.get(tag, ()))
                opened.close(min(q for t in CLOSED_BY[tag] for q in opened.places.get(t, ())[-1:] if q > scope))
            attrs = page[name.end() : stop]
            mark, style = _boilerplate(tag, attrs, opened.last(("article", "main")) >= 0)
            if attrs.rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            element = self._element(opened.elements[-1], tag, mark, style)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, pos)
                self._text(element, page[pos : end.start() if end else n])
                start = pos = end.end() if end else n
            else:
                opened.push(element, tag)
        self._text(opened.elements[-1], page[start:])

    def _inherited(self, own) -> list[bool]:
        """Whether ``own`` holds for an element or one around it."""
        out: list[bool] = []
        for e in range(len(self.tag)):
            out.append(own(e) or (e > 0 and out[self.parent[e]]))
        return out

    def _summed(self, sizes: dict[int, int]) -> list[int]:
        """The sizes of each element with all that it holds."""
        out = [sizes.get(e, 0) for e in range(len(self.tag))]
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def _settle(self) -> None:
        """Marks by class or id become ``-`` or nothing; ``live`` lists the nodes outside marks."""
        if "~" in self.mark:
            dead = self._inherited(lambda e: self.mark[e] == "-")
            main = self._inherited(lambda e: self.tag[e] in ("article", "main"))
            size: dict[int, int] = {}
            for e, _, raw in self.nodes:
                if not dead[e]:
                    size[e] = size.get(e, 0) + len(raw.strip())
            held = self._summed(size)
            article = self._summed({e: k for e, k in size.items() if main[e]})
            for e, mark in enumerate(self.mark):
                if mark == "~":
                    self.mark[e] = "" if 2 * held[e] > held[0] and article[e] == article[0] else "-"
        dead = self._inherited(lambda e: self.mark[e] == "-")
        self.live = [x for x in self.nodes if not dead[x[0]]]


def _threshold(scores: np.ndarray, sizes: np.ndarray) -> float:
    """Mean score weighted by text, less a part of the weighted deviation."""
    w = sizes / max(1.0, sizes.sum())
    mean = float(scores @ w)
    return mean - SPREAD * float(np.sqrt(((scores - mean) ** 2) @ w)) - 1e-9


def content_paths(tree: PageTree) -> set[int]:
    """The paths whose smoothed, fused ratio passes the page's threshold."""
    order: dict[int, list[float]] = {}
    for e, _, raw in tree.live:
        s = order.setdefault(tree.path[e], [0.0, 0.0, 0.0])
        s[0] += len(raw.strip())
        s[1] += len(_MARKS.findall(raw))
        s[2] += 1
    if not order:
        return set()
    a = np.array(list(order.values()))
    ratios = np.log1p(a[:, :2] / a[:, 2:])

    def smooth(x: np.ndarray) -> np.ndarray:
        padded = np.concatenate([x[:1], x, x[-1:]])
        return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]

    fused = smooth(ratios[:, 0]) * (1 + smooth(ratios[:, 1]))
    limit = _threshold(fused, a[:, 0])
    return {p for p, s in zip(order, fused, strict=True) if s >= limit}


def kept_nodes(tree: PageTree, chosen: set[int]) -> list[tuple[int, int, str]]:
    """The content nodes (of a chosen path), and what stays by its place beside them."""
    count = range(len(tree.tag))
    section, lists = [0], [-1]  # the nearest section, the outermost list
    for e in count[1:]:
        up = tree.parent[e]
        section.append(e if tree.tag[e] in SECTIONS else section[up])
        lists.append(e if lists[up] < 0 and tree.tag[e] in LISTS else lists[up])
    heading = tree._inherited(lambda e: tree.tag[e] in HEADINGS)
    title = tree._inherited(lambda e: tree.tag[e] in TITLES)
    link = tree._inherited(lambda e: tree.tag[e] == "a")

    is_content = {section[e] for e, _, _ in tree.live if tree.path[e] in chosen}
    around = tree._summed(dict.fromkeys(is_content, 1))
    articles = tree._inherited(lambda e: tree.tag[e] == "article" and around[e] > 0)
    titled = {section[e] for e, _, _ in tree.live if heading[e] and around[section[e]] > 0}
    holders = is_content | titled
    # sections with nothing but titles, right before content
    only_titles = {section[e] for e, _, _ in tree.live} - {section[e] for e, _, raw in tree.live if not title[e] and not raw.isspace()}
    before = False
    for e, _, _ in reversed(tree.live):
        if section[e] in only_titles and before:
            holders.add(section[e])
        before = section[e] in holders or articles[e]

    text, linked = {}, {}
    for e, _, raw in tree.live:
        if lists[e] >= 0:
            text[lists[e]] = text.get(lists[e], 0) + len(raw.strip())
            linked[lists[e]] = linked.get(lists[e], 0) + (len(raw.strip()) if link[e] else 0)
    menus = {x for x in text if linked[x] >= LINK_SHARE * text[x]}
    return [x for x in tree.live if articles[x[0]] or (section[x[0]] in holders and lists[x[0]] not in menus)]


def main_text(page: str | None) -> str:
    """The page's content blocks, joined by newlines."""
    tree = PageTree(page or "")
    blocks: dict[int, list[str]] = {}
    for _, block, raw in kept_nodes(tree, content_paths(tree)):
        blocks.setdefault(block, []).append(raw)
    parts = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(p for p in parts if p)


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``main_text``: string, empty if the page has no content."""
    bound_batches(pages.sparkSession)
    rows = pages.drop("main_text")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch[column].to_pylist()]
            yield batch.append_column("main_text", pa.array(texts, pa.string()))

    return rows.mapInArrow(extracted, T.StructType([*rows.schema, T.StructField("main_text", T.StringType())]))
