"""Pages as trees: html becomes a table of nodes in one pass, and what a reader sees of it.

``parsed()`` gives a row a page with the array ``nodes``: of each element its number in document order (``i``), its
parent's, that of its last descendant, its tag, attributes, and where its text begins and ends in ``visible``, the page's
visible text with white space collapsed. So an element's subtree is a range of numbers and its text a substring, and
questions about pages are expressions over one row. ``graph`` has the nodes that its JSON-LD declares, with their types and
what they say as JSON texts; ``types`` all types in it, ``modified`` the first date of change, ``stated`` the first date of any kind, ``blocks`` how many blocks
can be read. ``node_table()`` has a row a node, for joins.

Tags, attributes, raw text and implied ends follow the html standard as far as they decide which text an element holds.
Elements whose text no reader sees (code, embeds, those with the attribute ``hidden``) have ``shown`` false, as have
their descendants; ``blank`` says that an element holds no text at all, seen or not; a framework's streaming buffer, a ``div`` right in the body, is hidden for an instant only and counts
as its contents. Elements deeper than 512 levels have no descendants. Null html is an empty page; html of any length is
read whole; an empty table gives no rows. Columns passed on keep their names, so they must not be called as those added.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitelode.sources import jsonld

#: Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp textarea title".split())
ESCAPED_RAW = frozenset(["textarea", "title"])
HEAD = frozenset("title meta link script style base noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
BREAKS_LINE = frozenset(
    "br hr p div li ul ol dl dt dd table caption thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 hgroup header footer section article aside nav main address blockquote figure figcaption form fieldset legend pre details summary dialog menu".split()
)
UNSEEN = frozenset("script style noscript template svg iframe object canvas audio video".split())
PROSE = frozenset("p li blockquote pre dt dd figcaption summary".split())
LOOSE = frozenset("div td th".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A start tag ends the open elements named, up to the nearest of the others.
_CELL, _GROUP = ("td", "th"), ("thead", "tbody", "tfoot")
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "table", "td", "th", "section", "article", "main", "body")), "dt": (("dt", "dd"), ("dl", "table", "td", "th", "body")), "dd": (("dt", "dd"), ("dl", "table", "td", "th", "body")),
    "tr": (("tr",), ("table", "template")), "td": (_CELL, ("tr", "table", "template")), "th": (_CELL, ("tr", "table", "template")),
    "thead": (_GROUP, ("table", "template")), "tbody": (_GROUP, ("table", "template")), "tfoot": (_GROUP, ("table", "template")),
    "option": (("option",), ("select", "datalist", "optgroup", "body")), "optgroup": (("option", "optgroup"), ("select", "body")), "button": (("button",), ("table", "td", "th", "form", "body")), "a": (("a",), ("table", "td", "th", "object", "body")),
}
_SCOPE = ("table", "td", "th", "caption", "button", "object", "template", "body")
_DEEPEST = 512
_SPACES = re.compile("[\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_CLOSES = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=/>][^\s=/>]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_STREAMED = re.compile(r"(?:\S*[^A-Za-z])?S:\d+")
_NODE = "i int, parent int, last int, tag string, attrs map<string,string>, start int, stop int, shown boolean, blank boolean, data string"
_GRAPH = "graph array<struct<types:array<string>,node:map<string,string>>>, types array<string>, modified string, stated string, blocks int"
SCHEMA = f"visible string, paragraphs array<string>, root int, body int, nodes array<struct<{', '.join(f.replace(' ', ':', 1) for f in _NODE.split(', '))}>>, {_GRAPH}"
COLUMNS = ("visible", "paragraphs", "root", "body", "nodes", "graph", "types", "modified", "stated", "blocks")


class Page:
    """One pass over a page's html. Lists by node: tag, attrs, parent, last, start, stop, shown, data."""

    def __init__(self, html: str):
        self.tag: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.start: list[int] = []
        self.stop: list[int] = []
        self.shown: list[bool] = []
        self.data: list[str | None] = []
        self.prose: list[int] = []  # the innermost block of prose that holds a node's text, -1 if none does
        self.loose: list[int] = []
        self.pieces: list[tuple[int, str]] = []
        self.length, self.blank = 0, True
        self.raw: list[str] = []  # all text, seen or not, as it stands
        self.raw_at, self.ink = 0, 0
        self.raw_span: list[tuple[int, int]] = []
        self.inked: list[int] = []  # pieces of text that aren't blank, before a node and inside it
        self.stack: list[int] = []
        self.open: Counter = Counter()
        self.push("html", {})
        self.head = self.body = -1
        self.read(html)
        if self.body < 0:
            self.begin_body({})
        while self.stack:
            self.pop()

    # -- text

    def read_text(self, text: str) -> None:
        self.raw.append(text)
        self.raw_at += len(text)
        self.ink += bool(_SPACES.sub("", text))
        self.say(text)

    def say(self, text: str) -> None:
        at = self.stack[-1]
        if not self.shown[at]:
            return
        text = _SPACES.sub(" ", text)
        if self.blank and text.startswith(" "):
            text = text[1:]
        if text:
            self.pieces.append((at, text))
            self.length += len(text)
            self.blank = text.endswith(" ")

    # -- elements

    def push(self, tag: str, attrs: dict[str, str]) -> int:
        up = self.stack[-1] if self.stack else -1
        shown = tag not in UNSEEN and (up < 0 or self.shown[up])
        if shown and "hidden" in attrs:
            streamed = tag == "div" and up >= 0 and up == self.body and _STREAMED.fullmatch(attrs.get("id", ""))
            shown, tag = bool(streamed), "#streamed" if streamed else tag
        if shown and tag in BREAKS_LINE and self.stack:
            self.say(" ")
        i = len(self.tag)
        for column, value in ((self.tag, tag), (self.attrs, attrs), (self.parent, up), (self.last, i), (self.start, self.length), (self.stop, self.length), (self.shown, shown), (self.data, None), (self.raw_span, (self.raw_at, self.raw_at)), (self.inked, self.ink)):
            column.append(value)
        self.prose.append(i if tag in PROSE else self.prose[up] if up >= 0 else -1)
        self.loose.append(i if tag in LOOSE else self.loose[up] if up >= 0 else -1)
        self.stack.append(i)
        self.open[tag] += 1
        return i

    def closed(self, i: int) -> None:
        self.last[i], self.stop[i] = len(self.tag) - 1, self.length
        self.raw_span[i], self.inked[i] = (self.raw_span[i][0], self.raw_at), self.ink - self.inked[i]
        self.open[self.tag[i]] -= 1

    def pop(self) -> None:
        i = self.stack.pop()
        self.closed(i)
        if self.stack and self.shown[i] and self.tag[i] in BREAKS_LINE:
            self.say(" ")

    def nearest(self, tags: tuple[str, ...], until: tuple[str, ...]) -> int:
        """The place in the stack of the innermost of these elements, or 0 if there is none before one of the others."""
        if any(self.open[t] for t in tags):
            for at in range(len(self.stack) - 1, 0, -1):
                tag = self.tag[self.stack[at]]
                if tag in tags:
                    return at
                if tag in until:
                    break
        return 0

    def end(self, at: int) -> None:
        while at and len(self.stack) > at:
            self.pop()

    def begin_body(self, attrs: dict[str, str]) -> None:
        self.end(1)
        self.body = self.push("body", attrs)

    def begin(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("html", "body", "head"):
            if tag == "html" or tag == "body" and self.body >= 0:
                known = self.attrs[0 if tag == "html" else self.body]
                known |= {k: v for k, v in attrs.items() if k not in known}
            elif tag == "body":
                self.begin_body(attrs)
            elif self.head < 0 and self.body < 0:
                self.head = self.push("head", attrs)
            return
        if self.body < 0:
            if tag not in HEAD:
                self.begin_body({})
            elif self.head < 0:
                self.head = self.push("head", {})
        if tag in ENDS_PARAGRAPH:
            self.end(self.nearest(("p",), _SCOPE))
        if tag in ENDS:
            self.end(self.nearest(*ENDS[tag]))
        if tag in HEADINGS and self.tag[self.stack[-1]] in HEADINGS:
            self.pop()
        self.push(tag, attrs)
        foreign = closed and (tag in ("svg", "math") or self.open["svg"] or self.open["math"])
        if tag in VOID or foreign or len(self.stack) > _DEEPEST:
            self.pop()

    def finish(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head >= 0 and self.body < 0:
                self.end(1)
            return
        if tag in HEADINGS:
            self.end(self.nearest(HEADINGS, _SCOPE))
            return
        at = self.nearest((tag,), ("body",) if tag != "p" else _SCOPE)
        if not at:
            if tag in ("p", "br"):
                self.begin(tag, {}, False)
                if tag == "p":
                    self.pop()
            return
        if tag in FORMATTING and any(self.tag[i] in ENDS_PARAGRAPH for i in self.stack[at:]):
            self.closed(self.stack.pop(at))  # what was opened inside goes on
        else:
            self.end(at)

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            found = _TOKEN.search(html, at)
            self.text(html[at : found.start() if found else end])
            if not found:
                break
            at = found.end()
            if (name := found[2]) is None or not found[4]:  # a comment and the like, or a tag that the end cuts off
                continue
            tag = name.lower()
            if found[1]:
                self.finish(tag)
                continue
            attrs: dict[str, str] = {}
            for k, *values in _ATTRIBUTE.findall(found[3]) if found[3] else ():
                value = next((v for v in values if v), "")
                attrs.setdefault(k.lower(), unescape(value) if "&" in value else value)
            self.begin(tag, attrs, found[3].endswith("/"))
            if tag in RAW and not self.open["svg"]:
                close = _CLOSES[tag].search(html, at)
                raw = html[at : close.start() if close else end]
                self.read_text(unescape(raw) if tag in ESCAPED_RAW else raw)
                if tag == "script" and "json" in attrs.get("type", "").lower():
                    self.data[self.stack[-1]] = raw
                if self.tag[self.stack[-1]] == tag:
                    self.pop()
                at = html.find(">", close.end()) + 1 if close else end
                at = at or end

    def text(self, text: str) -> None:
        if not text:
            return
        if self.body < 0:
            if not text.strip():
                return
            self.begin_body({})
        self.read_text(unescape(text) if "&" in text else text)

    # -- what is asked of the whole

    def raw_text(self, i: int, whole: str) -> str:
        """All text of an element. whole: the texts of the page in one."""
        return whole[slice(*self.raw_span[i])]

    def linked_data(self) -> list[str]:
        """The JSON-LD blocks."""
        return [d for d, a in zip(self.data, self.attrs, strict=True) if d and a.get("type", "").strip().lower() == "application/ld+json"]

    def content_root(self) -> int:
        """The first element that holds the page's own copy, else the body."""
        for i, (tag, attrs, shown) in enumerate(zip(self.tag, self.attrs, self.shown, strict=True)):
            if shown and (tag in ("main", "article") or attrs.get("role") == "main" or attrs.get("id") in ("main", "content") or "main-content" in attrs.get("class", "").split()):
                return i
        return self.body

    def paragraphs(self, root: int) -> list[str]:
        """Blocks of prose, each without those inside it; else looser blocks; else all there is."""
        last = self.last[root]
        inside = [(at, text) for at, text in self.pieces if root <= at <= last]
        for owner in (self.prose, self.loose):
            blocks: dict[int, list[str]] = {}
            for at, text in inside:
                if owner[at] > root:
                    blocks.setdefault(owner[at], []).append(text)
            found = [t for _, parts in sorted(blocks.items()) if (t := _SPACES.sub(" ", "".join(parts)).strip(" "))]
            if found:
                return found
        whole = "".join(t for _, t in inside).strip(" ")
        return [whole] if whole else []


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def _columns(pages: list[Page]) -> list[pa.Array]:
    sizes = [len(p.tag) for p in pages]
    flat = lambda name, kind: pa.array([v for p in pages for v in getattr(p, name)], kind)
    attrs = [a for p in pages for a in p.attrs]
    maps = pa.MapArray.from_arrays(
        pa.array(np.cumsum([0, *map(len, attrs)]), pa.int32()), pa.array([k for a in attrs for k in a], pa.string()), pa.array([v for a in attrs for v in a.values()], pa.string())
    )
    number = pa.array([i for n in sizes for i in range(n)], pa.int32())
    fields = [number, flat("parent", pa.int32()), flat("last", pa.int32()), flat("tag", pa.string()), maps, flat("start", pa.int32()), flat("stop", pa.int32()), flat("shown", pa.bool_()), pa.array([n == 0 for p in pages for n in p.inked], pa.bool_()), flat("data", pa.string())]
    nodes = pa.StructArray.from_arrays(fields, [f.split(" ")[0] for f in _NODE.split(", ")])
    roots = [p.content_root() for p in pages]
    copy = [p.paragraphs(r) for p, r in zip(pages, roots, strict=True)]
    return [
        pa.array(["".join(t for _, t in p.pieces) for p in pages], pa.string()), _lists([len(c) for c in copy], pa.array([t for c in copy for t in c], pa.string())),
        pa.array(roots, pa.int32()), pa.array([p.body for p in pages], pa.int32()), _lists(sizes, nodes), *_declared(pages),
    ]


def _declared(pages: list[Page]) -> list[pa.Array]:
    """What JSON-LD says: the declared nodes, all types, the date of change, and how many blocks can be read."""
    values = [jsonld.read(p.linked_data())[0] for p in pages]
    nodes = [jsonld.declared(v) for v in values]
    kinds, says = [[jsonld.clean(t) for t in jsonld.types_of(n)] for page in nodes for n in page], [jsonld.said(n) for page in nodes for n in page]
    maps = pa.MapArray.from_arrays(pa.array(np.cumsum([0, *map(len, says)]), pa.int32()), pa.array([k for s in says for k in s], pa.string()), pa.array([v for s in says for v in s.values()], pa.string()))
    graph = pa.StructArray.from_arrays([_lists([len(k) for k in kinds], pa.array([t for k in kinds for t in k], pa.string())), maps], ["types", "node"])
    types = [jsonld.all_types(v) for v in values]
    return [
        _lists([len(n) for n in nodes], graph), _lists([len(t) for t in types], pa.array([t for page in types for t in page], pa.string())),
        pa.array([jsonld.modified(v) for v in values], pa.string()), pa.array([jsonld.stated(v) for v in values], pa.string()), pa.array([len(v) for v in values], pa.int32()),
    ]


def _parse(batches: Iterator[pa.RecordBatch], at: int, keep: list[int], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            b = batch.slice(lo, rows)
            columns = [b.column(i) for i in keep]
            names = [b.schema.names[i] for i in keep]
            yield pa.RecordBatch.from_arrays([*columns, *_columns([Page(h or "") for h in b.column(at).to_pylist()])], [*names, *COLUMNS])


def parsed(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns kept, then visible, paragraphs, root (the node of the page's own copy), body and nodes."""
    rows = pages.select(*keep, F.col(html).alias("_html"))
    kept = StructType([rows.schema[c] for c in keep])
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(lambda it: _parse(it, len(keep), list(range(len(keep)))), f"{declared}, {SCHEMA}")


def node_table(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """A row a node, with its text if it is shown: key, i, parent, last, tag, attrs, shown, data, text."""
    rows = pages.select(key, "visible", F.explode("nodes").alias("n"))
    return rows.select(key, "n.i", "n.parent", "n.last", "n.tag", "n.attrs", "n.shown", "n.data", text(F.col("n")).alias("text"))


def text(node: Column, visible: str = "visible") -> Column:
    """The visible text of an element."""
    return F.trim(F.substring(F.col(visible), node["start"] + 1, node["stop"] - node["start"]))


def root(nodes: str = "nodes") -> Column:
    return F.get(nodes, F.col("root"))


def main_content() -> Column:
    """The text of the page's own copy."""
    return text(root())


def all_text() -> Column:
    """All visible text of the body."""
    return text(F.get("nodes", F.col("body")))


def elements(*tags: str, nodes: str = "nodes") -> Column:
    """All elements of these tags, shown or not."""
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def in_content(condition, nodes: str = "nodes") -> Column:
    """The shown elements in the page's own copy that meet a condition."""
    inside = lambda n: n["shown"] & (n["i"] > F.col("root")) & (n["i"] <= root(nodes)["last"])
    return F.filter(nodes, lambda n: inside(n) & condition(n))


def texts(found: Column) -> Column:
    """The texts of elements, without empty ones."""
    return F.filter(F.transform(found, lambda n: text(n)), lambda t: t != "")
