"""Pages as node tables: elements numbered in document order, each with the last number and the text range of its subtree.

An element's subtree is a range of numbers and its text a range of the page's text, so containment is a comparison
and reading a subtree's text a substring. Only this reading of the markup runs in Python, once per page and in Arrow
batches; everything on top of it is Spark expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without an end tag, elements whose text isn't read, and elements that keep white space.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer", "keygen", "menuitem"}
UNREAD = {"script", "style", "template"}
KEPT = {"pre", "textarea"}
# Elements that don't break a line, elements whose start ends an open paragraph, and what an open one isn't looked for beyond.
FLOWING = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "em", "font", "i", "img", "input", "kbd", "label", "mark", "meta", "q", "s", "samp", "script", "small", "span", "strike", "strong", "style", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "listing", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
SCOPES = {"applet", "button", "caption", "html", "marquee", "object", "table", "td", "template", "th"}
# Items that end an open item of the same kind, with what one isn't looked for beyond.
ITEMS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select", "datalist"})}

# Tags as they mostly are written (attributes quoted or bare, without references), end tags, and what only ends a text.
_CUT = re.compile("(<[^>]*>)")
_BLANK = "[ \\t\\n\\r\\f]"
_VALUE = r"""(?:="([^"<>&]*)"|='([^'<>&]*)'|=([^\s"'<>=&/`]+)(?![^\s>]))?"""
_NAME = r"""[^\s"'<>/=&]+"""
_START = re.compile(rf"<([a-zA-Z][-.a-zA-Z0-9:_]*)((?:{_BLANK}+{_NAME}{_VALUE})*){_BLANK}*(/?)>")
_ATTR = re.compile(rf"{_BLANK}+({_NAME}){_VALUE}")
_END = re.compile(rf"</([a-zA-Z][-.a-zA-Z0-9:_]*){_BLANK}*>")
_BREAK = re.compile(r"(?i)<!doctype html>|<!--(?:[^<>-]|-[^<>-])*-->")

#: Pages that are read before their nodes are handed on, and bytes of these.
SLICE, SLICE_BYTES = 64, 1 << 20
#: ``pre`` and ``last``: numbers of the element and of the last one in it; ``parent``: -1 at the top; the ranges
#: (start, end) of its text in ``raw``, ``spaced`` and ``tight``; how many links (a with href) and anchors lie in it.
NODE = "struct<pre:int,last:int,parent:int,tag:string,attrs:map<string,string>,raw:int,raw_end:int,spaced:int,spaced_end:int,tight:int,tight_end:int,links:int,anchors:int>"
#: ``raw``: the text as it is; ``spaced`` and ``tight``: its pieces, trimmed, joined by a space or by
#: nothing; ``lines``: what would be shown, a line for each block.
PAGE = f"struct<nodes:array<{NODE}>,raw:string,spaced:string,tight:string,lines:string>"
#: The same with the ``marks`` of each element, and without lines.
MARKED = PAGE.replace("anchors:int", "anchors:int,marks:int").replace(",lines:string", "")
#: Of an element's tag and attributes: marks as bits, its own, those of the elements right in it, and those of all in it.
Marks = Callable[[str, dict[str, str]], tuple[int, int, int]]
_FIELDS = ["pre", "last", "parent", "tag", "attrs", "raw", "raw_end", "spaced", "spaced_end", "tight", "tight_end", "links", "anchors"]


class _Reader(HTMLParser):
    """Numbers elements as they open. An end tag closes what is open up to its element; without one it says nothing.

    With ``implied`` a paragraph also ends where a block starts, and an item where the next one does. With ``marks`` elements also
    have their marks, with what comes down to them.
    """

    def __init__(self, implied: bool = False, marks: Marks | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.implied, self.marks = implied, marks
        self.down: list[tuple[int, int]] = [(0, 0)]
        self.shown: list[str] = []
        self.rows: list[list] = []
        self.open: list[int] = []
        self.names: dict[str, int] = {}
        self.held: list[str] = []
        self.texts: tuple[list[str], list[str]] = ([], [])
        self.size = [0, 0, 0]
        self.links = self.anchors = self.unread = 0

    def flush(self) -> None:
        if not self.held:
            return
        text = "".join(self.held)
        self.held = []
        if not text or self.unread:
            return
        if not text.strip(" \t\n\r\f\v") and not any(self.names.get(t) for t in KEPT):
            text = "\n" if "\n" in text else " "
        self.texts[0].append(text)
        self.size[0] += len(text)
        piece = text.strip()
        if piece:
            self.texts[1].append(piece)
            self.size[1] += len(piece) + (self.size[1] > 0)
            self.size[2] += len(piece)
        self.shown.append(" ".join(f"x{text}x".split())[1:-1])

    def imply(self, tag: str) -> None:
        for closes, scope in ([({"p"}, SCOPES)] if tag in BLOCKS else []) + ([ITEMS[tag]] if tag in ITEMS else []):
            if any(self.names.get(t) for t in closes):
                for at in range(len(self.open) - 1, -1, -1):
                    name = self.rows[self.open[at]][3]
                    if name in closes:
                        while len(self.open) > at:
                            self.shut()
                        break
                    if name in scope:
                        break

    def handle_starttag(self, tag: str, attrs: list, closed: bool = False) -> None:
        self.begin(tag, _attributes(attrs), closed)

    def begin(self, tag: str, held: dict[str, str], closed: bool) -> None:
        self.flush()
        if tag not in FLOWING:
            self.shown.append("\n")
        if self.implied:
            self.imply(tag)
        link = tag == "a" and "href" in held
        self.links += link
        self.anchors += tag == "a"
        raw, spaced, tight = self.size
        start = spaced + (spaced > 0)
        row = [len(self.rows), len(self.rows), self.open[-1] if self.open else -1, tag, held, raw, raw, start, start, tight, tight, self.links, self.anchors]
        if self.marks:
            if held.marks is None:
                held.marks = self.marks(tag, held)
            own, inner, below = held.marks
            to_child, to_all = self.down[-1]
            row.append(own | to_child | to_all)
        self.rows.append(row)
        if closed or tag in VOID:
            row[11] = row[12] = 0
        else:
            self.open.append(row[0])
            if self.marks:
                self.down.append((inner, below | to_all))
            self.names[tag] = self.names.get(tag, 0) + 1
            self.unread += tag in UNREAD

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if tag not in FLOWING:
            self.shown.append("\n")
        if self.names.get(tag):
            while self.shut() != tag:
                pass

    def shut(self) -> str:
        row = self.rows[self.open.pop()]
        if self.marks:
            self.down.pop()
        row[1], row[6], row[8], row[10] = len(self.rows) - 1, self.size[0], max(row[7], self.size[1]), self.size[2]
        row[11], row[12] = self.links - row[11], self.anchors - row[12]
        self.names[row[3]] -= 1
        self.unread -= row[3] in UNREAD
        return row[3]

    def handle_data(self, data: str) -> None:
        self.held.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


class _Attributes(dict):
    """Attributes of a tag, and its marks once they were asked for (a process reads pages with one kind of them)."""

    __slots__ = ("marks",)


def _attributes(attrs: list) -> _Attributes:
    held = _Attributes((k, v or "") for k, v in attrs)
    held.marks = None
    if "class" in held:
        held["class"] = " ".join(held["class"].split())
    return held


@lru_cache(1 << 14)
def _mark(text: str) -> tuple | None:
    """(kind, tag, attributes, closed) of a tag that is written plainly, null for any other; pages repeat most of theirs."""
    if m := _END.fullmatch(text):
        return ("end", m[1].lower(), None, False)
    if m := _START.fullmatch(text):
        attrs = [(name.lower(), a or b or c) for name, a, b, c in _ATTR.findall(m[2])] if m[2] else []
        return ("start", m[1].lower(), _attributes(attrs), m[6] == "/")
    return ("break", "", None, False) if _BREAK.fullmatch(text) else None


def _plain(html: str) -> list[tuple] | None:
    """(text, mark after it) in order if all is written plainly, so that the markup parser would find the same; else null. The last has no mark.

    A script or style goes on to its end tag, whatever it holds.
    """
    parts = _CUT.split(html)
    out, unread = [], None
    for text, tag in zip(parts[::2], parts[1::2]):
        if unread:
            if tag.rfind("<"):  # its end may lie in what looks like a tag
                return None
            mark = _mark(tag) if tag.startswith("</") else None
            if not mark or mark[:2] != ("end", unread):
                continue
            text, unread = "", None
        else:
            mark = _mark(tag) if len(tag) < 1000 else _mark.__wrapped__(tag)
            if mark is None or "<" in text:
                return None
            if mark[1] in HTMLParser.CDATA_CONTENT_ELEMENTS and mark[0] == "start" and not mark[3]:
                unread = mark[1]
        out.append((text, mark))
    if unread or "<" in parts[-1]:
        return None
    return [*out, (parts[-1], ("break", "", None, False))]


def _read(html: str, implied: bool, marks: Marks | None = None) -> _Reader:
    """A page that was read. What the markup parser gives up on (a broken declaration) ends the page there."""
    reader = _Reader(implied, marks)
    plain = _plain(html)
    if plain is not None:
        for text, (kind, tag, attrs, closed) in plain:
            if text:
                reader.held.append(unescape(text) if "&" in text else text)
            if kind == "start":
                reader.begin(tag, attrs, closed)
            elif kind == "end":
                reader.handle_endtag(tag)
            else:
                reader.flush()
    else:
        try:
            reader.feed(html)
            reader.close()
        except (AssertionError, ValueError):
            pass
    reader.flush()
    while reader.open:
        reader.shut()
    return reader


def _quick(html: str, marks: Marks) -> tuple[list[list], list[str], list[str]] | None:
    """Rows and texts (as they are, and trimmed pieces) of a page that is written plainly, as ``_Reader`` finds them, in one go; null for any other."""
    parts = _CUT.split(html)
    parts.append("")
    rows, texts, pieces, names = [], [], [], {}
    opened, down = [], [(-1, 0, 0)]
    raw = spaced = tight = links = anchors = unread = 0
    script = None
    for at in range(0, len(parts), 2):
        text, tag = parts[at], parts[at + 1]
        if script:
            if not tag or tag.rfind("<"):
                return None
            mark = _mark(tag) if tag.startswith("</") else None
            if not mark or mark[0] != "end" or mark[1] != script:
                continue
            text, script = "", None
        else:
            mark = (_mark(tag) if len(tag) < 1000 else _mark.__wrapped__(tag)) if tag else ("break", "", None, False)
            if mark is None or "<" in text:
                return None
        if text and not unread:
            if "&" in text:
                text = unescape(text)
            piece = text.strip()
            if piece:
                pieces.append(piece)
                spaced += len(piece) + (spaced > 0)
                tight += len(piece)
            elif not text.strip(" \t\n\r\f\v") and not any(names.get(t) for t in KEPT):
                text = "\n" if "\n" in text else " "
            texts.append(text)
            raw += len(text)
        kind, name, held, closed = mark
        if kind == "start":
            if held.marks is None:
                held.marks = marks(name, held)
            own, inner, below = held.marks
            parent, to_child, to_all = down[-1]
            if name == "a":
                links += "href" in held
                anchors += 1
            start, n = spaced + (spaced > 0), len(rows)
            row = [n, n, parent, name, held, raw, raw, start, start, tight, tight, links, anchors, own | to_child | to_all]
            rows.append(row)
            if closed or name in VOID:
                row[11] = row[12] = 0
            else:
                opened.append(row)
                down.append((n, inner, below | to_all))
                names[name] = names.get(name, 0) + 1
                if name in UNREAD:
                    unread += 1
                    if name in HTMLParser.CDATA_CONTENT_ELEMENTS:
                        script = name
        elif kind == "end" and names.get(name):
            shut = None
            while shut != name:
                row = opened.pop()
                down.pop()
                shut = row[3]
                row[1], row[6], row[8], row[10], row[11], row[12] = len(rows) - 1, raw, max(row[7], spaced), tight, links - row[11], anchors - row[12]
                names[shut] -= 1
                unread -= shut in UNREAD
    if script:
        return None
    for row in opened:
        row[1], row[6], row[8], row[10], row[11], row[12] = len(rows) - 1, raw, max(row[7], spaced), tight, links - row[11], anchors - row[12]
    return rows, texts, pieces


def read_marked(pages: list[str | None], marks: Marks) -> pa.Array:
    """Pages as ``MARKED``; null for a null one."""
    read = []
    for p in pages:
        own = None if p is None else _quick(p, marks)
        if p is not None and own is None:
            reader = _read(p, False, marks)
            own = reader.rows, *reader.texts
        read.append(own)
    text = lambda join: pa.array([join(r) if r else None for r in read], pa.string())
    texts = [text(lambda r: "".join(r[1])), text(lambda r: " ".join(r[2])), text(lambda r: "".join(r[2]))]
    return pa.StructArray.from_arrays([_nodes([r and r[0] for r in read], [*_FIELDS, "marks"]), *texts], ["nodes", "raw", "spaced", "tight"], mask=pa.array([r is None for r in read], pa.bool_()))


def _nodes(each: list[list[list] | None], fields: list[str]) -> pa.Array:
    """The nodes of pages, from their rows. Columns are filled for all pages at once."""
    rows = list(chain.from_iterable(r for r in each if r))
    columns = dict(zip(fields, zip(*rows))) if rows else {f: () for f in fields}
    attrs = columns["attrs"]
    offsets = lambda sizes: pa.array(list(accumulate(sizes, initial=0)), pa.int32())
    flat = {f: pa.array(c, pa.string() if f == "tag" else pa.int32()) for f, c in columns.items() if f != "attrs"}
    flat["attrs"] = pa.MapArray.from_arrays(offsets(map(len, attrs)), pa.array(list(chain.from_iterable(attrs)), pa.string()), pa.array(list(chain.from_iterable(a.values() for a in attrs)), pa.string()))
    return pa.ListArray.from_arrays(offsets(len(r) if r else 0 for r in each), pa.StructArray.from_arrays([flat[f] for f in fields], fields))


def read_pages(pages: list[str | None], implied: bool = False) -> pa.Array:
    """Pages as ``PAGE``; null for a null one."""
    read = [None if p is None else _read(p, implied) for p in pages]
    nodes = _nodes([r.rows if r else None for r in read], _FIELDS)
    text = lambda join: pa.array([join(r) if r else None for r in read], pa.string())
    texts = [text(lambda r: "".join(r.texts[0])), text(lambda r: " ".join(r.texts[1])), text(lambda r: "".join(r.texts[1])), text(lambda r: "".join(r.shown))]
    return pa.StructArray.from_arrays([nodes, *texts], ["nodes", "raw", "spaced", "tight", "lines"], mask=pa.array([r is None for r in read], pa.bool_()))


def page(html: Column, implied: bool = False, marks: Marks | None = None) -> Column:
    """``PAGE`` of each html, with ``marks`` ``MARKED``; null for null. With ``implied`` paragraphs and items end where the next block or item starts."""

    @F.arrow_udf(MARKED if marks else PAGE)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for part in slices(pages):
                yield read_marked(part.to_pylist(), marks) if marks else read_pages(part.to_pylist(), implied)

    return parsed(html)


def slices(pages: pa.Array) -> Iterator[pa.Array]:
    """Pages in order, a few at a time, so that only those are held as Python objects: ``SLICE`` at most, or as many as have ``SLICE_BYTES``."""
    at = 0
    while at < len(pages):
        n = min(SLICE, len(pages) - at)
        while n > 1 and pages[at : at + n].nbytes > SLICE_BYTES:
            n = -(-n // 2)
        yield pages[at : at + n]
        at += n


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where ``body`` uses it for every element of an array.

    A column of an earlier projection gives no such promise: the optimizer may put its expression
    where it is used, inside a lambda too.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def attr(node: Column, name: str) -> Column:
    """An attribute of a node, empty where it isn't there."""
    return F.coalesce(node["attrs"][name], F.lit(""))


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def text_of(spaced: Column, node: Column) -> Column:
    """A node's text, its pieces trimmed and joined by a space; ``spaced`` is that of the page."""
    return cut(spaced, node["spaced"], node["spaced_end"])


def below(nodes: Column, node: Column) -> Column:
    """The elements inside a node, in document order."""
    return F.slice(nodes, node["pre"] + 2, node["last"] - node["pre"])


def whole(nodes: Column, node: Column) -> Column:
    """A node and the elements inside it, in document order."""
    return F.slice(nodes, node["pre"] + 1, node["last"] - node["pre"] + 1)


def outermost(nodes: Column) -> Column:
    """Of nodes in document order, the ranges (pre, last) of those that lie in no other: a running scan over intervals."""
    spans = F.transform(nodes, lambda n: F.struct(n["pre"].alias("pre"), n["last"].alias("last")))
    start = F.filter(spans, lambda s: F.lit(False))
    return F.aggregate(spans, start, lambda seen, s: F.when(F.coalesce(F.try_element_at(seen, F.lit(-1))["last"] >= s["last"], F.lit(False)), seen).otherwise(F.concat(seen, F.array(s))))


def inside(ranges: Column, node: Column) -> Column:
    """Whether a node is or lies in one of the ranges."""
    return F.exists(ranges, lambda r: (r["pre"] <= node["pre"]) & (node["pre"] <= r["last"]))


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per element: key, ``pre``, ``last``, ``parent``, ``tag``, ``attrs`` and ``text`` (its subtree's).

    Null and empty pages have no elements; unclosed elements end with what is around them, end tags
    of elements that aren't open are passed over. Pages are read whole. Repeated keys give the
    elements of each of their rows; other columns are left out.
    """
    read = pages.select(F.col(key), page(F.col(html)).alias("_p"))
    rows = read.select(key, F.col("_p.spaced").alias("_s"), F.explode("_p.nodes").alias("_n"))
    return rows.select(key, *[F.col(f"_n.{c}").alias(c) for c in ("pre", "last", "parent", "tag", "attrs")], text_of(F.col("_s"), F.col("_n")).alias("text"))
