"""Layout-aware rendering of web pages: a tree builder with implied tags, then all visible text.

The tree builder closes and opens elements that HTML lets authors leave out. The renderer leaves out
what a browser doesn't show and keeps what layout says: blocks on lines of their own, paragraphs
parted by a blank line, list items with marks and indent, table cells in aligned columns,
preformatted text as written.
"""

from __future__ import annotations

import re
import sys
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import named

# Fixed values of HTML: element names by what the parser or the layout does with them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset(
    """head script noscript style template title meta link base noembed noframes iframe object audio video canvas datalist param source track area map rp
    desc defs metadata symbol clippath mask pattern marker annotation annotation-xml""".split()
)
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td text tfoot th thead tr caption ul""".split()
)
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 ol pre table ul dir menu fieldset".split())
CLOSES_P = BLOCK - frozenset("body html tbody td text tfoot th thead tr caption option optgroup legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends these open elements, if none of the barriers lies between.
ENDED_BY = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset("select datalist".split())),
    "td": (frozenset(["td", "th"]), frozenset("tr table".split())),
    "th": (frozenset(["td", "th"]), frozenset("tr table".split())),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "tbody": (frozenset("tr td th tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("tr td th tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tr td th tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
SCOPE = frozenset("html table td th caption button object template".split())

#: A quote opens a quoted value only after an equals sign; anywhere else it is part of a name or value.
_TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:-->|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z))", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_HIDING_STYLE = re.compile(r"(?:\A|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACES = re.compile("[ \t\n\r\f]+")
#: Parts of a table that hold cells only; what else stands in them is moved out.
_ROW_GROUPS = frozenset("tbody thead tfoot".split())
_CELL_PLACES = _ROW_GROUPS | frozenset(["table", "tr"])
_PLACE_ENDS = _CELL_PLACES | frozenset("td th caption html template".split())
_SELF_CLOSED = re.compile(r"(?<![^\s\"'/])/\Z|(?:\A|\s)[^\s=\"']+/\Z")
_HEAD_ONLY = frozenset("base link meta title style script template noscript".split())


#: What an opening tag may end, by kind: (names, barriers). The first kind is the open paragraph.
_KINDS = list(dict.fromkeys([(frozenset(["p"]), SCOPE), *ENDED_BY.values()]))
_KIND_OF = {name: _KINDS.index(kind) for name, kind in ENDED_BY.items()}
_IN_A_KIND = frozenset().union(*[names | barriers for names, barriers in _KINDS])
#: An end tag doesn't reach beyond these.
_FLOORS = frozenset("table td th caption".split())


class Element:
    """ends holds, for each kind, the outermost open element that a tag of the kind would end here.

    place is the nearest part of a table around it, floor the depth of the nearest of _FLOORS: with these
    no tag has to look at its ancestors, however deep they are.
    """

    __slots__ = ("attributes", "children", "depth", "ends", "floor", "foreign", "name", "parent", "place")

    def __init__(self, name: str, attributes: dict[str, str], parent: Element | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Element | str] = []
        if parent is None:
            self.depth, self.floor, self.foreign, self.place, self.ends = 0, -1, False, self, (None,) * len(_KINDS)
            return
        self.depth = parent.depth + 1
        self.floor = self.depth if name in _FLOORS else parent.floor
        self.foreign = parent.foreign or name in ("svg", "math")
        self.place = self if name in _PLACE_ENDS else parent.place
        self.ends = parent.ends
        if name in _IN_A_KIND:
            self.ends = tuple(None if name in barriers else end or (self if name in names else None) for (names, barriers), end in zip(_KINDS, parent.ends, strict=True))


class TreeBuilder:
    """Elements of a page in a tree; never fails, whatever the tags."""

    def __init__(self):
        self.root = Element("#root", {}, None)
        self.at = self.root
        self.opened: dict[str, list[Element]] = {}  # by name, the innermost last

    def _close_up_to(self, element: Element) -> None:
        while self.at is not self.root:
            last = self.at
            self.opened[last.name].pop()
            self.at = last.parent
            if last is element:
                break

    def _close_inside(self, element: Element) -> None:
        while self.at is not element:
            self._close_up_to(self.at)

    def open(self, name: str, attributes: dict[str, str]) -> None:
        if name in CLOSES_P and (open_p := self.at.ends[0]) is not None:
            self._close_up_to(open_p)
        if name in HEADINGS and self.at.name in HEADINGS:
            self._close_up_to(self.at)
        if (name in ("td", "th", "tr", "caption", "colgroup") or name in _ROW_GROUPS) and self.at.place.name in _CELL_PLACES:
            self._close_inside(self.at.place)  # ends what stands between rows or cells
        if name in _KIND_OF and (ended := self.at.ends[_KIND_OF[name]]) is not None:
            self._close_up_to(ended)
        if name not in _HEAD_ONLY and name not in ("head", "html") and self.at.name == "head":
            self._close_up_to(self.at)
        if name in ("td", "th") and self.at.name in ("table", "tbody", "thead", "tfoot"):
            self._push("tr", {})
        if name in ("html", "body") and self.opened.get(name):
            same = self.opened[name][0]
            same.attributes = attributes | same.attributes
            return
        self._push(name, attributes)
        if name == "form" and self.at.parent is not None and self.at.parent.name in _CELL_PLACES:
            self._close_up_to(self.at)  # holds nothing there

    def in_foreign(self) -> bool:
        return self.at.foreign

    def _push(self, name: str, attributes: dict[str, str]) -> None:
        child = Element(name, attributes, self.at)
        self.at.children.append(child)
        if name not in VOID:
            self.at = child
            self.opened.setdefault(name, []).append(child)

    def close(self, name: str) -> None:
        if name == "br":
            return self.open("br", {})
        floor = -1 if name in SCOPE or name in ("body", "html") else self.at.floor
        same = [self.opened[n][-1] for n in (HEADINGS if name in HEADINGS else (name,)) if self.opened.get(n)]
        innermost = max(same, key=lambda e: e.depth, default=None)
        if innermost is not None and innermost.depth > floor:
            self._close_up_to(innermost)
        elif name == "p":
            self.open("p", {})
            self._close_up_to(self.at)

    def text(self, text: str) -> None:
        if self.at.name == "head" and text.strip(" \t\n\r\f"):
            self._close_up_to(self.at)
        self.at.children.append(text)


def parse(html: str) -> Element:
    builder, at, end = TreeBuilder(), 0, len(html)
    while at < end:
        tag = _TAG.search(html, at)
        if tag is None:
            builder.text(unescape(html[at:]))
            break
        if tag.start() > at:
            builder.text(unescape(html[at : tag.start()]))
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            builder.close(name)
            continue
        attributes: dict[str, str] = {}
        if tag[3]:
            for a in _ATTRIBUTE.finditer(tag[3]):
                attributes.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        foreign = tag[3].endswith("/") and _SELF_CLOSED.search(tag[3]) and (name in ("svg", "math") or builder.in_foreign())
        builder.open(name, attributes)
        if foreign:
            if builder.at.name == name:
                builder._close_up_to(builder.at)
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop = close.start() if close else end
            builder.text(unescape(html[at:stop]) if name in ("title", "textarea") else html[at:stop])
            at = stop
    return builder.root


def visible(e: Element) -> bool:
    if e.name in HIDDEN:
        return False
    a = e.attributes
    if not a:
        return e.name != "dialog"
    if e.name == "dialog" and "open" not in a:
        return False
    if "hidden" in a or e.name == "input" and a.get("type", "").lower() == "hidden":
        return False
    return not ("style" in a and _HIDING_STYLE.search(a["style"]))


class _Lines:
    """Text laid out in lines: spaces collapse, block edges break lines, blank lines don't add up."""

    def __init__(self, indent: str = ""):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indent = indent
        self.marks: list[tuple[int, str]] = []  # of items whose first line is still to come, and where they stand
        self.items = 0  # items that are open
        self.numbered: dict[int, int] = {}  # the next number of each ordered list

    def write(self, text: str) -> None:
        words = _SPACES.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words) and bool(self.line)
            return
        if self.line and (self.space or words[0] == " "):
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def end_line(self) -> None:
        if self.line:
            self._put("".join(self.line))
            self.line = []
        self.space = False

    def _put(self, text: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        indent = self.indent
        for at, mark in self.marks:
            indent = indent[:at] + mark + indent[at + len(mark) :]
        self.marks = []
        self.lines.append((indent + text).rstrip(" "))

    def broken(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines and not self.blank:
            self.blank = True

    def apart(self) -> None:
        self.end_line()
        self.blank = True

    def literal(self, line: str) -> None:
        self.end_line()
        self._put(line)


def _rows_of(table: Element, group: int = 0):
    """(row group, cells) of each row; the rows of a table outside any group are one."""
    for k, child in enumerate(table.children):
        if isinstance(child, Element) and visible(child):
            if child.name == "tr":
                yield group, [c for c in child.children if isinstance(c, Element) and c.name in ("td", "th") and visible(c)]
            elif child.name in _ROW_GROUPS:
                yield from _rows_of(child, k + 1)


def _strays(part: Element):
    """What stands in a table outside its cells and captions, in order; browsers move it out of the table."""
    for child in part.children:
        if isinstance(child, str):
            yield child
        elif child.name == "tr" or child.name in _ROW_GROUPS or child.name == "colgroup":
            yield from _strays(child)
        elif child.name == "caption" and part.name == "table" or child.name == "col" or child.name in ("td", "th") and part.name == "tr":
            continue
        else:
            yield child


def _span(cell: Element, of: str = "colspan", most: int = 1000) -> int:
    value = cell.attributes.get(of, "1").strip()
    span = int(value) if value.isdecimal() and len(value) < 6 else 1
    return most if of == "rowspan" and span == 0 else min(max(span, 1), most)


def _table(table: Element, out: _Lines) -> None:
    """Cells in columns as wide as their widest line, two spaces apart; cells may hold several lines.

    A cell over several rows stands in its first row, and the rows below leave its columns free.
    """
    rows: list[list[tuple[int, list[str]]]] = []
    widths: dict[int, int] = {}
    free_after: dict[int, int] = {}  # column: the first row that may use it
    last_group = 0
    for nth, (group, cells) in enumerate(_rows_of(table)):
        if group != last_group:
            free_after, last_group = {}, group
        row, column = [], 0
        for cell in cells:
            while free_after.get(column, 0) > nth:
                column += 1
            lines = render_lines(cell)
            row.append((column, lines))
            if (span := _span(cell)) == 1:  # a cell over several columns widens none
                widths[column] = max(widths.get(column, 0), *(len(x) for x in lines), 0)
            if (down := _span(cell, "rowspan", 65534)) > 1:
                free_after |= dict.fromkeys(range(column, column + span), nth + down)
            column += span
        rows.append(row)
    left, edge = {}, 0
    for column in sorted(widths):
        left[column] = edge
        edge += widths[column] + 2 if widths[column] else 0
    for row in rows:
        for k in range(max((len(lines) for _, lines in row), default=0)):
            text = ""
            for column, lines in row:
                if k < len(lines) and lines[k]:
                    text = text.ljust(left.get(column, edge)) + ("  " if text and len(text) >= left.get(column, edge) else "") + lines[k]
            out.literal(text)


def _walk(node: Element, out: _Lines, pre: bool) -> None:
    # an explicit stack: pages nest deeper than Python's calls may
    stack: list = [("children", iter(node.children), pre, None)]
    while stack:
        kind, rest, pre, leave = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if leave:
                leave()
            continue
        if isinstance(child, str):
            if pre:
                parts = child.replace("\r\n", "\n").split("\n")
                for k, part in enumerate(parts):
                    if k:
                        out._put("".join(out.line))
                        out.line = []
                    if part:
                        out.line.append(part)
            else:
                out.write(child)
            continue
        if not visible(child):
            continue
        name = child.name
        if name == "br":
            out.broken()
        elif name == "hr":
            out.apart()
        elif name == "img":
            if child.attributes.get("alt", "").strip():
                out.write(child.attributes["alt"])
        elif name == "table":
            out.apart()
            before, after = Element("div", {}, child.parent), Element("div", {}, child.parent)
            for stray in _strays(child):
                (after if isinstance(stray, Element) and stray.name == "table" else before).children.append(stray)
            for line in render_lines(before):
                out.literal(line)
            for caption in child.children:
                if isinstance(caption, Element) and caption.name == "caption" and visible(caption):
                    for line in render_lines(caption):
                        out.literal(line)
            _table(child, out)
            for line in render_lines(after):
                out.literal(line)
            out.apart()
        elif name in ("ul", "ol", "menu", "dir"):
            _list(child, out, stack, pre)
        elif name == "li":
            _item(child, out, stack, pre)
        elif name in BLOCK or name == "pre":
            edge = out.apart if name in SPACED else out.end_line
            indent = "  " if name in ("blockquote", "dd") else ""
            edge()
            before = out.indent
            out.indent += indent
            if name == "pre" and child.children and isinstance(child.children[0], str):
                child.children[0] = child.children[0].removeprefix("\n")

            def leave(edge=edge, before=before):
                out.end_line()
                out.indent = before
                edge()

            children = child.children
            if name == "details" and "open" not in child.attributes:  # closed: its summary alone shows
                children = [c for c in children if isinstance(c, Element) and c.name == "summary"][:1]
            stack.append(("block", iter(children), pre or name == "pre", leave))
        else:
            if name == "q":
                out.write('"')
            stack.append(("inline", iter(child.children), pre, (lambda: out.write('"')) if name == "q" else None))


def _list(e: Element, out: _Lines, stack: list, pre: bool) -> None:
    edge = out.end_line if out.items else out.apart
    edge()
    stack.append(("list", iter(e.children), pre, edge))


def _whole(text: str | None) -> int | None:
    text = (text or "").strip()
    return int(text) if text.removeprefix("-").isdecimal() and len(text) < 10 else None


def _number(e: Element, parent: Element, out: _Lines) -> int:
    """Number of an item of an ordered list: its value, else one on from the item before (or down, if reversed)."""
    backward = "reversed" in parent.attributes
    number = _whole(e.attributes.get("value"))
    if number is None:
        number = out.numbered.get(id(parent))
    if number is None:
        number = _whole(parent.attributes.get("start"))
    if number is None:
        number = sum(isinstance(c, Element) and c.name == "li" and visible(c) for c in parent.children) if backward else 1
    out.numbered[id(parent)] = number + (-1 if backward else 1)
    return number


def _item(e: Element, out: _Lines, stack: list, pre: bool) -> None:
    out.end_line()
    parent = e.parent
    mark = f"{_number(e, parent, out)}. " if parent is not None and parent.name == "ol" else "- "
    before = out.indent
    own = (len(before), mark)
    out.marks.append(own)
    out.indent += " " * len(mark)
    out.items += 1

    def leave():
        out.end_line()
        out.indent = before
        out.marks = [m for m in out.marks if m is not own]
        out.items -= 1

    stack.append(("item", iter(e.children), pre, leave))


def render_lines(node: Element) -> list[str]:
    out = _Lines()
    _walk(node, out, False)
    out.end_line()
    return out.lines


def render(html: str | None) -> str:
    """All visible text of a page as laid-out lines; empty for a null or empty page."""
    if not html:
        return ""
    root = parse(html)
    # a table in a cell is laid out by a call within a call, and a page may nest as many as it has tags
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(limit + 8 * html.count("<"))
    try:
        return "\n".join(render_lines(root))
    finally:
        sys.setrecursionlimit(limit)


def extract_text(pages: DataFrame, html_col="html") -> DataFrame:
    """pages with the column rendered_text added (replaced if there).

    A null page has empty text. Pages are read whole and rendered one by one; rows, repeated or
    with null ids, stay as they are.
    """
    columns = [c for c in pages.columns if c.lower() != "rendered_text"]
    kept = [named(c) for c in columns]

    def each(batches):
        for batch in batches:
            texts = [render(h.as_py()) for h in batch.column(batch.num_columns - 1)]
            same = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(texts, pa.string())], names=[*columns, "rendered_text"])

    schema = pages.select(*kept).schema.add("rendered_text", "string")
    numbered = [c.alias(f"c{k}") for k, c in enumerate(kept)]  # not every name can be passed to a worker
    return pages.select(*numbered, named(html_col).alias("html")).mapInArrow(each, schema)
