"""Layout-aware text of HTML pages.

A small tree builder with implied end tags feeds a renderer that emits all
visible text: blocks on their own lines, paragraphs apart, lists with markers,
and tables with aligned columns. Nothing visible is thrown away.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import fresh

#: Elements of HTML by their part in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript title iframe object audio video canvas datalist meter progress".split())
#: What drawings and formulas hold without showing it, where HTML begins again in them, and the tags of HTML that end them.
UNDRAWN = {"svg": frozenset("defs symbol desc metadata clippath mask pattern marker".split()), "math": frozenset("annotation annotation-xml".split())}
UNDRAWN["text"] = UNDRAWN["svg"]
POINTS = frozenset("foreignobject mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption h1 h2 h3 h4 h5 h6".split())
APART = frozenset("p blockquote pre ul ol dl table h1 h2 h3 h4 h5 h6 figure article section".split())
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption li dd dt option optgroup legend summary".split())

#: What a start tag ends, and the elements beyond which it does not look.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
#: Cells and tables, which most end tags do not reach beyond, and those that do.
CELLS = ("td", "th", "table")
CROSSES = frozenset("table tr tbody thead tfoot td th body html".split())
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]

ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|$)|'([^']*+)(?:'|$)|([^\s>\"'][^\s>]*+))?)?")
TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[\s/]++|{re.sub(r'\((?=[^?])', '(?:', ATTRIBUTE.pattern)})*+)(?:>|$)", re.S)
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
WHITE = re.compile(r"[ \t\n\r\f\v]+")
#: Inputs whose value is not shown as text, and the labels of buttons without one.
UNWRITTEN = frozenset("hidden checkbox radio password file image color range".split())
LABELS = {"submit": "Submit", "reset": "Reset"}
#: The largest spans of cells, and the value for what is left of a table.
WIDEST, TALLEST = 1000, 65534
#: Numbers of lists in Roman letters.
ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
#: Lists indent the lines after a mark by so many places at most, and tables within so many others are laid out as blocks.
INDENT, NESTED = 40, 8


class Node:
    """An element: `unseen` ones show nothing; text is not shown where `quiet`; `inside` is the drawing or formula it is a part of."""

    __slots__ = ("tag", "attributes", "children", "unseen", "quiet", "inside")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.children = tag, _parsed(attributes) if attributes else {}, []
        within, self.quiet = (parent.inside, parent.quiet) if parent else ("", False)
        style = _declared(self.attributes.get("style", ""))
        self.unseen = tag in HIDDEN or "hidden" in self.attributes or tag == "dialog" and "open" not in self.attributes or style.get("display") == "none" or tag in UNDRAWN.get(within, ())
        if "visibility" in style:
            self.quiet = style["visibility"] in ("hidden", "collapse")
        self.inside = tag if tag in ("svg", "math") or tag == "text" and within else "" if tag in POINTS else within


def _parsed(attributes: str) -> dict[str, str]:
    """Names and values; of equal names the first counts, and a quote that opens no value is a character like others."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def _declared(style: str) -> dict[str, str]:
    """display and visibility of a style: the last of each, but important ones before others."""
    found: dict[str, tuple[bool, str]] = {}
    for name, value, important in DECLARED.findall(re.sub(r"/\*.*?(?:\*/|$)", " ", style, flags=re.S)) if style else ():
        if bool(important) >= found.get(name.lower(), (False, ""))[0]:
            found[name.lower()] = bool(important), value.lower()
    return {k: v for k, (_, v) in found.items()}


def tree(page: str) -> tuple[Node, int]:
    """The element tree, and how deep it is; end tags without a start are passed over, open elements end with the page.

    The start and end of a head are passed over too: what belongs there is hidden by itself, and all else ends it.
    """
    root = Node("html")
    path = [root]
    where: dict[str, list[int]] = {}  # places of open elements in the path, by tag
    blocks = [0]  # of open blocks other than paragraphs
    at, deepest = 0, 1

    def text(raw: str) -> None:
        if raw and not path[-1].quiet and path[-1].inside != "svg":
            path[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    def last(tags) -> int:
        """The place of the innermost open element of some tags, 0 if there is none."""
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def cut(place: int) -> None:
        """Ends the element at a place and all within it."""
        while len(path) > place:
            where[path.pop().tag].pop()
        while blocks[-1] >= len(path):
            blocks.pop()

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if name := m[1]:
            name = name.lower()
            place = last((name,))
            if place and (name in CROSSES or place >= last(CELLS)):
                cut(place)
        elif name := m[2]:
            name = name.lower()
            if name in ("html", "head"):
                continue
            while path[-1].inside and (name in BREAKOUT or name == "font" and _parsed(m[3]).keys() & {"color", "face", "size"}):
                cut(len(path) - 1)
            ends, border = IMPLIED.get(name, (frozenset(), frozenset()))
            if ends:
                limit = last(border)
                first = min((where[t][i] for t in ends if where.get(t) and (i := bisect_right(where[t], limit)) < len(where[t])), default=0)
                if first:
                    cut(first)
            if name in ENDS_P and (place := last(("p",))) > blocks[-1]:
                cut(place)
            node = Node(name, m[3], path[-1])
            path[-1].children.append(node)
            if name in RAW and not (path[-1].inside and m[3].endswith("/")):
                end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                stop = end.start() if end else len(page)
                if name in ("textarea", "xmp") and not node.quiet:
                    node.children.append(html.unescape(page[at:stop]))
                at = stop
                if end:
                    close = page.find(">", stop)
                    at = len(page) if close < 0 else close + 1
            elif name not in VOID and not m[3].endswith("/"):
                where.setdefault(name, []).append(len(path))
                if name in BLOCK and name != "p":
                    blocks.append(len(path))
                path.append(node)
                deepest = max(deepest, len(path))
        elif m[0].startswith("<![CDATA["):
            if not path[-1].quiet and path[-1].inside != "svg":
                path[-1].children.append(m[0][9:].removesuffix("]]>"))
    text(page[at:])
    return root, deepest


class Frame:
    """A list's item, or the page: the mark before its first line and what is before the others, whether it has lines, and the break that is due."""

    __slots__ = ("mark", "rest", "begun", "gaps")

    def __init__(self, mark: str = "", rest: str = ""):
        self.mark, self.rest, self.begun, self.gaps = mark, rest, False, 0


class Writer:
    """Lines of text; a block break ends a line, a paragraph break leaves an empty one. Items of lists are frames within frames."""

    def __init__(self, nested: int = 0) -> None:
        self.lines: list[str] = []
        self.frames, self.unsettled = [Frame()], 0  # frames from this one on may have a break or a mark due
        self.line: list[str] = []
        self.gap, self.nested = False, nested

    def text(self, raw: str) -> None:
        words = WHITE.sub(" ", raw)
        if not words.strip(" "):
            self.gap = self.gap or bool(words)
            return
        if (self.gap or words[0] == " ") and self.line:
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.gap = words[-1] == " "

    def _emit(self, line: str) -> None:
        """A line with the breaks and marks that are due before it."""
        before = self.frames[max(self.unsettled - 1, 0)].rest
        for frame in self.frames[self.unsettled :]:
            if frame.begun:
                self.lines += [""] * (frame.gaps - 1)
                before = frame.rest
            else:
                before += frame.mark
            frame.begun, frame.gaps = True, 1
        self.unsettled = len(self.frames) - 1
        self.lines.append(before + line if line else "")

    def literal(self, line: str) -> None:
        self.end(1)
        self._emit(line)

    def newline(self) -> None:
        if self.line:
            self.end(1)
        else:
            top = self.frames[-1]
            top.gaps = min(2, max(top.gaps, 1) + 1)

    def end(self, gaps: int) -> None:
        if self.line:
            line, self.line = "".join(self.line), []
            self._emit(line)
            self.frames[-1].gaps = 0
        self.gap = False
        self.frames[-1].gaps = max(self.frames[-1].gaps, gaps)

    def enter(self, mark: str) -> None:
        self.end(1)
        self.frames.append(Frame(mark, (self.frames[-1].rest + " " * len(mark))[:INDENT]))

    def leave(self) -> None:
        self.end(1)
        self.frames.pop()
        self.unsettled = min(self.unsettled, len(self.frames) - 1)

    def done(self) -> list[str]:
        self.end(1)
        return self.lines


def _numbered(number: int, kind: str) -> str:
    """A list's number in figures, letters or Roman letters; what has none of the latter is in figures."""
    if kind in ("a", "A") and number > 0:
        text = ""
        while number:
            number, at = divmod(number - 1, 26)
            text = chr(97 + at) + text
    elif kind in ("i", "I") and 0 < number < 4000:
        text = ""
        for value, letters in ROMAN:
            text += letters * (number // value)
            number %= value
    else:
        return f"{number}. "
    return f"{text.upper() if kind.isupper() else text}. "


def _whole(value: str, default: int) -> int:
    found = re.fullmatch(r"\s*([-+]?[0-9]{1,9})\s*", value)
    return int(found[1]) if found else default


def _list(node: Node, out: Writer) -> None:
    items = [c for c in node.children if not isinstance(c, str) and c.tag == "li" and not c.unseen]
    reverse, kind = "reversed" in node.attributes, node.attributes.get("type", "").strip()
    number = _whole(node.attributes.get("start", ""), len(items) if reverse else 1)
    for item in node.children:
        if isinstance(item, str) or item.tag != "li":
            render(_wrapped(item), out)
            continue
        if item.unseen:
            continue
        number = _whole(item.attributes.get("value", ""), number)
        out.enter(_numbered(number, item.attributes.get("type", kind).strip()) if node.tag == "ol" else "- ")
        number += -1 if reverse else 1
        render(item, out)
        out.leave()


def render(node: Node, out: Writer) -> None:
    """Writes what is visible in a node. Of closed details only the first summary is."""
    children = node.children
    if node.tag == "details" and "open" not in node.attributes:
        children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
    for child in children:
        if isinstance(child, str):
            out.text(child)
            continue
        tag = child.tag
        if child.unseen:
            continue
        if tag == "br":
            out.newline()
        elif tag == "img":
            if (alt := child.attributes.get("alt", "")) and not child.quiet:
                out.text(f" {alt} ")
        elif tag == "input":
            kind = child.attributes.get("type", "text").strip().lower()
            label = child.attributes.get("value", LABELS.get(kind, ""))
            if label and kind not in UNWRITTEN and not child.quiet:
                out.text(f" {label} ")
        elif tag == "hr":
            out.end(2)
        elif tag in ("pre", "xmp", "textarea"):
            out.end(2)
            for line in _plain(child).strip("\n").split("\n"):
                out.literal(line.rstrip())
            out.end(2)
        elif tag == "table" and out.nested < NESTED:
            out.end(2)
            for line in _table(child, out.nested + 1):
                out.literal(line)
            out.end(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            gaps = 1 if node.tag == "li" else 2
            out.end(gaps)
            _list(child, out)
            out.end(gaps)
        elif tag in BLOCK or tag == "foreignobject" or child.inside == tag == "text":
            gaps = 2 if tag in APART else 1
            out.end(gaps)
            if tag == "optgroup" and not child.quiet and (label := child.attributes.get("label", "")):
                out.text(label)
                out.end(1)
            render(child, out)
            out.end(gaps)
        else:
            render(child, out)


def _wrapped(child) -> Node:
    node = Node("div")
    node.children = [child]
    return node


def _plain(node: Node) -> str:
    parts, todo = [], [node]
    while todo:
        now = todo.pop()
        if isinstance(now, str):
            parts.append(now)
        elif now.tag == "br":
            parts.append("\n")
        elif not now.unseen or now is node:
            todo += reversed(now.children)
    return "".join(parts)


def _width(text: str) -> int:
    """How many places a text takes: two for wide characters, none for those that combine."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _span(cell: Node | str, name: str, most: int) -> int:
    """How many columns or rows a cell takes; no rows are all that are left."""
    value = "" if isinstance(cell, str) else cell.attributes.get(name, "").strip()
    found = re.match(r"\+?0*([0-9]*)", value)[1] if re.match(r"\+?[0-9]", value) else "1"
    number = most if len(found) > 6 else min(int(found or 0), most)
    return number or (most if name == "rowspan" else 1)


def _table(table: Node, nested: int = 1) -> list[str]:
    """Lines of a table: cells of a column start at the same place; cells may have many lines, and span columns and rows."""
    rows: list[list[tuple[int, int, list[str]]]] = []
    lines: list[str] = []
    below: dict[int, int] = {}  # the last row that a cell above takes in a column
    count = 0

    def cells(row: Node) -> None:
        nonlocal count
        own, column = [], 0
        for cell in row.children:
            if isinstance(cell, str) or not cell.unseen:
                inner = Writer(nested)
                real = not isinstance(cell, str) and cell.tag in ("td", "th")
                render(cell if real else _wrapped(cell), inner)
                held = inner.done()
                if held or real:
                    while below.get(column, -1) >= count:
                        column += 1
                    wide = min(_span(cell, "colspan", WIDEST), max(1, WIDEST - column))
                    tall = _span(cell, "rowspan", TALLEST)
                    if tall > 1:
                        below.update(dict.fromkeys(range(column, column + wide), count + tall - 1))
                    own.append((column, wide, held or [""]))
                    column += wide
        count += 1
        if own:
            rows.append(own)

    def walk(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str) or child.tag not in ("tr", "tbody", "thead", "tfoot"):
                inner = Writer(nested)
                render(_wrapped(child), inner)
                lines.extend(inner.done())
            elif not child.unseen:
                cells(child) if child.tag == "tr" else walk(child)

    walk(table)
    widths = [0] * max((column + wide for row in rows for column, wide, _ in row), default=0)
    for spanning in (False, True):
        for row in rows:
            for column, wide, held in row:
                if (wide > 1) == spanning:
                    need = max(map(_width, held)) - sum(widths[column : column + wide]) - 3 * (wide - 1)
                    widths[column + wide - 1] += max(0, need)
    starts = [0]
    for width in widths:
        starts.append(starts[-1] + width + 3)
    for row in rows:
        for y in range(max(len(held) for _, _, held in row)):
            line = ""
            for column, _, held in row:
                line += " " * (starts[column] - 3 - _width(line)) + " | " if column else ""
                line += held[y] if y < len(held) else ""
            lines.append(line.rstrip())
    return lines


def page_text(page: str | None) -> str | None:
    """The visible text of one page; null stays null. However deep elements are nested, all of them are rendered."""
    if page is None:
        return None
    root, depth = tree(page)
    out, limit = Writer(), sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 8 * depth + 1000))  # calls from Python to Python take no stack of the process
    try:
        render(root, out)
    finally:
        sys.setrecursionlimit(limit)
    return "\n".join(out.done())


def _rendered():
    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([page_text(p.as_py()) for p in pages], pa.string())

    return text


def rendered(pages: DataFrame, *, out: str = "text") -> DataFrame:
    """pages with the visible text of each whole page.

    A null page has a null text, an empty one an empty text; malformed HTML
    never fails, and takes time in proportion to its length, but for cells below
    cells that span many rows. Lists indent by 40 places at most, tables within
    eight others are laid out as blocks, and a row's spanning cells end at column
    1000. Rows keep their number and their other columns; if `out` is
    taken, underscores are added to it.
    """
    return pages.withColumn(fresh(pages.columns, out), _rendered()(F.col("html")))
