"""Layout-aware text of HTML: a tree builder with implied tags, visibility rules, and a renderer of blocks, lists and tables.

``parse`` builds the tree that a browser would show the text of (end tags may be missing, cells may lack rows, stray content
of tables moves before them). ``render`` walks it: what is not displayed is left out, white space collapses outside of
preformatted text, blocks begin new lines, paragraphs and the like stand apart by one empty line, list items get markers and
indentation, and the cells of a table are aligned in columns. Both keep their own stacks, so a page may nest as deep as it
likes. Text is never dropped for the sake of layout: only white space has bounds (``INDENT``, ``PADDING``)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from html import unescape

from pyspark.sql import DataFrame

from almanac.llm.common import fresh, widen

words = str.split
#: Element names by their role in HTML's rules.
VOID = set(words("area base br col embed hr img input link meta param source track wbr"))
RAW = set(words("script style iframe noembed noframes noscript xmp title textarea"))
HIDDEN = set(words("head script style template noscript iframe object embed video audio canvas datalist noembed noframes title meta link param source track base area"))
BLOCK = set(words("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp"))
APART = set(words("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu xmp hr"))
CLOSES_P = BLOCK - set(words("body html dt dd li option optgroup legend")) | set(words("li dt dd"))
HEADINGS = set(words("h1 h2 h3 h4 h5 h6"))
SECTIONS = set(words("tbody thead tfoot"))
TABLE_ONLY = SECTIONS | set(words("table tr"))
SCOPE = set(words("table td th caption template object button"))
#: Start tag -> (tags it ends, tags beyond which it doesn't look)
ENDS = {
    "li": ({"li"}, set(words("ul ol menu dir")) | SCOPE),
    "dt": ({"dt", "dd"}, {"dl"} | SCOPE),
    "dd": ({"dt", "dd"}, {"dl"} | SCOPE),
    "option": ({"option"}, set(words("select datalist optgroup"))),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, SECTIONS | {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
} | {t: (SECTIONS | {"caption", "colgroup"}, {"table"}) for t in (*SECTIONS, "caption", "colgroup")}

TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
TELLING = re.compile(r"hidden|style|span|start|value|open|reversed", re.I)
GAP = re.compile(r"[ \t\n\f\r]+")
#: A declaration of an inline style; a semicolon inside quotes or brackets doesn't end it.
DECLARATION = re.compile(r"""(?:[^;"'(]++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|\([^)]*+(?:\)|\Z))++""")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: What these properties may be; a declaration of anything else doesn't count (CSS).
VALUES = {
    "display": set(words("""none block inline inline-block flow flow-root flex inline-flex grid inline-grid table inline-table table-row-group table-header-group table-footer-group
        table-row table-cell table-column-group table-column table-caption list-item contents run-in ruby ruby-base ruby-text inherit initial unset revert revert-layer""")),
    "visibility": set(words("visible hidden collapse inherit initial unset revert revert-layer")),
    "content-visibility": set(words("visible hidden auto inherit initial unset revert revert-layer")),
}
#: Columns up to which nested items are indented, characters of white space that align a table for each character and cell of its
#: own, and the widest span (HTML's own limit). Deeper items stay at the last indentation. ``PADDING`` is a proportion, so that the
#: text of a page is never much longer than the page, and a table has the same columns however many such rows or tables there are.
INDENT, PADDING, SPAN = 80, 64, 1000


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


class Open:
    """The open elements, the root first, and for each tag the places at which it is open."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        self.places[self.nodes.pop().tag].pop()

    def innermost(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of these names; 0, the root's, if none is open."""
        return max((at[-1] for n in names if (at := self.places.get(n))), default=0)

    def pop_to(self, names: Iterable[str], bounds: Iterable[str]) -> None:
        """Ends the innermost of ``names`` and all in it, unless one of ``bounds`` lies between."""
        at = self.innermost(names)
        if at and at >= self.innermost(bounds):
            while len(self.nodes) > at:
                self.pop()


def parse(html: str) -> Node:
    root = Node("html")
    stack, at, end = Open(root), 0, len(html)
    nodes = stack.nodes

    def place(item, tabular: bool = False) -> None:
        """Below the open element; out of a table's frame, before the table, unless it belongs there."""
        if nodes[-1].tag in TABLE_ONLY and not tabular and (table := stack.innermost(["table"])):
            nodes[table - 1].children.insert(-1, item)
        else:
            nodes[-1].children.append(item)

    def text(raw: str) -> None:
        if raw and not (nodes[-1].tag in TABLE_ONLY and not raw.strip()):
            if nodes[-1].tag == "pre" and not nodes[-1].children:  # the first line feed of preformatted text is not its own
                raw = raw.removeprefix("\r").removeprefix("\n")
            place(unescape(raw) if "&" in raw else raw)

    def opened(node: Node, tabular: bool = False) -> None:
        place(node, tabular)
        stack.push(node)

    while m := TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, rest = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if closing:
            if name == "br":
                place(Node("br"))
            elif name in HEADINGS:
                stack.pop_to(HEADINGS, SCOPE)
            elif name not in ("html", "body"):
                bounds = set() if name == "table" else {"table"} if name in TABLE_ONLY or name in ("td", "th", "caption") else SCOPE | (set(words("ul ol menu")) if name == "li" else set())
                stack.pop_to({name}, bounds - {name})
            continue
        attributes = _attributes(rest) if rest and TELLING.search(rest) else None
        if name in ("html", "body"):
            root.attributes = (attributes or {}) | root.attributes
            continue
        if name in CLOSES_P:
            stack.pop_to({"p"}, SCOPE)
        if name in HEADINGS and nodes[-1].tag in HEADINGS:
            stack.pop()
        if name in ENDS:
            stack.pop_to(*ENDS[name])
        if name == "table" and nodes[-1].tag in TABLE_ONLY:
            stack.pop_to({"table"}, ())
        tabular = name in TABLE_ONLY and name != "table" or name in ("td", "th", "caption", "colgroup", "col")
        if tabular:
            inside = stack.innermost(("table", "td", "th", "caption"))
            if not inside or nodes[inside].tag != "table":  # a row or cell outside of a table is only its content
                if name in ("td", "th"):
                    place(" ")
                continue
            if name not in ("caption", "colgroup", "col"):
                while nodes[-1].tag not in TABLE_ONLY:
                    stack.pop()
            if name in ("td", "th") and nodes[-1].tag != "tr":
                if nodes[-1].tag == "table":
                    opened(Node("tbody"), True)
                opened(Node("tr"), True)
            elif name == "tr" and nodes[-1].tag == "table":
                opened(Node("tbody"), True)
        node = Node(name, attributes)
        if name in VOID:
            place(node, tabular)
        elif name in RAW:
            close = _closer(name).search(html, at)
            stop = close.start() if close else end
            if name in ("textarea", "xmp"):
                node.children.append(unescape(html[at:stop]))
            place(node)
            at = close.end() if close else end
        else:
            opened(node, tabular)
    text(html[at:])
    return root


def _attributes(told: str) -> dict[str, str]:
    """Names in lower case with their values; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(told):
        if name.lower() not in out:
            value = value[1:-1] if value[:1] in ("'", '"') and value[:1] == value[-1:] and len(value) > 1 else value
            out[name.lower()] = unescape(value) if "&" in value else value
    return out


_closers: dict[str, re.Pattern] = {}


def _closer(name: str) -> re.Pattern:
    if name not in _closers:
        _closers[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)
    return _closers[name]


class Flow:
    """Lines under way. ``parts`` are of the line that is being written; ``space`` and ``gap`` are the space and the empty line
    that the next text needs before it. An item is a stretch of lines with a marker before the first and an indentation before
    the others; markers of items without a line yet wait for it, and ask for no empty line of their own."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = False
        self.items: list[tuple[int, int]] = []
        self.waiting: list[str] = []
        self.indent = self.ahead = 0

    def write(self, text: str) -> None:
        text = GAP.sub(" ", text)
        if not text:
            return
        if text == " ":
            self.space = True
            return
        if (self.space or text[0] == " ") and self.parts:
            self.parts.append(" ")
        self.parts.append(text.strip(" "))
        self.space = text[-1] == " "

    def exact(self, text: str) -> None:
        """Text with its white space: every line feed ends a line, if an empty one."""
        first, *others = text.replace("\r\n", "\n").split("\n")
        self.space = False
        for i, line in enumerate((first, *others)):
            if i:
                self.line("".join(self.parts))
                self.parts = []
            if line:
                self.parts.append(line)

    def line(self, line: str) -> None:
        line = line.rstrip(" ")
        if not line:
            if not self.waiting:
                self.lines.append("")
            return
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        margin = " " * min(self.indent, INDENT)
        if self.waiting:
            margin += "".join(self.waiting)
            self.indent = self.ahead
            self.waiting.clear()
        self.lines.append(margin + line if margin else line)

    def end_line(self, apart: bool = False) -> None:
        if self.parts:
            self.line("".join(self.parts))
            self.parts = []
        self.space = False
        self.gap |= apart and not self.waiting

    def line_break(self) -> None:
        if self.parts:
            self.end_line()
        elif self.lines and not self.gap and not self.waiting:
            self.lines.append("")

    def block(self, lines: list[str]) -> None:
        """Lines made elsewhere, apart from what is around them."""
        self.end_line(True)
        for i, line in enumerate(lines):
            self.line(line)
            if line and not self.indent:
                self.lines += lines[i + 1 :]
                break
        self.gap |= not self.waiting

    def enter(self, marker: str, width: int, apart: bool) -> None:
        self.end_line(apart)
        self.items.append((self.ahead, len(self.waiting)))
        self.waiting.append(marker)
        self.ahead += width

    def leave(self, apart: bool | None) -> None:
        """Ends an item; ``apart`` None leaves it to the item's end whether an empty line follows."""
        self.end_line()
        self.ahead, before = self.items.pop()
        if len(self.waiting) > before:
            self.waiting.pop()
        else:
            self.indent = self.ahead
            if apart is not None:
                self.gap = False
        self.gap |= bool(apart) and not self.waiting


def _number(text: str | None, other: int) -> int:
    try:
        return int(text or "")
    except ValueError:
        return other


def _styled(style: str) -> dict[str, str]:
    """The values of ``VALUES``' properties: of several the last counts, but what is important goes before what is not."""
    out: dict[str, tuple[bool, str]] = {}
    for told in DECLARATION.findall(COMMENT.sub(" ", style) if "/*" in style else style):
        name, _, value = told.lower().partition(":")
        name, value = name.strip(), value.strip()
        important = value.endswith("important") and value[:-9].rstrip().endswith("!")
        value = value[:-9].rstrip()[:-1].rstrip() if important else value
        if value in VALUES.get(name, ()) and (important or not out.get(name, (False,))[0]):
            out[name] = important, value
    return {name: value for name, (_, value) in out.items()}


def _shown(node: Node, seen: bool) -> tuple[bool, bool]:
    """Whether a box is made for the node, and whether its own text is visible. A style's display goes before what hides by default."""
    if node.tag in HIDDEN:
        return False, False
    a = node.attributes
    if not a:
        return node.tag != "dialog", seen
    style = _styled(a["style"]) if "style" in a else {}
    hides = "hidden" in a or node.tag == "dialog" and "open" not in a
    display = style.get("display", "revert")
    if display == "none" or hides and display.startswith("revert") or style.get("content-visibility") == "hidden":
        return False, False
    visibility = style.get("visibility", "inherit")
    return True, visibility in ("visible", "initial") or visibility not in ("hidden", "collapse") and seen


class Page:
    """The white space that aligns the tables within a page or a table, and how many cells they have."""

    def __init__(self):
        self.padding = self.cells = 0


def _walk(node: Node, flow: Flow, seen: bool, exact: bool, page: Page) -> Iterator:
    """Writes the content of ``node``. A generator that yields the generators of its children, for ``_run``."""
    order, shut = None, node.tag == "details" and "open" not in node.attributes
    step = -1 if node.tag == "ol" and "reversed" in node.attributes else 1
    for child in node.children:
        if isinstance(child, str):
            if seen and not shut:
                flow.exact(child) if exact else flow.write(child)
            continue
        box, visible = _shown(child, seen)
        tag = child.tag
        if not box or shut and tag != "summary":
            continue
        if tag == "br":
            flow.line_break()
        elif tag == "table":
            flow.block((yield _table(child, visible, page)))
        elif tag == "li":
            if order is None:
                items = sum(not isinstance(c, str) and c.tag == "li" and _shown(c, seen)[0] for c in node.children) if step < 0 else 1
                order = _number(node.attributes.get("start"), items) - step
            order = _number(child.attributes.get("value"), order + step)
            mark = f"{order}. " if node.tag == "ol" else "- "
            flow.enter(mark, len(mark), False)
            yield _walk(child, flow, visible, exact, page)
            flow.leave(None)
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.enter("", 0, node.tag != "li")
            yield _walk(child, flow, visible, exact, page)
            flow.leave(node.tag != "li")
        elif tag in ("dd", "blockquote"):
            flow.enter("  ", 2, tag == "blockquote")
            yield _walk(child, flow, visible, exact, page)
            flow.leave(tag == "blockquote")
        elif tag in BLOCK:
            flow.end_line(tag in APART)
            yield _walk(child, flow, visible, exact or tag in ("pre", "xmp"), page)
            flow.end_line(tag in APART)
        else:
            if tag in ("td", "th"):
                flow.write(" ")
            yield _walk(child, flow, visible, exact or tag == "textarea", page)


def _lines(node: Node, seen: bool, page: Page) -> Iterator:
    flow = Flow()
    yield _walk(node, flow, seen, False, page)
    flow.end_line()
    return flow.lines


def _run(task: Iterator):
    """The value of a generator, each of whose yields is a generator to run first, whose value it is then sent."""
    stack, value = [task], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(inner)
            value = None
    return value


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _rows(table: Node, seen: bool) -> tuple[list, list]:
    """Captions, and rows in order of head, bodies and foot, each with its visibility and the number of its group."""
    captions, groups, number = [], {"thead": [], "tbody": [], "tfoot": []}, 0
    for part in table.children:
        box, own = (False, False) if isinstance(part, str) else _shown(part, seen)
        if not box:
            continue
        if part.tag == "caption":
            captions.append((part, own))
        elif part.tag in groups:
            number += 1
            for row in part.children:
                box, visible = (False, False) if isinstance(row, str) else _shown(row, own)
                if box and row.tag == "tr":
                    groups[part.tag].append((row, visible, number))
    return captions, [r for g in groups.values() for r in g]


def _table(table: Node, seen: bool, page: Page) -> Iterator:
    """Captions, then rows in order of head, bodies and foot. Columns are as wide as their widest cell and two spaces apart, and
    together as wide as a cell that spans them; a cell of many lines takes many lines of its row; the places of spans stay
    empty. A rowspan ends with its group of rows, and one of zero goes on to that end.

    Every cell begins where its column does. Where that would take more than ``PADDING`` for each character and cell of the table
    (one cell as long as a page above hundreds of short ones), no column is wider than a half, a quarter and so on of the widest;
    what is wider stands out, and the row goes on below it, in its columns."""
    captions, rows = _rows(table, seen)
    out = []
    for caption, visible in captions:
        out += yield _lines(caption, visible, page)
    grid, busy, group, inner = [], {}, 0, Page()
    for row, visible, number in rows:
        cells, column = {}, 0
        busy = {c: n - 1 for c, n in busy.items() if n > 1} if number == group else {}
        group = number
        taken = set(busy)
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                continue
            box, own = _shown(cell, visible)
            if not box:
                continue
            while column in taken:
                column += 1
            span = min(SPAN, max(1, _number(cell.attributes.get("colspan"), 1)))
            down = _number(cell.attributes.get("rowspan"), 1)
            down = len(rows) + 1 if down == 0 else max(1, down)
            cells[column] = ((yield _lines(cell, own, inner)), span)
            for c in range(column, column + span):
                if down > 1:
                    busy[c] = max(busy.get(c, 0), down)
            column += span
        grid.append(cells)
    inner.cells += sum(map(len, grid))
    widths = _widths(grid)
    most = max(widths.values(), default=0)
    text = inner.cells + sum(len(line) - line.count(" ") for cells in grid for lines, _ in cells.values() for line in lines) if widths else 0
    while (made := _set(grid, _starts(grid, widths), PADDING * text - inner.padding if most else math.inf)) is None:
        most //= 2
        widths = {c: min(w, most) for c, w in widths.items()}
    page.padding += inner.padding + made[1]
    page.cells += inner.cells
    return out + made[0]


def _set(grid: list[dict], starts: dict[int, int], room: float) -> tuple[list[str], int] | None:
    """The lines of the rows, each cell at its column's start, if need be on a line of its own; and the white space before and
    between cells. None if that is more than ``room``."""
    out, padding = [], 0
    for cells in grid:
        if len(cells) == 1 and 0 in cells:
            out += cells[0][0]
            continue
        for i in range(max((len(lines) for lines, _ in cells.values()), default=0)):
            line, reach = [], 0
            for column, (lines, _) in sorted(cells.items()):
                if i < len(lines) and lines[i]:
                    if line and starts[column] < reach + 2:
                        out.append("".join(line))
                        line, reach = [], 0
                    pad = starts[column] - reach
                    padding += pad
                    if padding > room:
                        return None
                    line.append(" " * pad + lines[i])
                    reach += pad + _width(lines[i])
            out.append("".join(line).rstrip(" "))
    return out, padding


def _widths(grid: list[dict]) -> dict[int, int]:
    """The width of each column that has one: of its widest cell; then, narrower spans first, what a spanning cell needs beyond its
    columns goes to the last of them that has a width (to its first, if none has). A table of one column needs none, and the
    last cell of a row needs no room."""
    widths: dict[int, int] = {}
    if not any(max(cells) for cells in grid if cells):
        return widths
    wide: dict[tuple[int, int], int] = {}
    for cells in grid:
        for column, (lines, span) in cells.items():
            most = max((max(1, _width(line)) for line in lines if line), default=0)
            if span == 1:
                widths[column] = max(widths.get(column, 0), most)
            elif any(c > column for c in cells):
                wide[span, column] = max(wide.get((span, column), 0), most)
    for (span, column), most in sorted(wide.items()):
        own = [c for c in range(column, column + span) if widths.get(c)]
        short = most - (sum(widths[c] + 2 for c in own) - 2 if own else 0)
        if short > 0:
            c = own[-1] if own else column
            widths[c] = widths.get(c, 0) + short
    return widths


def _starts(grid: list[dict], widths: dict[int, int]) -> dict[int, int]:
    """Where each column that a cell begins in starts; columns without a width take no room."""
    starts, at, wide = {}, 0, sorted(widths)
    i = 0
    for column in sorted({c for cells in grid for c in cells}):
        while i < len(wide) and wide[i] < column:
            at += widths[wide[i]] + 2 * (widths[wide[i]] > 0)
            i += 1
        starts[column] = at
    return starts


def render(html: str) -> str:
    """The visible text of ``html``; lines have no spaces at their end, and there are no two empty lines in a row outside of
    preformatted text."""
    root = parse(html)
    lines = _run(_lines(root, True, Page())) if _shown(root, True)[0] else []
    first = next((i for i, line in enumerate(lines) if line), len(lines))
    last = next((i for i in range(len(lines), first, -1) if lines[i - 1]), first)
    return "\n".join(lines[first:last])


def extract(pages: DataFrame, html: str = "html") -> tuple[DataFrame, str]:
    """``pages`` (``html`` and any others) with a string column of the visible text, whose name is returned too. Null and
    empty pages have an empty text; text without any tag is its own, white space collapsed. Rows are worked on where they
    are, one page at a time."""
    name = fresh(pages.columns, "visible_text")
    done = widen(pages, name, "string", lambda: lambda texts: list(map(render, texts)), column_read=html)
    return done, name
