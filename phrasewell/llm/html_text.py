"""Operator 1, HTML extraction: a tree builder and a layout-aware rendering.

``parse`` builds a tree from markup the way browsers do for the cases that
occur on real pages: void elements, raw-text elements, comments, implied end
tags (``p``, ``li``, ``dt``/``dd``, ``option``, table parts), an implied
``tbody`` and ``tr``, stray end tags, and character references.  ``render``
walks the tree and emits all visible text:

* Nothing inside ``head``, ``script``, ``style``, ``template``, ``noscript``
  and other elements that browsers don't show, nor inside elements with
  ``hidden``, ``aria-hidden="true"`` or an inline ``display:none``.  Inside
  ``visibility:hidden`` only what is ``visibility:visible`` again.  Of a
  ``select`` the chosen options (the first, if none is), of ``svg`` its texts.
* Block elements start on a new line; paragraphs, headings, lists, tables and
  other spaced blocks are set off by an empty line.  White space collapses,
  except within ``pre`` and ``textarea``.
* List items get ``- `` or their number (by ``start``, ``value``, ``type`` and
  ``reversed``), two columns deeper for each level.
* A table row is a line, or as many as its highest cell has: blocks, lists and
  tables within cells keep their lines.  Cells are padded to the width of their
  column and separated by `` | ``; ``colspan`` and ``rowspan`` take that many
  columns and rows, empty but for the first.
* ``img`` gives its ``alt`` text, ``br`` a line break, ``hr`` a rule.

Defined results: null gives null; an empty page or one without visible text
gives the empty string.  A repeated row is rendered each time, a very long page
whole; an empty table gives no rows, and extra columns are ignored, whatever
their names.  Depth is not limited (nothing here recurses on it).
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset(
    "head script style template noscript iframe object embed audio video canvas title meta link base "
    "datalist noembed noframes param source track area map desc defs symbol".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre hr figure fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside nav header footer main form address li dt dd figcaption legend details summary "
    "dialog center dir menu hgroup search optgroup option caption thead tbody tfoot tr td th -lines".split()
)
#: A start tag closes these open elements, unless one of the second set lies between.
_P = (frozenset({"p"}), frozenset({"button", "table", "td", "th", "caption", "object", "applet", "marquee", "html"}))
_CELLS = frozenset({"table", "html"})
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "table", "td", "th", "html"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th", "html"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup", "html"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select", "html"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr"}) | _CELLS),
    "tr": (frozenset({"td", "th", "tr", "caption", "colgroup"}), _CELLS),
    "tbody": (frozenset({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}), _CELLS),
    "caption": (frozenset({"caption", "colgroup"}), _CELLS),
    "body": (frozenset({"head"}), frozenset({"html"})),
}
CLOSES["dd"], CLOSES["th"] = CLOSES["dt"], CLOSES["td"]
CLOSES["thead"] = CLOSES["tfoot"] = CLOSES["tbody"]
_CLOSE_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
_HEAD = frozenset("html head title meta link style script base noscript template".split())
#: An end tag looks for its element no further out than these.
_SCOPE = {
    **{k: frozenset({"table"}) for k in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption")},
    "li": frozenset({"ul", "ol", "menu", "dir", "table"}),
}
_CELL_WALL = frozenset({"td", "th", "caption", "table"})

#: Every "<" with a letter, "/", "!" or "?" begins something that ends, at the end of the page if need be: one pass.
_TAG = re.compile(
    r"""<(?:!--(?:.*?--!?>|.*\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_HIDDEN = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*([a-z]+)", re.I)
_WORTH = frozenset("hidden aria-hidden style alt start value colspan rowspan type reversed selected multiple".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element: its children are nodes and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and not text.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(text):
            if (name := name.lower()) in _WORTH and name not in out:
                value = a or b or c
                out[name] = unescape(value) if "&" in value else value
    return out


def parse(html: str) -> Node:
    """The tree of a page; any text is a page."""
    root = Node("html")
    stack = [root]
    at, size = 0, len(html)
    search = _TAG.search

    def close(tags: frozenset, walls: frozenset) -> None:
        """Close open elements down to the outermost of tags that no wall hides."""
        lowest = 0
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].tag
            if tag in tags:
                lowest = k
            elif tag in walls:
                break
        if lowest:
            del stack[lowest:]

    def add(text: str) -> None:
        top = stack[-1]
        if top.tag in _TABLE_ONLY and not text.isspace():
            place = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == "table")
            stack[place - 1].children.insert(_before(stack[place - 1], stack[place]), text)
        elif top.tag == "head" and not text.isspace():
            stack.pop()
            stack[-1].children.append(text)
        else:
            top.children.append(text)

    def open_(tag: str) -> Node:
        node = Node(tag)
        stack[-1].children.append(node)
        stack.append(node)
        return node

    while at < size:
        found = search(html, at)
        # A "<" that begins no tag is text; search() has gone over it.
        upto = found.start() if found else size
        if upto > at:
            text = html[at:upto]
            add(unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            if tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p"))
                continue
            walls = _SCOPE.get(tag) or (_CELL_WALL if tag != "table" else frozenset())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in walls:
                    break
            continue
        top = stack[-1].tag
        if tag == "html":
            root.attrs |= {k: v for k, v in _attributes(found[3]).items() if k not in root.attrs}
            continue
        if top == "head" and tag not in _HEAD:
            stack.pop()
        if tag == "body" and any(n.tag == "body" for n in stack):
            continue
        if tag in _CLOSE_P:
            close(*_P)
        if tag in CLOSES:
            close(*CLOSES[tag])
        top = stack[-1].tag
        if tag in ("td", "th") and top in ("table", "tbody", "thead", "tfoot"):
            if top == "table":
                open_("tbody")
            open_("tr")
        elif tag == "tr" and top == "table":
            open_("tbody")
        node = Node(tag, _attributes(found[3]))
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            text = html[at : end.start() if end else size]
            at = end.end() if end else size
            if text and tag == "textarea":
                node.children.append(unescape(text).removeprefix("\n"))
            continue
        if not found[3].endswith("/") or tag not in ("svg", "math"):
            stack.append(node)
    return root


_TABLE_ONLY = frozenset({"table", "tbody", "thead", "tfoot", "tr", "colgroup"})


def _before(parent: Node, child: Node) -> int:
    return next((k for k in range(len(parent.children) - 1, -1, -1) if parent.children[k] is child), len(parent.children))


def visible(node: Node) -> bool:
    """Whether anything of an element can be shown."""
    if node.tag in UNSEEN:
        return False
    a = node.attrs
    if not a:
        return True
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return False
    return "style" not in a or not _HIDDEN.search(a["style"])


def veiled(node: Node, veil: bool) -> bool:
    """Whether an element's own text is hidden, veil being its parent's state."""
    if node.tag == "svg":
        return True
    if node.tag in ("text", "foreignobject"):
        veil = False
    if "style" in node.attrs and (found := _VISIBILITY.findall(node.attrs["style"])):
        return found[-1].lower() in ("hidden", "collapse")
    return veil


def chosen(select: Node) -> list[Node]:
    """The options of a select that are shown."""
    options, work = [], list(reversed(select.children))
    while work:
        node = work.pop()
        if not isinstance(node, str) and visible(node):
            if node.tag == "option":
                options.append(node)
            else:
                work += reversed(node.children)
    if "multiple" in select.attrs:
        return options
    marked = [n for n in options if "selected" in n.attrs]
    return marked[-1:] or options[:1]


_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def mark(number: int, kind: str) -> str:
    """A list item's number in the style of its list."""
    text = str(number)
    if kind in ("a", "A") and number > 0:
        text, n = "", number
        while n:
            n, letter = divmod(n - 1, 26)
            text = chr(97 + letter) + text
    elif kind in ("i", "I") and 0 < number < 4000:
        text, n = "", number
        for value, letters in _ROMAN:
            while n >= value:
                text, n = text + letters, n - value
    return text.upper() if kind in ("A", "I") else text


class _Page:
    """Lines of text under construction."""

    __slots__ = ("lines", "line", "gap", "space", "indent", "lead")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  #: an empty line goes before the next text
        self.space = False  #: a space goes before the next word
        self.indent = 0
        self.lead = ""  #: a list item's mark, until its first text

    def text(self, value: str) -> None:
        value = _SPACE.sub(" ", value)
        if value == " ":
            self.space = True
            return
        if not value:
            return
        if value[0] == " ":
            self.space = True
        body = value.strip(" ")
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(body)
        self.space = value[-1] == " "

    def put(self, line: str) -> None:
        """Emit a finished line."""
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if self.lead:
            self.lines.append(self.lead + line)
            self.lead = ""
        else:
            self.lines.append(" " * self.indent + line)

    def end(self) -> None:
        if self.line:
            self.put("".join(self.line))
            self.line = []
        self.space = False

    def verbatim(self, value: str) -> None:
        parts = value.split("\n")
        for k, part in enumerate(parts):
            if part:
                self.line.append(part)
            if k < len(parts) - 1:
                if self.line:
                    self.end()
                elif self.lines and not self.gap:
                    self.lines.append("")


def _number(value: str | None, default: int) -> int:
    try:
        return int(value) if value is not None else default
    except ValueError:
        return default


_ENTER, _LEAVE = 0, 1


def render(root: Node, veil: bool = False) -> str:
    """The visible text of a tree."""
    page = _Page()
    # (what to do, the node or string, whether white space stays, the list's state, depth of lists, whether text is hidden)
    work: list[tuple] = [(_ENTER, root, False, None, 0, veil)]
    while work:
        what, node, pre, lists, depth, veil = work.pop()
        if what == _LEAVE:
            page.end()
            if node.tag == "li":
                page.lead, page.indent = "", lists
            elif node.tag in ("blockquote", "dd"):
                page.indent = lists
            if node.tag in SPACED and not (depth and node.tag in ("ul", "ol")):
                page.gap = True
            continue
        if isinstance(node, str):
            if not veil:
                page.verbatim(node) if pre else page.text(node)
            continue
        if not visible(node):
            continue
        veil = veiled(node, veil)
        tag = node.tag
        if tag == "br":
            if page.line:
                page.end()
            elif page.lines and not page.gap:
                page.lines.append("")
            continue
        if tag == "img":
            if (alt := node.attrs.get("alt", "").strip()) and not veil:
                page.text(alt)
            continue
        if tag == "wbr":
            continue
        if tag == "hr":
            page.end()
            page.gap = True
            page.put("---")
            page.gap = True
            continue
        if tag == "table":
            page.end()
            page.gap = True
            for line in table_lines(node, veil):
                page.put(line) if line else page.lines.append("")
            page.gap = True
            continue
        if tag in BLOCK:
            page.end()
            if tag in SPACED and not (depth and tag in ("ul", "ol")):
                page.gap = True
            before = page.indent
            if tag == "li":
                if lists:
                    lists[0] = _number(node.attrs.get("value"), lists[0])
                page.lead = " " * page.indent + (f"{mark(lists[0], lists[1])}. " if lists else "- ")
                page.indent += len(page.lead) - page.indent
                if lists:
                    lists[0] += lists[2]
            elif tag in ("blockquote", "dd"):
                page.indent += 2
            work.append((_LEAVE, node, pre, before, depth, veil))
        if tag == "ol":
            step = -1 if "reversed" in node.attrs else 1
            first = sum(not isinstance(x, str) and x.tag == "li" for x in node.children) if step < 0 else 1
            lists = [_number(node.attrs.get("start"), first), node.attrs.get("type", ""), step]
        elif tag in ("ul", "menu", "dir"):
            lists = None
        if tag in ("ul", "ol"):
            depth += 1
        if tag in ("pre", "textarea", "-lines"):
            pre = True
        children = chosen(node) if tag == "select" else node.children
        work += [(_ENTER, child, pre, lists, depth, veil) for child in reversed(children)]
    page.end()
    return "\n".join(line.rstrip(" ") for line in page.lines).strip("\n")


def _rows(table: Node, veil: bool) -> tuple[list[tuple[Node, bool]], list[tuple[Node, bool]]]:
    """(captions, rows) of a table, in order, with whether their text is hidden; rows of tables within it are theirs."""
    captions, rows, work = [], [], [(x, veil) for x in reversed(table.children)]
    while work:
        node, veil = work.pop()
        if isinstance(node, str) or not visible(node):
            continue
        veil = veiled(node, veil)
        if node.tag == "tr":
            rows.append((node, veil))
        elif node.tag == "caption":
            captions.append((node, veil))
        elif node.tag != "table":
            work += [(x, veil) for x in reversed(node.children)]
    return captions, rows


def table_lines(table: Node, veil: bool = False) -> list[str]:
    """A table's caption and rows, cells padded to their columns.

    Tables within cells are set first, innermost first, and stand in their cell
    as lines of text, so that depth costs no recursion.
    """
    order, work = [], [(table, veil)]
    while work:
        node, veil = work.pop()
        order.append((node, veil))
        inner = [(x, veil) for x in node.children]
        while inner:
            child, veil = inner.pop()
            if not isinstance(child, str) and visible(child):
                veil = veiled(child, veil)
                if child.tag == "table":
                    work.append((child, veil))
                else:
                    inner += [(x, veil) for x in child.children]
    lines: list[str] = []
    for node, veil in reversed(order):
        lines = _own_lines(node, veil)
        if node is not table:
            # From here on this table is lines of text in its cell, hidden ones left out already.
            node.tag, node.attrs, node.children = "-lines", {"style": "visibility:visible"}, ["\n".join(lines)]
    return lines


def _own_lines(table: Node, veil: bool) -> list[str]:
    captions, rows = _rows(table, veil)
    out = []
    for caption, veil in captions:
        if text := _SPACE.sub(" ", render(_as_body(caption), veil)).strip():
            out.append(text)
    grid: list[dict[int, list[str]]] = []
    widths: dict[int, int] = {}
    taken: dict[int, int] = {}  #: columns that a cell above still spans, and for how many rows
    for row, veil in rows:
        cells: dict[int, list[str]] = {}
        column, spans = 0, []
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th") or not visible(cell):
                continue
            while taken.get(column):
                column += 1
            wide = min(max(_number(cell.attrs.get("colspan"), 1), 1), 1000)
            high = _number(cell.attrs.get("rowspan"), 1)
            text = render(_as_body(cell), veiled(cell, veil)) if cell.children else ""
            cells[column] = [x for x in text.split("\n") if x]
            widths[column] = max(widths.get(column, 0), *map(len, cells[column]), 0)
            spans += [(column + k, len(rows) if high == 0 else max(1, high)) for k in range(wide)]
            column += wide
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
        taken |= {k: n - 1 for k, n in spans if n > 1}
        cells |= {k: [] for k, _ in spans if k not in cells}
        grid.append(cells)
    n_columns = 1 + max((k for cells in grid for k in cells), default=-1)
    for cells in grid:
        last = max(cells, default=-1)
        for k in range(max(map(len, cells.values()), default=0)):
            line = [(cells.get(c, [])[k] if k < len(cells.get(c, [])) else "").ljust(widths.get(c, 0)) for c in range(min(n_columns, last + 1))]
            out.append(" | ".join(line).rstrip())
    return out


def _as_body(cell: Node) -> Node:
    body = Node("body")
    body.children = cell.children
    return body


def extract(html: str | None) -> str | None:
    """The visible text of a page."""
    return None if html is None else render(parse(html))


@F.arrow_udf(StringType())
def extract_column(html: pa.Array) -> pa.Array:
    return pa.array([extract(page.as_py()) for page in html], pa.string())


def visible_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """(page_id, text) of each page."""
    return pages.select("page_id", extract_column(F.col(html)).alias(into))
