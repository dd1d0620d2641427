"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a renderer of blocks, lists and tables.

All visible text comes out, and nothing else: comments, scripts, styles, the head, templates, `hidden` elements, `display:none`,
`visibility:hidden` (which a descendant can undo), closed dialogs and the bodies of closed details are left out. Blanks collapse as
browsers collapse them, but not in preformatted text. Block elements stand on lines of their own; paragraphs, headings, lists, tables
and quotes have an empty line around them; list items have their bullet or number and hang indented; table cells are padded to the
width of their column, spans included, and cells of several lines keep them.

Defined cases: null or empty html gives an empty text; text outside body belongs to it; unclosed tags, comments and quotes end with the
page; an end tag that closes nothing is ignored, but for </p> and </br>; repeated rows are each rendered; other columns are not read.
Nesting may be of any depth: nothing here recurses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?--!?>|.*)|[!?][^>]*>?|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|$)|/[^>]*>)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLANKS = re.compile(r"[ \t\n\f\r]+")
_HIDING = re.compile(r"display\s*:\s*none")
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_UNSEEN = frozenset("head title script style template noscript noembed noframes iframe datalist audio video canvas object".split())
_MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre hr figure fieldset menu dir xmp".split())
_BLOCK = _MARGIN | frozenset(
    "address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary textarea caption".split()
)
_CLOSES_P = (_BLOCK - frozenset("body html option optgroup caption textarea legend".split())) | {"table"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset(("td", "th"))
_SECTIONS = frozenset(("thead", "tbody", "tfoot"))
#: For a start tag: the open elements that it ends, and those that it doesn't look beyond.
_SCOPE = frozenset("table td th caption html body template button object".split())
_ENDS = {
    "li": (frozenset(("li",)), _SCOPE | {"ul", "ol", "menu", "dir"}),
    "dt": (frozenset(("dt", "dd")), _SCOPE | {"dl"}),
    "dd": (frozenset(("dt", "dd")), _SCOPE | {"dl"}),
    "option": (frozenset(("option",)), _SCOPE | {"select", "optgroup", "datalist"}),
    "optgroup": (frozenset(("option", "optgroup")), _SCOPE | {"select"}),
    "rt": (frozenset(("rt", "rp")), _SCOPE | {"ruby"}),
    "rp": (frozenset(("rt", "rp")), _SCOPE | {"ruby"}),
    "td": (_CELLS, frozenset(("tr", "table"))),
    "th": (_CELLS, frozenset(("tr", "table"))),
    "tr": (_CELLS | {"tr", "caption", "colgroup"}, frozenset(("table",)) | _SECTIONS),
    "thead": (_CELLS | {"tr", "caption", "colgroup"} | _SECTIONS, frozenset(("table",))),
    "tbody": (_CELLS | {"tr", "caption", "colgroup"} | _SECTIONS, frozenset(("table",))),
    "tfoot": (_CELLS | {"tr", "caption", "colgroup"} | _SECTIONS, frozenset(("table",))),
    "caption": (_CELLS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    "colgroup": (_CELLS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class _Builder:
    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.count: dict[str, int] = {}  # open elements by tag, so that none is looked for in vain
        self.head: Node | None = None
        self.in_head = False

    def _close(self, ends: frozenset, stops: frozenset) -> None:
        """Closes the open elements of `ends` above the nearest of `stops`, with all within them."""
        if not any(self.count.get(t) for t in ends):
            return
        lowest = None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in ends:
                lowest = i
            elif tag in stops:
                break
        if lowest is not None:
            self._cut(lowest)

    def _cut(self, at: int) -> None:
        for node in self.open[at:]:
            self.count[node.tag] -= 1
        del self.open[at:]

    def _enter(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def text(self, text: str) -> None:
        if self.in_head and self.open[-1].tag == "head" and text.strip():
            self.end("head")
        self.open[-1].children.append(text)

    def start(self, tag: str, attrs: dict[str, str], empty: bool) -> None:
        if tag in ("html", "body"):
            if self.in_head:
                self.end("head")
            self.root.attrs = {**attrs, **self.root.attrs}
            return
        if tag == "head":
            if not self.in_head and len(self.open) == 1:
                self.in_head = True
                self._enter(Node("head", attrs))
            return
        if self.in_head and tag not in ("title", "meta", "link", "style", "script", "base", "template", "noscript"):
            self.end("head")
        if tag in _CLOSES_P:
            self._close(frozenset(("p",)), _SCOPE)
        if tag in _HEADINGS and self.open[-1].tag in _HEADINGS:
            self._cut(len(self.open) - 1)
        if tag == "a":
            self._close(frozenset(("a",)), _SCOPE | _BLOCK)
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        if tag in _CELLS or tag == "tr" or tag in _SECTIONS:
            here = self.open[-1].tag
            if self.count.get("table") and tag in _CELLS and here in ("table", *_SECTIONS):
                self._enter(Node("tr", {}))
        node = Node(tag, attrs)
        if tag in _VOID or (empty and tag not in _BLOCK and tag not in _RAW and tag not in _CELLS):
            self.open[-1].children.append(node)
        else:
            self._enter(node)

    def end(self, tag: str) -> None:
        if tag == "head":
            self.in_head = False
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        wanted = _HEADINGS if tag in _HEADINGS else frozenset((tag,))
        stops = frozenset(("html",)) if tag in ("table", "template", "head") else frozenset(("table", "html")) if tag in _CELLS or tag in _SECTIONS or tag in ("tr", "caption") else _SCOPE if tag in _BLOCK else _SCOPE | _BLOCK
        if any(self.count.get(t) for t in wanted):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in wanted:
                    self._cut(i)
                    return
                if self.open[i].tag in stops:
                    break
        if tag == "p":
            self._enter(Node("p", {}))
            self._cut(len(self.open) - 1)


def parse(html: str) -> Node:
    """The tree of a page."""
    build, at = _Builder(), 0
    lower = None
    while at < len(html):
        found = _TAG.search(html, at)
        if not found:
            build.text(unescape(html[at:]))
            break
        if found.start() > at:
            build.text(unescape(html[at : found.start()]))
        at = found.end()
        name = found["name"] or found["name2"]
        if not name:
            continue
        tag = name.lower()
        if found["end"] or found["end2"]:
            build.end(tag)
            continue
        attrs = found["attrs"] or found["attrs2"] or ""
        build.start(tag, _attributes(attrs), attrs.endswith("/"))
        if tag in _RAW and build.open[-1].tag == tag:
            lower = html.lower() if lower is None else lower
            if len(lower) != len(html):  # a letter whose lower case is longer
                lower = re.sub("[A-Z]", lambda m: m[0].lower(), html)
            end = lower.find(f"</{tag}", at)
            end = len(html) if end < 0 else end
            if tag not in _UNSEEN:
                build.text(unescape(html[at:end]) if tag == "textarea" else html[at:end])
            at = end
    return build.root


class _Page:
    """Lines of one flow of text: the page itself, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = True  # the line so far ends in a collapsible blank, or is empty
        self.margin = False
        self.indent: list[list[str]] = []  # first and later prefixes; the first is used once

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            for k, piece in enumerate((first, *rest)):
                if k:
                    self.flush(True)
                if piece:
                    self.now.append(piece.rstrip("\r"))
                    self.blank = False
            return
        text = _BLANKS.sub(" ", text)
        if self.blank:
            text = text.removeprefix(" ")
        if text:
            self.now.append(text)
            self.blank = text[-1] == " "

    def flush(self, always: bool = False) -> None:
        line = "".join(self.now)
        if line.strip(" \t") or (always and not line):
            if self.margin and self.lines:
                self.lines.append("")
            self.margin = False
            prefix = ""
            for level in self.indent:
                prefix += level[0]
                level[0] = level[1]
            self.lines.append((prefix + line).rstrip(" \t"))
        self.now, self.blank = [], True

    def block(self, margin: bool) -> None:
        self.flush()
        self.margin |= margin


class _Table:
    def __init__(self) -> None:
        self.caption: list[str] = []
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def lines(self) -> list[str]:
        grid: list[list[tuple[int, int, list[str]]]] = []
        taken: dict[int, int] = {}  # column -> rows that a cell above still covers
        widths: dict[int, int] = {}
        wide: list[tuple[int, int, int]] = []
        for row in self.rows:
            column, placed, fresh = 0, [], {}
            for lines, colspan, rowspan in row:
                while taken.get(column, 0):
                    column += 1
                placed.append((column, colspan, lines))
                width = max(map(len, lines), default=0)
                if colspan == 1:
                    widths[column] = max(widths.get(column, 0), width)
                else:
                    wide.append((column, colspan, width))
                if rowspan > 1:
                    fresh |= {c: rowspan for c in range(column, column + colspan)}
                column += colspan
            taken = {c: n - 1 for c, n in (taken | fresh).items() if n > 1}
            grid.append(placed)
        for column, colspan, width in wide:
            have = sum(widths.get(c, 0) for c in range(column, column + colspan)) + 3 * (colspan - 1)
            last = column + colspan - 1
            widths[last] = widths.get(last, 0) + max(0, width - have)
        starts, at = {}, 0
        for c in range(max(widths, default=-1) + 2):
            starts[c] = at
            at += widths.get(c, 0) + 3
        out = list(self.caption)
        for placed in grid:
            for k in range(max((len(lines) for *_, lines in placed), default=0)):
                line = ""
                for column, _, lines in placed:
                    cell = lines[k] if k < len(lines) else ""
                    lead = starts.get(column, len(line) + 3)
                    if column:
                        line = line.ljust(lead - 3) + " | "
                    line += cell
                out.append(line.rstrip())
        return out


def _span(attrs: dict[str, str], name: str) -> int:
    try:
        return max(1, min(1000, int(attrs.get(name, "1"))))
    except ValueError:
        return 1


def render(root: Node) -> str:
    """The visible text of a tree."""
    page = _Page()
    pages, tables, lists = [page], [], []
    # (node or text, preformatted, visible) to enter; (None, what to do at the end) to leave
    todo: list[tuple] = [(root, False, True)]
    while todo:
        item = todo.pop()
        if item[0] is None:
            item[1]()
            continue
        node, pre, shown = item
        page = pages[-1]
        if isinstance(node, str):
            if shown:
                page.text(node, pre)
            continue
        tag, attrs = node.tag, node.attrs
        if tag in _UNSEEN or "hidden" in attrs or (tag == "dialog" and "open" not in attrs):
            continue
        if style := attrs.get("style"):
            style = style.lower()
            if _HIDING.search(style):
                continue
            if found := _VISIBILITY.search(style):
                shown = found[1] == "visible"
        children = node.children
        if tag == "br":
            page.flush(bool(page.lines or page.now))
            continue
        if tag in ("img", "hr", "input"):
            if tag == "hr":
                page.block(True)
            elif tag == "input" and shown and attrs.get("type", "text").lower() in ("submit", "button", "reset", "text") and attrs.get("value"):
                page.text(attrs["value"], True)
            continue
        if tag == "details" and "open" not in attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        pre = pre or tag in ("pre", "textarea", "xmp")
        leave = None
        if tag == "table":
            page.block(True)
            tables.append(_Table())

            def leave(page=page):
                page.block(True)
                lines = tables.pop().lines()
                for line in lines:
                    page.now = [line]
                    page.flush(True)
                page.block(True)

        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif (tag in _CELLS or tag == "caption") and tables:
            pages.append(_Page())

            def leave(tag=tag, attrs=attrs, table=tables[-1]):
                cell = pages.pop()
                cell.flush()
                if tag == "caption":
                    table.caption += cell.lines
                else:
                    if not table.rows:
                        table.rows.append([])
                    table.rows[-1].append((cell.lines, _span(attrs, "colspan"), _span(attrs, "rowspan")))

        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(not lists)
            start = attrs.get("start", "1")
            lists.append(int(start) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if tag == "ol" else None)

            def leave(page=page):
                lists.pop()
                page.block(not lists)

        elif tag == "li":
            page.block(False)
            mark = "- "
            if lists and lists[-1] is not None:
                if re.fullmatch(r"-?\d{1,9}", attrs.get("value", "")):
                    lists[-1] = int(attrs["value"])
                mark = f"{lists[-1]}. "
                lists[-1] += 1
            page.indent.append([mark, " " * len(mark)])

            def leave(page=page):
                page.block(False)
                page.indent.pop()

        elif tag in ("blockquote", "dd"):
            page.block(tag == "blockquote")
            page.indent.append(["    ", "    "])

            def leave(page=page, tag=tag):
                page.block(tag == "blockquote")
                page.indent.pop()

        elif tag in _BLOCK:
            page.block(tag in _MARGIN)

            def leave(page=page, tag=tag):
                page.block(tag in _MARGIN)

        if leave:
            todo.append((None, leave))
        for child in reversed(children):
            todo.append((child, pre, shown))
        if tag == "pre" and children and isinstance(children[0], str):  # its first line feed is not shown
            todo[-1] = (children[0].removeprefix("\n"), pre, shown)
    page = pages[0]
    page.flush()
    return "\n".join(page.lines).strip("\n")


def extract(html: str | None) -> str:
    """The visible text of a page."""
    return render(parse(html)) if html else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) for every row."""
    rows = pages.select(F.col(id_col), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [extract(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string")
