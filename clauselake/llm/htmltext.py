"""Layout-aware text of HTML pages.

A tree builder reads tags with the usual implied ones (paragraphs, list items, cells, rows and table bodies end where a sibling
or an enclosing block begins; stray end tags are ignored), keeps what is visible (no scripts, styles, templates, heads, hidden
attributes or inputs, display:none, embedded objects and media; visibility:hidden unless a descendant is visible again; formulas and
drawings show their text but for titles, descriptions, annotations and definitions), and a renderer lays it out: blocks on
their own lines, paragraphs and headings with blank lines around, lists with bullets or numbers and indents, preformatted
text as it is, and table cells padded to columns, in rows as high as their highest cell. A cell keeps its columns blank in the
rows that it spans, up to the end of its row group; its text stands in the first. Padding ends at WIDE characters: a longer cell keeps
its whole text and moves what follows in its row.

Edge cases: null and empty pages give empty text; text without tags is one paragraph; unclosed comments and tags end with the page;
a quote within an unquoted value does not open a string; elements may be nested to any depth; spans are those of the HTML standard
(columns to 1,000, rows to 65,534, 0 for all of the group); repeated rows are kept; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDE = 400
#: Fixed values of the HTML standard: the largest spans.
COLUMNS, ROWS = 1000, 65_534
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes datalist object audio video canvas desc metadata annotation annotation-xml defs symbol clippath".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary ul xmp caption table tbody thead tfoot tr td th".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre xmp table figure fieldset hr".split())
ENDS_P = BLOCKS - frozenset("html body option optgroup td th tr tbody thead tfoot caption legend summary".split())
#: A start tag ends open elements of these kinds, up to a boundary.
ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption colgroup", "table"),
    "td": ("td th caption", "table tr"),
    "th": ("td th caption", "table tr"),
    "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "thead": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "body": ("head", "html"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
SCOPE = frozenset("table td th caption button object html".split())
NEEDS = {"td": "tr", "th": "tr", "tr": "tbody"}
WITHIN = {"tr": frozenset(["tr"]), "tbody": frozenset(["tbody", "thead", "tfoot"])}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class Builder:
    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.now: Counter[str] = Counter()
        self.depth = 1

    def drop(self, at: int) -> None:
        """Ends the open elements from a place on."""
        for x in self.open[at:]:
            self.now[x.tag] -= 1
        del self.open[at:]

    def close(self, tags: frozenset[str], bounds: frozenset[str]) -> None:
        """Ends the outermost open element of `tags` above the nearest boundary."""
        if not any(self.now[x] for x in tags):
            return
        at = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                at = i
            elif self.open[i].tag in bounds:
                break
        if at is not None:
            self.drop(at)

    def start(self, tag: str, attrs: dict[str, str]) -> Node | None:
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
            return None
        if tag in ENDS_P:
            self.close(frozenset(["p"]), SCOPE)
        if tag in ENDS:
            self.close(*ENDS[tag])
        if (parent := NEEDS.get(tag)) and self.now["table"]:
            near = next((x.tag for x in reversed(self.open) if x.tag in WITHIN[parent] or x.tag == "table"), "table")
            if near == "table":
                self.start(parent, {})
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.drop(len(self.open) - 1)
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.now[tag] += 1
            self.depth = max(self.depth, len(self.open))
        return node

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
            return
        if tag == "p" and not self.now["p"]:
            self.start("p", {})
        if not self.now[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.drop(i)
                return
            if self.open[i].tag in ("table", "td", "th") and tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "body", "html"):
                return


def tree(html: str) -> tuple[Node, int]:
    """The root and the depth of what lies below it."""
    b, at = Builder(), 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            b.open[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            b.open[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            node = b.start(tag, attributes(m[3]) if m[3] else {})
            if tag in RAW and node is not None:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                stop = end.start() if end else len(html)
                raw = html[at:stop]
                node.children.append(unescape(raw) if tag in ("textarea", "title") else raw)
                at = stop
        elif m[1]:
            b.end(m[1].lower())
    return b.root, b.depth


def shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether an element is laid out, and whether its own text is visible."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False, False
    style = a.get("style", "").lower().replace(" ", "")
    if style:
        if "display:none" in style:
            return False, False
        if "visibility:hidden" in style or "visibility:collapse" in style:
            visible = False
        elif "visibility:visible" in style:
            visible = True
    return True, visible


class Layout:
    """Lines of text; text that waits on the last one; blank lines are made only between contents."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = False
        self.lead = ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s.startswith(" ") and self.now:
            self.space = True
        words = s.strip(" ")
        if words:
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(words)
            self.space = s.endswith(" ")

    def line(self) -> None:
        if self.now or self.lead:
            self.put([self.lead + "".join(self.now)])
        self.now, self.space, self.lead = [], False, ""

    def put(self, lines: list[str]) -> None:
        if self.blank and self.lines and lines:
            self.lines.append("")
        if lines:
            self.blank = False
        self.lines += lines

    def gap(self) -> None:
        self.line()
        self.blank = bool(self.lines)


def _flow(children: list, out: Layout, visible: bool) -> None:
    for child in children:
        if isinstance(child, str):
            if visible:
                out.text(child)
            continue
        laid, seen = shown(child, visible)
        if not laid:
            continue
        tag = child.tag
        if tag == "br":
            if out.now or out.lead:
                out.line()
            else:
                out.put([""])
            continue
        if tag not in BLOCKS:
            if tag == "input":
                if seen and child.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                    out.text(f" {child.attrs.get('value', '')} ")
                continue
            _flow(child.children, out, seen)
            continue
        edge = out.gap if tag in SPACED else out.line
        edge()
        if tag == "hr":
            out.put(["---"] if seen else [])
        elif tag in ("pre", "xmp"):
            out.put(_preformatted(child, seen))
        elif tag == "table":
            out.put(_table(child, seen))
        elif tag in ("ul", "ol", "menu", "dir"):
            out.put(_list(child, seen))
        elif tag in ("dd", "blockquote"):
            out.put(["  " + x if x else x for x in rendered(child.children, seen)])
        elif tag in ("td", "th"):
            _flow(child.children, out, seen)
            out.line()
        else:
            _flow(child.children, out, seen)
        edge()


def rendered(children: list, visible: bool) -> list[str]:
    out = Layout()
    _flow(children, out, visible)
    out.line()
    return out.lines


def _preformatted(node: Node, visible: bool) -> list[str]:
    parts: list[str] = []

    def walk(n: Node, seen: bool) -> None:
        for c in n.children:
            if isinstance(c, str):
                if seen:
                    parts.append(c)
            elif c.tag == "br":
                parts.append("\n")
            else:
                laid, own = shown(c, seen)
                if laid:
                    walk(c, own)

    walk(node, visible)
    lines = "".join(parts).replace("\r\n", "\n").split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    return [x.rstrip() for x in lines]


def _list(node: Node, visible: bool) -> list[str]:
    out: list[str] = []
    start = node.attrs.get("start", "1")
    number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            if visible:
                out += [x for x in [_SPACE.sub(" ", child).strip()] if x]
            continue
        laid, seen = shown(child, visible)
        if not laid:
            continue
        if child.tag != "li":
            out += rendered([child], visible)
            continue
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        lines = rendered(child.children, seen)
        if lines:
            out += [mark + lines[0], *(" " * len(mark) + x if x else x for x in lines[1:])]
    return out


def _span(node: Node, name: str, most: int) -> int:
    span = node.attrs.get(name, "1").strip()
    if not re.fullmatch("[0-9]{1,9}", span):
        return 1
    return min(int(span), most)


def _rows(node: Node, visible: bool, groups: list, captions: list) -> None:
    """Rows by group; a cell is (lines, columns, rows)."""
    for child in node.children:
        if isinstance(child, str):
            if visible and child.strip():
                captions += [x for x in [_SPACE.sub(" ", child).strip(" ")] if x]
            continue
        laid, seen = shown(child, visible)
        if not laid:
            continue
        if child.tag in ("tbody", "thead", "tfoot"):
            groups.append([])
            _rows(child, seen, groups, captions)
            groups.append([])
        elif child.tag == "tr":
            cells = []
            for c in child.children:
                if isinstance(c, str):
                    if seen and c.strip():
                        captions += [x for x in [_SPACE.sub(" ", c).strip(" ")] if x]
                    continue
                kept, own = shown(c, seen)
                if kept:
                    lines = rendered(c.children if c.tag in ("td", "th") else [c], own)
                    cells.append((lines, max(_span(c, "colspan", COLUMNS), 1), _span(c, "rowspan", ROWS)))
            groups[-1].append(cells)
        elif child.tag not in ("colgroup", "col"):
            captions += rendered([child], visible)


def _placed(groups: list) -> list[list[tuple[int, int, list[str]]]]:
    """(column, columns, lines) of each row's cells; columns that a cell from above spans are left out."""
    out = []
    for rows in groups:
        taken: dict[int, int] = {}  # rows for which a column is still spanned
        for i, cells in enumerate(rows):
            at, row, new = 0, [], {}
            for lines, columns, down in cells:
                while taken.get(at, 0):
                    at += 1
                row.append((at, columns, lines))
                if down != 1:
                    new |= dict.fromkeys(range(at, at + columns), (down or len(rows) - i) - 1)
                at += columns
            taken = {k: n - 1 for k, n in taken.items() if n > 1} | {k: n for k, n in new.items() if n}
            if row:
                out.append(row)
    return out


def _table(node: Node, visible: bool) -> list[str]:
    groups: list = [[]]
    captions: list[str] = []
    _rows(node, visible, groups, captions)
    rows, widths = _placed(groups), {}
    for cells in rows:
        for at, columns, lines in cells:
            if columns == 1:
                widths[at] = min(max(widths.get(at, 0), *(len(x) for x in lines), 0), WIDE)
    out = list(captions)
    for cells in rows:
        for i in range(max(len(lines) for _, _, lines in cells)):
            parts, upto = [], 0
            for at, columns, lines in cells:
                parts += ["".ljust(widths.get(k, 0)) for k in range(upto, at)]
                width = sum(widths.get(k, 0) for k in range(at, at + columns)) + 3 * (columns - 1)
                parts.append((lines[i] if i < len(lines) else "").ljust(min(width, WIDE)))
                upto = at + columns
            while len(parts) > 1 and not parts[-1].strip():
                parts.pop()
            out.append(" | ".join(parts).rstrip())
    return out


def page_text(html: str | None) -> str:
    if not html:
        return ""
    root, depth = tree(html)
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 8 * depth + 1000))  # three calls a level at most, whose frames lie on the heap
    try:
        lines = rendered(root.children, True)
    finally:
        sys.setrecursionlimit(before)
    return "\n".join(x.rstrip() for x in lines).strip("\n")


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id") -> DataFrame:
    """(page_id, text) per row of pages."""
    C.small_batches(pages.sparkSession)
    text = F.pandas_udf(lambda xs: pd.Series([page_text(x) for x in xs], dtype=object), "string")
    return pages.select(F.col(page_id).alias("page_id"), text(F.col(html).cast("string")).alias("text"))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
