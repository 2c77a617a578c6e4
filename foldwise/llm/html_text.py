"""Visible text of HTML pages, laid out: blocks, lists and aligned tables.

General web pages with an id and a source text.  A tree builder reads the markup
with the implied tags of the HTML standard (a block ends an open paragraph, an item
ends the item before, table parts open what they need), and a renderer walks the
tree without recursion: it skips what is not displayed, collapses white space,
separates blocks by line breaks or empty lines, marks and indents list items, and
sets the cells of a table below each other, padded to the width of their column.

Pages are independent: one pass over the scan, no shuffle, one page at a time in memory.

Text is at most as wide as its table and ``INDENTED`` levels; cells and spans of a table are
kept as they are written, so memory follows the page and not its ``colspan`` numbers.

Defined results: a NULL page gives NULL, an empty one the empty text; repeated rows are
rendered each for itself; broken or unclosed markup is read as far as it goes; an
empty table stays empty; only id and source are read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*>?|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Not displayed at all (fixed list).
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist link meta param svg math".split())
BLOCKS = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table ul xmp").split())
#: Blocks with an empty line before and after.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul dir xmp".split())
_CLOSES_P = (BLOCKS | {"xmp"}) - {"body", "html", "option", "optgroup", "legend"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("table td th caption html template button object".split())
_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
#: A start tag ends these open elements, looked for up to the given ancestors.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}), "thead": (_PARTS, {"table"}), "tbody": (_PARTS, {"table"}),
    "tfoot": (_PARTS, {"table"}), "caption": (_PARTS, {"table"}), "colgroup": (_PARTS, {"table"}),
}


#: Levels of lists and quotes that are indented; deeper ones share the last indent, so output grows with the page.
INDENTED = 32


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(raw: str) -> dict:
    out: dict = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), html.unescape(value))
    return out


class TreeBuilder:
    """Nodes from markup; ``open`` are the elements not yet closed, counted by tag."""

    def __init__(self):
        self.root = Node("html", {})
        self.open, self.counts = [self.root], {"html": 1}

    def _push(self, tag: str, attributes: dict) -> None:
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        self.open.append(node)
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.counts[self.open.pop().tag] -= 1

    def _close(self, tags, scope) -> bool:
        """Close the outermost open element of ``tags`` that no ancestor of ``scope`` shields."""
        if not any(self.counts.get(t) for t in tags):
            return False
        at = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                at = k
            elif self.open[k].tag in scope:
                break
        if at is None:
            return False
        self._pop_to(at)
        return True

    def start(self, tag: str, attributes: dict, closed: bool) -> None:
        if tag == "html":
            return
        if tag == "body":
            self._close({"head"}, ())
            if self.counts.get("body"):
                return
        elif self.counts.get("head") and tag not in HIDDEN and tag != "base":
            self._close({"head"}, ())
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        if tag in _CLOSES_P and self.counts.get("p"):
            self._close({"p"}, _SCOPE)
        if tag in _HEADINGS and self.open[-1].tag in _HEADINGS:
            self._pop_to(len(self.open) - 1)
        if tag in ("td", "th") and self.counts.get("table") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", {})
        self._push(tag, attributes)
        if tag in VOID or closed and tag in ("svg", "math"):
            self._pop_to(len(self.open) - 1)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, True)
        elif tag == "p" and not self.counts.get("p"):
            self._push("p", {})
            self._pop_to(len(self.open) - 1)
        elif tag not in ("body", "html") and self.counts.get(tag):
            scope = {"table"} if tag in _PARTS else () if tag == "table" else _SCOPE - {tag}
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    self._pop_to(k)
                    return
                if self.open[k].tag in scope:
                    return

    def text(self, data: str) -> None:
        if self.counts.get("head") and self.open[-1].tag == "head" and data.strip():
            self._close({"head"}, ())
        self.open[-1].children.append(data)


def build_tree(source: str) -> Node:
    builder, at = TreeBuilder(), 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            data = m[0]
            if data[0] != "<" or data == "<":
                builder.text(html.unescape(data) if "&" in data else data)
            continue
        tag = tag.lower()
        if m[1]:
            builder.end(tag)
            continue
        raw = m[3]
        builder.start(tag, _attributes(raw) if "=" in raw or "hidden" in raw.lower() or "open" in raw.lower() else {}, raw.endswith("/"))
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            end = stop.start() if stop else len(source)
            body = source[at:end]
            builder.text(html.unescape(body) if tag in ("textarea", "title") else body)
            at = end
            if not stop:
                break
    return builder.root


class _Flow:
    """Lines of one formatting context (a page or a table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # an empty line is due
        self.space = False  # a collapsed space is due
        self.prefix: list[str] = []
        self.marker = ""

    def text(self, data: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(data.split("\n")):
                if k:
                    self.end_line(True)
                if part:
                    self.line.append(part)
            return
        parts = _SPACE.split(data)
        if len(parts) > 1 and not parts[0] and self.line:
            self.space = True
        words = [w for w in parts if w]
        if words:
            if self.space and self.line:
                self.line.append(" ")
            self.line.append(" ".join(words))
            self.space = len(parts) > 1 and not parts[-1]

    def end_line(self, forced: bool = False) -> None:
        self.space = False
        if not self.line and not forced:
            return
        body = "".join(self.line).rstrip(" \t") if self.line else ""
        self.line = []
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = "".join(self.prefix[:INDENTED])
        if self.marker:
            lead = lead[:len(lead) - len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append((lead + body).rstrip())

    def break_block(self, spaced: bool) -> None:
        self.end_line()
        if spaced and not self.marker:
            self.blank = True


def _hidden(node: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or node.tag in ("input", "rp") or node.tag == "dialog" and "open" not in a:
        return True
    if not a:
        return False
    style = re.sub(r"\s", "", a.get("style", "").lower())
    return "hidden" in a or "display:none" in style or "visibility:collapse" in style


def _number(text: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(m[1]) if m else default


def _merged(held) -> list[tuple[int, int, int]]:
    """Ranges ``(from, to, row at which they end)`` in order; neighbours that end together are one."""
    out: list[tuple] = []
    for begin, end, last in sorted(held):
        if out and out[-1][1] >= begin and out[-1][2] == last:
            out[-1] = (out[-1][0], max(out[-1][1], end), last)
        else:
            out.append((begin, end, last))
    return out


def _aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table whose cells are ``(text, columns, rows)``."""
    # Where each cell begins; a cell's other columns and rows are never filled in.
    placed, widths, held, more = [], {}, [], []
    for r, row in enumerate(rows):
        if more or any(x[2] <= r for x in held):
            held = _merged(x for x in (*held, *more) if x[2] > r)
        line, c, k, more = [], 0, 0, []
        for text, across, down in row:
            while k < len(held) and held[k][0] <= c:
                c, k = max(c, held[k][1]), k + 1
            if text:
                lines = text.split("\n")
                line.append((c, lines))
                widths[c] = max(widths.get(c, 0), max(map(len, lines)))
            if down > 1:
                more.append((c, c + across, r + down))
            c += across
        placed.append(line)
    starts, at = {}, 0
    for c in sorted(c for c, w in widths.items() if w):
        starts[c], at = at, at + widths[c] + 2
    out = []
    for line in placed:
        line = [(starts[c], lines) for c, lines in line if c in starts]
        for k in range(max((len(lines) for _, lines in line), default=1 if starts else 0)):
            parts, end = [], 0
            for begin, lines in line:
                if k < len(lines) and lines[k]:
                    parts += [" " * (begin - end), lines[k]]
                    end = begin + len(lines[k])
            out.append("".join(parts).rstrip())
    return out


def render(root: Node) -> str:
    """The text of a tree."""
    flow = _Flow()
    flows, lists, tables = [flow], [], []
    # Entries: (node, entering?, preformatted, visible)
    stack: list[tuple] = [(root, True, False, True)]
    while stack:
        node, entering, pre, seen = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if seen:
                flow.text(node.replace("\xa0", " ") if not pre else node, pre)
            continue
        tag = node.tag
        if entering:
            if _hidden(node):
                continue
            if node.attributes.get("style"):
                style = re.sub(r"\s", "", node.attributes["style"].lower())
                seen = False if "visibility:hidden" in style else True if "visibility:visible" in style else seen
            if tag == "br":
                flow.end_line(seen)
                continue
            if tag in BLOCKS or tag in ("caption",):
                flow.break_block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists))
            if tag == "hr":
                if seen:
                    flow.line.append("---")
                flow.break_block(True)
                continue
            pre = pre or tag in ("pre", "textarea", "xmp") or "white-space:pre" in re.sub(r"\s", "", node.attributes.get("style", "").lower())
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", _number(node.attributes.get("start"), 1)])
            elif tag == "li":
                if lists:
                    lists[-1][1] = _number(node.attributes.get("value"), lists[-1][1])
                marker = f"{lists[-1][1]}. " if lists and lists[-1][0] else "- "
                if lists:
                    lists[-1][1] += 1
                flow.prefix.append(" " * len(marker))
                flow.marker = marker if seen else ""
            elif tag in ("dd", "blockquote"):
                flow.prefix.append("  ")
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append(_Flow())
                lists.append([False, 1])
            stack.append((node, False, pre, seen))
            children = node.children
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag == "pre" and children and isinstance(children[0], str):
                children = [children[0].removeprefix("\r").removeprefix("\n"), *children[1:]]
            stack += [(c, True, pre, seen) for c in reversed(children)]
            continue
        if tag in ("td", "th") and tables and len(flows) > 1:
            lists.pop()
            cell = flows.pop()
            cell.end_line()
            across = min(max(1, _number(node.attributes.get("colspan"), 1)), 1000)
            down = min(max(1, _number(node.attributes.get("rowspan"), 1)), 65534)
            tables[-1][-1].append(("\n".join(cell.lines), across, down))
            continue
        if tag == "table":
            flow.end_line()
            for line in _aligned(tables.pop()):
                flow.line.append(line or "")
                flow.end_line(bool(line))
        if tag in BLOCKS or tag == "caption":
            flow.end_line()
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if tag in ("li", "dd", "blockquote"):
                flow.prefix.pop()
                if tag == "li":
                    flow.marker = ""
            flow.break_block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists))
        elif tag in ("button", "select", "label") and flow.line:
            flow.space = True
    flows[0].end_line()
    return "\n".join(flows[0].lines)


def page_text(source: str) -> str:
    """Visible text of one page."""
    return render(build_tree(source.replace("\r\n", "\n").replace("\x00", "")))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: ``id, text``."""
    kind = pages.schema[id_col].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [page_text(h) if h is not None else None for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow), pa.array(texts, type=pa.string())], [id_col, "text"])

    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, text string")
