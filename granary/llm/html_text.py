"""HTML to text with a tree builder and a layout-aware renderer.

The builder reads tags, comments, and raw text elements as browsers do in the common cases: it closes
elements whose end tags may be left out (p, li, dt, dd, option, table rows, cells and sections), drops
end tags that match nothing, and ends open elements at the end of the input. It also decides what is
visible, once for every element: nothing from head, scripts, styles, templates, embedded objects and
drawings, from elements hidden by attribute or inline style (the last declaration counts, in any case
of letters), from closed ``details`` but their summary, or from closed dialogs; ``visibility`` is
inherited until a descendant sets it anew. What is not visible never enters the tree.

The renderer emits all that is in the tree. White space collapses except in ``pre``; blocks begin on
lines of their own, paragraphs and the like are set off by blank lines; list items carry marks or
numbers (``start``, ``value``, ``reversed`` and ``type`` count) and are indented by depth. Tables are
laid on a grid by row and column spans, and cells are padded so that columns line up, however wide
their cells. Text and elements of a table that are in no cell come before it, as browsers place them,
and are as visible as the table; cells and rows within them belong to the table.

Two rules keep hostile pages within bounds, and neither loses or shows other text. Elements deeper than
``MAX_DEPTH`` keep their visibility and end lines as blocks do, but make no lists and tables. A table
whose padding would be many times its text (``PADDING``) gets a tab between cells instead.

Defined results: a null page gives null text, an empty one an empty text; broken markup is read to its
end; repeated rows are rendered alike; an empty table gives an empty result; a column that has the
output's name is replaced, all others pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import chunks, small_batches

CHUNK_BYTES = 4 << 20
#: The tree is so deep at most; elements below are flattened into the last level.
MAX_DEPTH = 256
#: A table may have so many characters of padding, and so many times its text.
PADDING = (1 << 20, 16)
#: The largest spans that the HTML standard knows.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas svg".split())
HEAD_ONLY = frozenset("base link meta title style script head template noscript".split())
#: Elements that begin and end a line; those in SPACED are set off by a blank line as well.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
LISTS = frozenset("ul ol menu dir".split())
BLOCK_DISPLAYS = frozenset("block flex grid table list-item flow-root".split())
INLINE_DISPLAYS = frozenset("inline inline-block inline-flex inline-grid inline-table contents".split())
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("body html li dd dt option optgroup legend summary".split()) | {"hr"}
#: Beyond these no open paragraph is looked for.
P_HOLDERS = frozenset("td th table li dd dt caption button".split())
#: What a start tag ends, and the elements beyond which it does not look.
ENDS = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
GROUPS = frozenset("thead tbody tfoot colgroup".split())
#: What stands in these and is no part of a table belongs before the table.
INNER = GROUPS | {"table", "tr"}
PARTS = frozenset("caption col colgroup thead tbody tfoot tr td th".split())
CELLS = frozenset("td th table".split())
#: End tags that go through cells.
THROUGH_CELLS = frozenset("table tr tbody thead tfoot body html".split())
#: A start tag of these ends what is open within the nearest of the elements named, as nothing else may hold it.
HOLDERS = {
    **dict.fromkeys(("td", "th"), frozenset("tr thead tbody tfoot table".split())),
    "tr": frozenset("thead tbody tfoot table".split()),
    **dict.fromkeys(("thead", "tbody", "tfoot"), frozenset({"table"})),
}
#: Parts of tables in these stay there.
ISLANDS = frozenset("template noscript svg".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_USED = ("hidden", "style", "start", "value", "colspan", "rowspan", "type", "reversed", "open")
_USED_IN = re.compile("(?i)" + "|".join(_USED))


class Node:
    """gone: not displayed, as nothing within it; shown: whether its own text is visible; block: whether
    it has lines of its own; into: where its content goes; loose: what a table holds outside of cells."""

    __slots__ = ("tag", "attributes", "children", "gone", "shown", "block", "into", "loose", "flat", "summary")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes = tag, attributes or {}
        self.children: list[Node | str] = []
        self.into = self.loose = self.children
        self.gone, self.shown, self.block, self.flat, self.summary = False, True, tag in BLOCKS, False, False


def _attributes(text: str) -> dict[str, str]:
    if not _USED_IN.search(text):
        return {}
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if (name := name.lower()) in _USED:
            found.setdefault(name, unescape(value.strip("\"'")))
    return found


def declared(style: str) -> dict[str, str]:
    """The values of display and visibility that a style attribute sets: of several the last, an
    important one before others."""
    found: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub(" ", style).split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in ("display", "visibility"):
            value, mark, rest = value.strip().lower().partition("!")
            important = bool(mark) and rest.strip() == "important"
            if value.strip() and important >= found.get(name, (False, ""))[0]:
                found[name] = important, value.strip()
    return {name: value for name, (_, value) in found.items()}


class _Builder:
    """The open elements of a page, from the root, and where each tag stands among them."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.where: dict[str, list[int]] = defaultdict(list)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of tags, or 0."""
        return max((w[-1] for t in tags if (w := self.where.get(t))), default=0)

    def cut(self, to: int) -> None:
        """End the open elements from a place on."""
        for node in reversed(self.stack[to:]):
            self.where[node.tag].pop()
            if node.flat and node.block and not node.gone:
                node.into.append(Node("div"))
        del self.stack[to:]

    def close(self, tags: Iterable[str], beyond: Iterable[str]) -> None:
        """End the outermost open element of tags that is not outside one of beyond."""
        found = [w for t in tags if (w := self.where.get(t))]
        if found:
            limit = self.last(beyond)
            to = min((w[i] for w in found if (i := bisect_right(w, limit)) < len(w)), default=0)
            if to:
                self.cut(to)

    def back_to(self, holders: Iterable[str]) -> None:
        """End what is open within the innermost of holders."""
        at = self.last(holders)
        if at and at > self.last(ISLANDS):
            self.cut(at + 1)

    def end(self, name: str) -> None:
        at = self.where[name][-1] if self.where.get(name) else 0
        if at and (name in THROUGH_CELLS or at >= self.last(CELLS)):
            self.cut(at)
        elif name == "br":
            self.add(Node("br"))

    def place(self, tag: str | None) -> tuple[Node, list[Node | str]]:
        """The element whose visibility new content takes, and where the content goes. tag: None for text."""
        top = self.stack[-1]
        if top.tag in INNER and tag not in PARTS and (at := self.last(("table",))) > self.last(ISLANDS):
            table = self.stack[at]
            return table, table.loose
        return top, top.into

    def text(self, text: str) -> None:
        if not text:
            return
        if self.stack[-1].tag == "head" and text.strip():
            self.cut(len(self.stack) - 1)
        parent, into = self.place(None)
        if parent.shown and not parent.gone and not (parent.tag == "details" and "open" not in parent.attributes):
            into.append(text)

    def add(self, node: Node) -> None:
        """Put an element into the tree, unless nothing of it is displayed."""
        parent, into = self.place(node.tag)
        style = node.attributes.get("style")
        styles = declared(style) if style else {}
        display, visibility = styles.get("display"), styles.get("visibility")
        node.gone = (
            parent.gone
            or node.tag in HIDDEN
            or display == "none"
            or ("hidden" in node.attributes and display is None)
            or (node.tag == "dialog" and "open" not in node.attributes)
        )
        if parent.tag == "details" and "open" not in parent.attributes:
            node.gone |= node.tag != "summary" or parent.summary
            parent.summary |= node.tag == "summary"
        node.shown = visibility in ("visible", "initial") or (parent.shown and visibility not in ("hidden", "collapse"))
        node.block = display in BLOCK_DISPLAYS or (node.block and display not in INLINE_DISPLAYS)
        if len(self.stack) >= MAX_DEPTH:
            node.flat, node.into, node.loose = True, into, into
            node.block |= node.tag in PARTS
            if node.gone:
                return
            if node.block:
                into.append(Node("div"))
            elif node.tag in VOID:
                into.append(node)
        else:
            if node.tag == "table":
                node.loose = []
            if not node.gone:
                into.append(node)

    def open(self, node: Node) -> None:
        self.add(node)
        self.where[node.tag].append(len(self.stack))
        self.stack.append(node)


def parse(html: str) -> Node:
    """The tree of what is visible in a page. Children are nodes and strings."""
    made = _Builder()
    at, size = 0, len(html)
    lowered = None
    while at < size:
        open_ = html.find("<", at)
        if open_ < 0:
            made.text(unescape(html[at:]))
            break
        if open_ > at:
            made.text(unescape(html[at:open_]))
        if html.startswith("<!--", open_):
            end = html.find("-->", open_ + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), open_):
            end = html.find(">", open_)
            at = size if end < 0 else end + 1
            continue
        tag = _TAG.match(html, open_)
        if not tag:
            made.text("<")
            at = open_ + 1
            continue
        name = tag[2].lower()
        closed = _TAG_END.match(html, tag.end())
        if closed:
            at = closed.end()
        else:  # an open quote: the tag ends at the next >
            end = html.find(">", tag.end())
            at = size if end < 0 else end + 1
        inside = html[tag.end() : at - 1] if at > tag.end() else ""
        if tag[1]:
            made.end(name)
            continue
        if name in ("html", "body"):
            if name == "body":
                made.close({"head"}, ())
            continue
        if made.stack[-1].tag == "head" and name not in HEAD_ONLY:
            made.cut(len(made.stack) - 1)
        if name in ENDS:
            made.close(*ENDS[name])
        if name in HOLDERS:
            made.back_to(HOLDERS[name])
            if name in ("td", "th") and made.stack[-1].tag in HOLDERS["tr"]:
                made.open(Node("tr"))
        if name in ENDS_P:
            made.close({"p"}, P_HOLDERS)
        node = Node(name, _attributes(inside) if inside else None)
        if name in RAW:
            if lowered is None:
                lowered = html.lower()
                if len(lowered) != size:  # a letter whose lower case is longer
                    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), html)
            end = lowered.find(f"</{name}", at)
            end = size if end < 0 else end
            raw = html[at:end]
            made.open(node)
            made.text(unescape(raw) if name in ("textarea", "title") else raw)
            made.cut(len(made.stack) - 1)
            gt = html.find(">", end)
            at = size if gt < 0 else gt + 1
        elif name in VOID or (inside.endswith("/") and name in ("svg", "path")):
            made.add(node)
        else:
            made.open(node)
    made.cut(1)
    return made.root


class _Lines:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # a space is due before the next word
        self.blank = False  # a blank line is due before the next line
        self.marks: list[str] = []  # prefixes that the next line starts with
        self.indent = ""

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if not words:
            return
        if words[0] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        if self.space and self.now:
            self.now.append(" ")
        self.space = words[-1] == " "
        self.now.append(words[:-1] if self.space else words)

    def plain(self, text: str) -> None:
        """Preformatted text."""
        first, *rest = text.split("\n")
        self.now.append(first)
        for line in rest:
            self.end(keep=True)
            self.now.append(line)

    def end(self, keep: bool = False) -> None:
        """End the line; an empty one stays only if keep."""
        self.space = False
        line = "".join(self.now)
        self.now = []
        if not line.strip() and not keep:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        mark = "".join(self.marks)
        self.marks = []
        self.lines.append((self.indent[: max(0, len(self.indent) - len(mark))] + mark + line).rstrip())

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def _number(value: str | None, default: int) -> int:
    try:
        return int(value) if value is not None and len(value) < 10 else default
    except ValueError:
        return default


def _rows(table: Node) -> list[list[list[Node]]]:
    """The cells of each row, by sections of the table."""
    sections: list[list[list[Node]]] = [[]]
    for child in table.children:
        if child.tag == "tr":
            sections[-1].append([c for c in child.children if not isinstance(c, str) and c.tag in ("td", "th")])
        elif child.tag in GROUPS:
            own = [c for c in child.children if not isinstance(c, str) and c.tag == "tr"]
            sections += [[[c for c in r.children if not isinstance(c, str) and c.tag in ("td", "th")] for r in own], []]
    return sections


def _grid(rows: list[list[Node]]) -> list[list[tuple[int, Node]]]:
    """Each row's cells with the columns in which they begin; what spans rows pushes the cells of later rows."""
    out: list[list[tuple[int, Node]]] = []
    spans: list[tuple[int, int, int]] = []  # first column, column after the last, last row of cells from rows above
    runs, min_last = _taken(spans)  # the columns that they take, and the first row in which one of them ends
    for r, row in enumerate(rows):
        placed, column, k = [], 0, 0
        if row and spans and min_last < r:
            spans = [s for s in spans if s[2] >= r]
            runs, min_last = _taken(spans)
        fresh = []
        for cell in row:
            while k < len(runs) and runs[k][0] <= column:
                column = max(column, runs[k][1])
                k += 1
            placed.append((column, cell))
            width = min(max(1, _number(cell.attributes.get("colspan"), 1)), MAX_COLSPAN)
            height = min(max(0, _number(cell.attributes.get("rowspan"), 1)), MAX_ROWSPAN)
            if height != 1:
                fresh.append((column, column + width, r + height - 1 if height else len(rows)))
            column += width
        if fresh:
            spans = sorted(spans + fresh)
            runs, min_last = _taken(spans)
        out.append(placed)
    return out


def _taken(spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], int]:
    """The runs of columns that sorted spans take together, and the row after which the first of them ends."""
    runs: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if runs and start <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], end)
        else:
            runs.append((start, end))
    return runs, min((s[2] for s in spans), default=-1)


def _table(node: Node, out: _Lines) -> None:
    # What is in no row comes first, then captions.
    _render(node.loose, out, False)
    for caption in node.children:
        if caption.tag == "caption":
            out.end()
            _render(caption.children, out, False)
    out.end()
    rows: list[list[tuple[int, list[str]]]] = []
    for section in _rows(node):
        for cells in _grid(section):
            row = []
            for column, cell in cells:
                inner = _Lines()
                _render(cell.children, inner, False)
                row.append((column, inner.result().split("\n")))
            if any(text != [""] for _, text in row):
                rows.append(row)
    widths: dict[int, int] = {}
    for row in rows:
        for column, text in row:
            widths[column] = max(widths.get(column, 0), *map(len, text))
    starts, at = {}, 0
    for column in sorted(widths):
        starts[column] = at
        at += widths[column] + 2
    most = PADDING[0] + PADDING[1] * sum(len(line) for row in rows for _, text in row for line in text)
    lines = [[(starts[c], t[k]) for c, t in row if k < len(t) and t[k]] for row in rows for k in range(max(len(t) for _, t in row))]
    aligned = sum(line[-1][0] for line in lines if line) <= most
    for line in lines:
        size = 0
        for start, text in line:
            if aligned:
                out.now.append(" " * (start - size))
                size = start + len(text)
            elif out.now:
                out.now.append("\t")
            out.now.append(text)
        out.end()


def _mark(kind: str, number: int) -> str:
    """A list number as its type writes it: decimal, letters or Roman numerals."""
    if kind in ("a", "A") and number > 0:
        text = ""
        while number:
            number, digit = divmod(number - 1, 26)
            text = chr(ord(kind) + digit) + text
        return text
    if kind in ("i", "I") and 0 < number < 4000:
        text = ""
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
            text += sign * (number // value)
            number %= value
        return text.upper() if kind == "I" else text
    return str(number)


def _list(node: Node, out: _Lines, pre: bool) -> None:
    ordered, step, kind = node.tag == "ol", 1, node.attributes.get("type", "1")
    first = 1
    if ordered and "reversed" in node.attributes:
        first, step = sum(not isinstance(c, str) and c.tag == "li" for c in node.children), -1
    number = _number(node.attributes.get("start"), first)
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            outer = out.indent
            if not isinstance(child, str) and child.tag in LISTS:
                out.end()
                out.indent += "  "
            _render([child], out, pre)
            out.indent = outer
            continue
        out.end()
        number = _number(child.attributes.get("value"), number) if ordered else number
        mark = f"{_mark(child.attributes.get('type', kind), number)}. " if ordered else "- "
        number += step
        outer = out.indent
        out.indent = outer + " " * len(mark)
        if child.shown:
            out.marks.append(mark)
        before = len(out.lines)
        _render(child.children, out, pre)
        out.end()
        if len(out.lines) == before:
            out.marks = []  # an empty item
        out.indent = outer


def _render(children: list[Node | str], out: _Lines, pre: bool) -> None:
    for child in children:
        if isinstance(child, str):
            out.plain(child) if pre else out.text(child)
            continue
        tag = child.tag
        if tag == "br":
            if out.now:
                out.end()
            else:
                out.end(keep=pre)
            continue
        if not child.block:
            if tag == "table":
                _table(child, out)
            elif tag in LISTS:
                _list(child, out, pre)
            else:
                _render(child.children, out, pre)
            if tag in ("td", "th"):  # a cell outside a table
                out.space = True
            continue
        out.end()
        spaced = tag in SPACED and not (tag in LISTS and out.indent)
        out.blank |= spaced
        if tag == "table":
            _table(child, out)
        elif tag in LISTS:
            _list(child, out, pre)
        else:
            outer = out.indent
            if tag in ("blockquote", "dd"):
                out.indent += "  "
            _render(child.children, out, pre or tag == "pre")
            out.end()
            out.indent = outer
        out.end()
        out.blank |= spaced


def text_of(html: str) -> str:
    out = _Lines()
    _render(parse(html).children, out, False)
    return out.result()


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the visible text of each."""
    fields = [x for x in pages.schema.fields if x.name not in (text_col, html_col)]
    names = [x.name for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, CHUNK_BYTES):
            made = [None if h is None else text_of(h) for h in table["__html"].to_pylist()]
            yield from table.select(names).append_column(text_col, pa.array(made, pa.string())).combine_chunks().to_batches()

    small_batches(pages.sparkSession)
    rows = pages.select(*[F.col(f"`{x}`") for x in names], F.col(html_col).cast("string").alias("__html"))
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(text_col, T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return extract(pages).select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"))
