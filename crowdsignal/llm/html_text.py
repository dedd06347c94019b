"""HTML extraction: a tree with implied tags, visibility rules, and a layout of blocks, lists and aligned tables."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .texts import add_columns

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\r\n\f]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe object video audio canvas datalist noembed noframes".split())
#: Hidden inside a drawing or a formula: what describes it and what it is made from.
_METADATA = frozenset("desc defs metadata symbol annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu".split())
_LISTS = frozenset(("ul", "ol", "menu", "dir"))
_ROW_GROUPS = frozenset(("thead", "tbody", "tfoot"))
#: Open elements that a start tag closes first, up to the given fence.
_CLOSES = {
    "li": (frozenset(("li",)), _LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    "td": (frozenset(("td", "th", "caption")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th", "caption")), frozenset(("table", "tr"))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}
_CLOSES["thead"] = _CLOSES["tfoot"] = _CLOSES["tbody"]
#: A start tag of these closes an open paragraph.
_ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(visible|hidden|collapse)", re.I)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)\Z", re.I)


#: Spaces that align a column, at most, for each visible character of its table; in all, for each character of the page.
PADDING = 8
# The most columns and rows that a cell may span in HTML.
MOST_ACROSS, MOST_DOWN = 1000, 65534


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def _tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of tags; of comments and declarations, with no name. One pass over the page.

    A tag ends at the first ">" outside quotation marks; if there is none, at the first ">" at all. What lies behind the
    last ">" of the page is text, unless a comment is left open there.
    """
    at, last, no_quote = 0, source.rfind(">"), {}
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
            yield at, end, "", "", ""
        elif at > last:
            return
        elif source.startswith(("<!", "<?"), at):
            end = source.find(">", at) + 1
            yield at, end, "", "", ""
        elif m := _NAME.match(source, at):
            end = here = m.end()
            while True:
                end = source.find(">", here)
                quote = min((q for q in (source.find('"', here, max(end, here)), source.find("'", here, max(end, here))) if q >= 0), default=-1)
                if end < 0 or quote < 0:
                    break
                mark = source[quote]
                close = -1 if no_quote.get(mark, len(source)) <= quote + 1 else source.find(mark, quote + 1)
                if close < 0:
                    no_quote[mark] = min(no_quote.get(mark, len(source)), quote + 1)  # none from here on
                    break
                here = close + 1
            if end < 0:
                end = source.find(">", m.end())
            yield at, end + 1, source[at + 1] if source[at + 1] == "/" else "", m[1].lower(), source[m.end() : end]
            end += 1
        else:
            at += 1
            continue
        at = end


class _Stack:
    """The open elements, with the places of each tag among them, so that a search costs what it closes."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags: frozenset) -> int:
        """The place of the innermost open element of these tags; 0 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()


_CELLS = frozenset(("table", "td", "th"))
_P, _P_FENCE = frozenset(("p",)), frozenset(("table", "td", "th", "li", "blockquote", "div", "section", "article", "body"))


def parse(source: str) -> Node:
    """The tree of a page: void and raw-text elements, implied end tags, and end tags that close what is left open."""
    root = Node("#root")
    stack, size = _Stack(root), len(source)
    no_end: dict[str, int] = {}

    def put(text: str) -> None:
        if text:
            stack.nodes[-1].children.append(entities.unescape(text) if "&" in text else text)

    def close_to(names: frozenset, fence: frozenset) -> None:
        lowest = stack.last(names)
        if not lowest or lowest < stack.last(fence - names):
            return
        while lowest - 1 > 0 and stack.nodes[lowest - 1].tag in names:
            lowest -= 1
        stack.cut(lowest)

    shown = 0
    for start, end, slash, tag, attributes in _tags(source):
        if start < shown:  # inside raw text
            continue
        put(source[shown:start])
        shown = end
        if not tag:
            continue
        if slash:
            place = stack.last(frozenset((tag,)))
            if place and (tag in BLOCK or place >= stack.last(_CELLS)):  # inline end tags do not reach out of a cell
                stack.cut(place)
            continue
        if tag in _ENDS_P:
            close_to(_P, _P_FENCE)
        if tag in _CLOSES:
            close_to(*_CLOSES[tag])
        node = Node(tag, {a[1].lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /\n\t") else {})
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            close = None if no_end.get(tag, size) <= end else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, end)
            if not close:
                no_end[tag] = end
            text = source[end : close.start() if close else size]
            node.children.append(entities.unescape(text) if tag in ("textarea", "title") else text)
            shown = close.end() if close else size
        elif tag not in VOID:
            stack.push(node)
    put(source[shown:])
    return root


class _Flow:
    """Lines of text under layout: white space collapses, blocks start lines, margins collapse to the larger one."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.prefix, self.margin, self.space = "", "", 0, False
        self.indents: list[str] = []

    def text(self, s: str, preserve: bool) -> None:
        if preserve:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.word(first)
            for x in rest:
                self.newline()
                self.word(x)
            return
        if not s:
            return
        if s[0] in " \t\r\n\f" and self.line:
            self.space = True
        words = _SPACE.sub(" ", s).strip(" ")
        if words:
            self.word((" " if self.space else "") + words)
            self.space = s[-1] in " \t\r\n\f"

    def word(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.margin == 2 and self.lines:
                self.lines.append("")
            self.margin = 0
            s = (self.prefix or "".join(self.indents)) + s.lstrip(" ") if not self.line and s[:1] == " " and self.space else (self.prefix or "".join(self.indents)) + s
            self.prefix = ""
        self.line += s
        self.space = False

    def newline(self) -> None:
        """A forced line break; an empty line stays one."""
        self.lines.append(self.line.rstrip(" "))
        self.line, self.space = "", False

    def block(self, margin: int) -> None:
        if self.line:
            self.newline()
        self.space = False
        self.margin = max(self.margin, margin)

    def done(self) -> list[str]:
        self.block(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Grid:
    """A table's cells by row and column; cells that span rows keep their columns taken below."""

    def __init__(self):
        self.rows: list[dict[int, list[str]]] = []
        self.column = 0
        self.taken: dict[int, tuple[int, int]] = {}  # first column of a cell that spans rows -> (column after it, last row)
        self.runs: dict[int, tuple[int, int]] = {}  # the same for what several of them take in a row, seen before

    def next_row(self) -> None:
        self.rows.append({})
        self.column = 0

    def place(self, lines: list[str], across: int, down: int) -> None:
        row, start = len(self.rows) - 1, self.column
        last, hops = row + down, 0
        until = 1 << 40
        while True:
            found = self.runs.get(self.column) or self.taken.get(self.column)
            if found is None or found[1] < row:
                found = self.taken.get(self.column)
            if found is None or found[1] < row:
                break
            self.column, until, hops = found[0], min(until, found[1]), hops + 1
        if hops > 1:
            self.runs[start] = (self.column, until)
        self.rows[-1][self.column] = lines
        end = self.column + across
        if across > 1 and self.taken:
            over = self.taken.keys() & set(range(self.column, end))
            end = max([end, *(self.taken[c][0] for c in over if self.taken[c][1] >= row)])
        if down > 1:
            self.taken[self.column] = (self.column + across, last - 1)
        self.column = end


def _width(widths: set[int], lengths: list[int], empty: int, budget: int) -> tuple[int, int]:
    """The widest of ``widths`` to which the ``lengths`` of a column can be padded within ``budget``, and the padding.

    ``empty`` lines have nothing in the column but something after it.

    -2 where not even the gap of an empty cell fits: such a column takes no place in lines that have nothing in it.
    """
    best, cost, below, total = (-2, 0), 0, 0, 0
    for at in sorted(widths):
        while below < len(lengths) and lengths[below] < at:
            total += lengths[below]
            below += 1
        cost = at * below - total + empty * (at + 2)
        if cost > budget:
            break
        best = at, cost
    return best


def _table(rows: list[dict[int, list[str]]], spare: list[int]) -> list[str]:
    """Cells in columns as wide as their widest line, two spaces apart; a cell of several lines takes several lines.

    A column's padding is at most ``PADDING`` times the visible characters and cells of its table, and a page's in all at
    most ``spare``: beyond that a column is as wide as the widest line that keeps to it, and wider cells move what follows
    them. So the text grows with the page, and nothing of it is lost or cut.
    """
    lines: list[list[tuple[int, str]]] = []
    for row in rows:
        cells = sorted(row.items())
        for i in range(max((len(x) for _, x in cells), default=0)):
            lines.append([(c, x[i]) for c, x in cells if i < len(x) and x[i]])
    lengths: dict[int, list[int]] = {}
    widths: dict[int, set[int]] = {}
    weight: dict[int, int] = {}
    for line in lines:
        for c, x in line:
            weight[c] = weight.get(c, 0) + len(x) - x.count(" ") + 4
            widths.setdefault(c, {0}).add(len(x))
        for c, x in line[:-1]:
            lengths.setdefault(c, []).append(len(x))
    ends = sorted(line[-1][0] for line in lines if line)
    place, at, before = {}, 0, -1
    most = PADDING * (sum(weight.values()) + 16)
    for c in sorted(weight):
        bare = 2 * (c - before - 1)  # columns without a visible character in between
        if bare and bare * (cost := len(ends) - bisect_right(ends, before)) <= min(most, spare[0]):
            spare[0] -= bare * cost
            at += bare
        before = c
        own = sorted(lengths.get(c, []))
        beyond = len(ends) - bisect_right(ends, c) - len(own)
        width, cost = _width(widths[c], own, beyond, min(most, spare[0]))
        spare[0] -= cost
        place[c] = at
        at += width + 2
    out = []
    for line in lines:
        parts, used = [], 0
        for c, x in line:
            gap = max(place[c] - used, 2 if used else 0)
            parts += [" " * gap, x]
            used += gap + len(x)
        out.append("".join(parts).rstrip(" "))
    return out


class _Styles:
    """What the page's own style sheets hide: rules of simple selectors (a tag, classes, an id), the last one given counts."""

    def __init__(self, root: Node):
        self.rules: list[tuple[str, frozenset, str, str]] = []
        self.by_key: dict[str, list[int]] = {}
        work: list[Node] = [root]
        while work:
            node = work.pop()
            if node.tag == "style":
                text = re.sub(r"/\*.*?\*/", "", "".join(c for c in node.children if isinstance(c, str)), flags=re.S)
                for selectors, body in _RULE.findall(text):
                    if "display" in body.lower() or "visibility" in body.lower():
                        self._add(selectors, body)
            work.extend(c for c in reversed(node.children) if not isinstance(c, str))

    def _add(self, selectors: str, body: str) -> None:
        for selector in selectors.split(","):
            if (m := _SIMPLE.match(selector.strip())) and (m[1] or m[2]):
                parts = re.findall(r"[.#][\w-]+", m[2])
                ids = [p[1:] for p in parts if p[0] == "#"]
                tag, classes = (m[1] or "*").lower(), [p[1:] for p in parts if p[0] == "."]
                key = f"#{ids[0]}" if ids else f".{classes[0]}" if classes else tag
                self.by_key.setdefault(key, []).append(len(self.rules))
                self.rules.append((tag, frozenset(classes), ids[0] if ids else "", body))

    def of(self, node: Node) -> str:
        """The declarations that hold for an element, its own last. Only rules named by its id, classes or tag are tried."""
        own = node.attributes.get("style", "")
        if not self.rules:
            return own
        classes = frozenset(node.attributes.get("class", "").split())
        keys = ["*", node.tag, f"#{node.attributes.get('id', '')}", *(f".{c}" for c in classes)]
        tried = sorted(i for k in keys for i in self.by_key.get(k, ()))
        said = (self.rules[i] for i in tried)
        return ";".join([*(body for tag, want, id_, body in said if tag in ("*", node.tag) and want <= classes and id_ in ("", node.attributes.get("id", ""))), own])


def _displayed(node: Node, style: str) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() in ("hidden", "password", "checkbox", "radio", "file")):
        return False
    return "display" not in style.lower() or not _NO_DISPLAY.search(style)


def _option(select: Node) -> list[Node | str]:
    """What a list of choices shows: all of a list box, else the selected option or the first."""
    options, work = [], [select]
    while work:
        node = work.pop()
        if node.tag == "option":
            options.append(node)
        else:
            work.extend(c for c in reversed(node.children) if not isinstance(c, str))
    if "multiple" in select.attributes or select.attributes.get("size", "1") not in ("", "0", "1"):
        return [x for o in options for x in (o, " ")]
    return [next((o for o in options if "selected" in o.attributes), options[0])] if options else []


def _span(node: Node, name: str, most: int) -> int:
    given = node.attributes.get(name, "1")
    return max(1, min(int(given), most)) if given.isdigit() and len(given) < 20 else 1


def render(source: str | None) -> str:
    """All visible text of a page, laid out.

    Hidden is what has no display (by tag, attribute, own style or the page's simple style rules) and what is set
    invisible, except what a visible child shows. The walk keeps its own stack, so nesting of any depth is safe. A table's cells are flows of their own; at its end
    the rows are aligned and join the flow around it. Lists are marked "- " or "1. " and indented by two or three.
    """
    if not source:
        return ""
    flows = [_Flow()]
    tables: list[_Grid] = []
    spare = [PADDING * len(source) + 4096]
    lists: list[list] = []
    preserve = drawing = 0
    root = parse(source)
    styles = _Styles(root)
    work: list[tuple[str, Node | str, bool]] = [("open", root, True)]
    while work:
        what, node, shown = work.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if shown:
                flow.text(node, preserve > 0)
            continue
        tag = node.tag
        if what == "open":
            style = styles.of(node)
            if not _displayed(node, style) or (drawing and tag in _METADATA):
                continue
            if said := _VISIBILITY.findall(style):
                shown = said[-1].lower() == "visible"
            if tag == "br":
                flow.newline()
                continue
            if tag == "wbr":
                continue
            if tag in ("img", "input"):
                label = node.attributes.get("alt", "") if tag == "img" else node.attributes.get("value") or {"submit": "Submit", "reset": "Reset"}.get(node.attributes.get("type", "").lower(), "")
                if shown:
                    flow.text(label, False)
                continue
            if tag == "select":
                work.extend(("open", c, shown) for c in reversed(_option(node)))
                continue
            if tag in ("svg", "math"):
                drawing += 1
            if tag in BLOCK and tag not in ("td", "th"):
                flow.block(2 if tag in SPACED and not (tag in _LISTS and lists) else 1)
            if tag in _LISTS:
                start = node.attributes.get("start", "1")
                lists.append([tag == "ol", int(start) if start.isdigit() else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.prefix = (flow.prefix or "".join(flow.indents)) + mark
                flow.indents.append(" " * len(mark))
            elif tag in ("blockquote", "dd"):
                flow.indents.append("  ")
            elif tag in ("pre", "textarea"):
                preserve += 1
            elif tag == "table":
                tables.append(_Grid())
                flows.append(_Flow())  # text outside cells, such as a caption
            elif tag == "tr" and tables:
                tables[-1].next_row()
            elif tag in ("td", "th") and tables:
                if not tables[-1].rows:
                    tables[-1].next_row()
                flows.append(_Flow())
            work.append(("close", node, shown))
            work.extend(("open", c, shown) for c in reversed(node.children))
            continue
        if tag in ("svg", "math"):
            drawing -= 1
        if tag in ("td", "th") and tables:
            tables[-1].place(flows.pop().done(), _span(node, "colspan", MOST_ACROSS), _span(node, "rowspan", MOST_DOWN))
            continue
        if tag == "table":
            outside, grid = flows.pop().done(), tables.pop()
            flow = flows[-1]
            for x in [*outside, *_table(grid.rows, spare)]:
                if x:
                    flow.word(x)
                flow.newline()
        elif tag in _LISTS:
            lists.pop()
        elif tag == "li":
            if flow.prefix:  # an empty item still shows its mark
                flow.word("")
                flow.prefix = ""
            flow.indents.pop()
        elif tag in ("blockquote", "dd"):
            flow.block(1)
            flow.indents.pop()
        elif tag in ("pre", "textarea"):
            preserve -= 1
        if tag in BLOCK:
            flow.block(2 if tag in SPACED and not (tag in _LISTS and lists) else 1)
    return "\n".join(flows[0].done())


def extract_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with a column ``text``: everything a reader sees, with block spacing, list marks and aligned tables.

    A list of choices shows the selected or first one, a button its label, a drawing or formula its text. Work grows with
    a page's length, also for broken markup. Cases: a null or empty page gives an empty text; what does not parse as
    markup is text; unclosed comments and scripts reach to the end; a tag that no ">" closes is text; repeated rows give repeated rows; a kept column named text is replaced; an empty table
    gives no rows.
    """
    return add_columns(pages, html_col, "text string", lambda sources: [(render(x),) for x in sources], keep)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
