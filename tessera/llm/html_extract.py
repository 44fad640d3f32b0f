"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout-aware text renderer."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Deeper elements become siblings, as browsers do at a similar depth.
MAX_DEPTH = 200

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]++|\"[^\"]{0,65536}+\"|'[^']{0,65536}+')*+)>"
    r"|<(?P<loose>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_MEDIA = re.compile(r"@media\b([^{};]*)\{", re.I)
_BRACE = re.compile(r"[{}]")
#: Media queries that hold on every screen; what hides only on some screens or in print is shown.
_ON_SCREENS = frozenset(["", "all", "screen", "only all", "only screen", "not print"])
_SPACES = re.compile(r"[ \t\n\r\f]+")
_SIMPLE = re.compile(r"(?:[a-zA-Z][\w-]*)?(?:[.#][\w-]+)?\Z")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements of which nothing is shown.
UNSEEN = frozenset(
    "head script style title meta link base template noscript noembed noframes iframe object audio video canvas datalist param source track colgroup area".split()
)
#: In svg and math, nothing is shown of these either.
_UNSEEN_DRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient annotation annotation-xml".split())
#: Inputs that show their value or else their placeholder.
_SHOWN_INPUTS = frozenset(["", "text", "search", "tel", "url", "email", "number", "submit", "button", "reset"])
BLOCK = frozenset(
    "address article aside body blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption listing xmp search".split()
)
#: Blocks with an empty line before and after.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul dir listing xmp fieldset".split())
_CLOSES_P = BLOCK - frozenset("body html option optgroup dd dt legend caption td th tr tbody thead tfoot li summary".split())
#: A start tag ends an open element of these names, unless one of the barriers stands between.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
#: No implied end reaches beyond these.
_SCOPE = frozenset("table td th caption button object template html".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "seen")

    def __init__(self, tag: str, attrs: dict[str, str], seen: bool):
        self.tag, self.attrs, self.children, self.seen = tag, attrs, [], seen


def _attributes(raw: str) -> dict[str, str]:
    if not raw or not raw.strip(" \t\n\r\f/"):
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _for_screens(css: str) -> str:
    """The style sheet without its ``@media`` blocks that do not hold on every screen."""
    parts, at = [], 0
    while found := _MEDIA.search(css, at):
        parts.append(css[at : found.start()])
        at = found.end()
        if any(" ".join(q.lower().split()) in _ON_SCREENS for q in found[1].split(",")):
            continue  # the end of the block is a brace too many, which no rule takes in
        depth, end = 1, len(css)
        for brace in _BRACE.finditer(css, at):
            depth += 1 if brace[0] == "{" else -1
            if not depth:
                end = brace.end()
                break
        at = end
    return "".join([*parts, css[at:]])


class _Sheet:
    """The rules of style sheets that hide: display and visibility by element, class or id."""

    def __init__(self):
        self.rules: dict[str, dict[str, str]] = {}

    def add(self, css: str) -> None:
        for selectors, body in _RULE.findall(_for_screens(re.sub(r"/\*.*?\*/", "", css, flags=re.S))):
            found = _declarations(body)
            if found:
                for one in selectors.split(","):
                    one = one.strip()
                    if one and _SIMPLE.match(one):
                        self.rules.setdefault(one.lower(), {}).update(found)

    def of(self, tag: str, attrs: dict[str, str]) -> dict[str, str]:
        if not self.rules:
            return {}
        names = [tag]
        for c in attrs.get("class", "").lower().split():
            names += [f".{c}", f"{tag}.{c}"]
        if "id" in attrs:
            names += [f"#{attrs['id'].lower()}", f"{tag}#{attrs['id'].lower()}"]
        out: dict[str, str] = {}
        for n in names:
            out.update(self.rules.get(n, {}))
        return out


def _declarations(style: str) -> dict[str, str]:
    out = {}
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        name = name.strip()
        if name in ("display", "visibility"):
            out[name] = value.replace("!important", "").strip()
    return out


def build(html: str) -> Node:
    """The document's tree, with tags that may be left out put in; elements that are not shown are left out."""
    root = Node("html", {}, True)
    stack, sheet = [root], _Sheet()
    at, size = 0, len(html)

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(unescape(raw) if "&" in raw else raw)

    def end_implied(names: set[str], barriers) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag in names:
                del stack[i:]
                end_implied(names, barriers)
                return
            if tag in barriers:
                return

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        closed = m["close"]
        if closed:
            closed = closed.lower()
            if closed == "br":
                stack[-1].children.append(Node("br", {}, True))
            elif closed == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}, True))
            else:
                inline = closed not in BLOCK
                for i in range(len(stack) - 1, 0, -1):
                    tag = stack[i].tag
                    if tag == closed:
                        del stack[i:]
                        break
                    if inline and tag in ("td", "th", "table", "caption", "button"):
                        break  # an inline end tag does not close the cell around it
                    if tag == "table" and closed not in ("body", "html"):
                        break
            continue
        name = m["open"] or m["loose"]
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag, attrs = name.lower(), _attributes(m["attrs"] if m["open"] else m["rest"])
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            body = html[at : stop.start()] if stop else html[at:]
            at = stop.end() if stop else size
            if stop:
                gt = html.find(">", at)
                at = gt + 1 if gt >= 0 else size
            if tag == "style":
                sheet.add(body)
            if tag in UNSEEN:
                continue
            node = Node("pre" if tag == "xmp" else tag, attrs, stack[-1].seen)
            node.children.append(unescape(body) if tag == "textarea" else body)
            if not _gone(tag, attrs, sheet):
                stack[-1].children.append(node)
            continue
        if tag in ("html", "body"):
            root.attrs.update({k: v for k, v in attrs.items() if k not in root.attrs})
            continue
        if tag in _CLOSES_P:
            end_implied({"p"}, _SCOPE)
        if tag in _IMPLIED:
            end_implied(*_IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            _push(stack, Node("tr", {}, stack[-1].seen))
        if tag == "head" or len(stack) > MAX_DEPTH:
            if tag == "head":
                continue
            del stack[MAX_DEPTH:]
        style = sheet.of(tag, attrs) | (_declarations(attrs["style"]) if "style" in attrs else {})
        seen = stack[-1].seen
        if "visibility" in style:
            seen = style["visibility"] not in ("hidden", "collapse")
        node = Node(tag, attrs, seen)
        if tag in VOID:
            if not _gone(tag, attrs, sheet):
                stack[-1].children.append(node)
            continue
        if _gone(tag, attrs, sheet) or tag in _UNSEEN_DRAWN and any(n.tag in ("svg", "math") for n in stack):
            stack.append(node)  # takes its content, but hangs on nothing
        else:
            _push(stack, node)
    return root


def _push(stack: list[Node], node: Node) -> None:
    stack[-1].children.append(node)
    stack.append(node)


def _gone(tag: str, attrs: dict[str, str], sheet: _Sheet) -> bool:
    if tag in UNSEEN or "hidden" in attrs:
        return True
    if tag == "dialog" and "open" not in attrs or tag == "input" and attrs.get("type", "").lower() == "hidden":
        return True
    style = sheet.of(tag, attrs) | (_declarations(attrs["style"]) if "style" in attrs else {})
    return style.get("display") == "none"


class _Flow:
    """Lines of a block: inline text runs on, blocks start new lines, spaced blocks leave an empty one."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = False

    def text(self, s: str) -> None:
        self.run.append(s)

    def end_line(self) -> None:
        if self.run:
            line = _SPACES.sub(" ", "".join(self.run)).strip(" ")
            self.run = []
            if line:
                self.put([line], False)

    def put(self, lines: list[str], spaced: bool) -> None:
        if not lines:
            return
        if (spaced or self.gap) and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.lines += lines
        self.gap = spaced


def _walk(node: Node, flow: _Flow) -> None:
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if node.seen and not closed:
                flow.text(child)
            continue
        tag = child.tag
        if closed and tag != "summary":
            continue
        if tag == "br":
            if not flow.run or not "".join(flow.run).strip():
                flow.run = []
            else:
                flow.end_line()
        elif tag == "hr":
            flow.end_line()
            flow.put(["---"], True)
        elif tag == "input":
            if child.seen and not closed and child.attrs.get("type", "").lower() in _SHOWN_INPUTS:
                flow.text(f" {child.attrs.get('value') or child.attrs.get('placeholder', '')} ")
        elif tag == "text":  # of svg: drawn somewhere of its own
            flow.text(" ")
            _walk(child, flow)
            flow.text(" ")
        elif tag in BLOCK or tag == "textarea":
            flow.end_line()
            nested = node.tag == "li" and tag in ("ul", "ol", "menu", "dir")  # lists in lists have no margin
            flow.put(_block(child), tag in SPACED and not nested)
        elif tag == "wbr":
            pass
        elif tag == "q":
            flow.text('"')
            _walk(child, flow)
            flow.text('"')
        elif tag not in VOID:
            _walk(child, flow)


def _lines(node: Node) -> list[str]:
    flow = _Flow()
    _walk(node, flow)
    flow.end_line()
    return flow.lines


def _block(node: Node) -> list[str]:
    tag = node.tag
    if tag in ("pre", "listing", "textarea"):
        return _preformatted(node)
    if tag in ("ul", "ol", "menu", "dir"):
        return _list(node)
    if tag == "table":
        return _table(node)
    lines = _lines(node)
    if tag in ("blockquote", "dd"):
        return ["    " + x if x else x for x in lines]
    return lines


def _preformatted(node: Node) -> list[str]:
    parts: list[str] = []

    def gather(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                if n.seen:
                    parts.append(c)
            elif c.tag == "br":
                parts.append("\n")
            else:
                gather(c)

    gather(node)
    text = "".join(parts).replace("\r\n", "\n")
    lines = [x.rstrip() for x in text.removeprefix("\n").split("\n")]
    while lines and not lines[-1]:
        lines.pop()
    return lines


def _number(node: Node, name: str, other: int) -> int:
    try:
        return int(node.attrs[name])
    except (KeyError, ValueError):
        return other


def _list(node: Node) -> list[str]:
    out: list[str] = []
    number = _number(node, "start", 1)
    loose = _Flow()

    def end_loose() -> None:
        loose.end_line()
        out.extend("  " + x if x else x for x in loose.lines)
        loose.lines, loose.gap = [], False

    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            end_loose()
            if node.tag == "ol":
                number = _number(child, "value", number)
                mark = f"{number}. "
                number += 1
            else:
                mark = "- "
            lines = _lines(child)
            if lines:
                pad = " " * len(mark)
                out.append(mark + lines[0])
                out += [pad + x if x else x for x in lines[1:]]
        else:
            holder = Node("span", {}, node.seen)
            holder.children.append(child)
            _walk(holder, loose)
    end_loose()
    return out


def _table(node: Node) -> list[str]:
    head: list[Node] = []
    body: list[Node] = []
    foot: list[Node] = []
    captions: list[str] = []
    loose: list[str] = []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                loose.append(_SPACES.sub(" ", child).strip())
        elif child.tag == "caption":
            captions += _lines(child)
        elif child.tag in ("thead", "tbody", "tfoot"):
            part = {"thead": head, "tbody": body, "tfoot": foot}[child.tag]
            for row in child.children:
                if isinstance(row, Node) and row.tag == "tr":
                    part.append(row)
                elif isinstance(row, Node):
                    loose += _block(row)
                elif row.strip():
                    loose.append(_SPACES.sub(" ", row).strip())
        elif child.tag == "tr":
            body.append(child)
        else:
            loose += _block(child)
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell from above still covers
    for row in [*head, *body, *foot]:
        cells: dict[int, tuple[list[str], int]] = {}
        column, busy = 0, dict(taken)
        fresh: dict[int, int] = {}
        for cell in row.children:
            if isinstance(cell, str):
                if cell.strip():
                    loose.append(_SPACES.sub(" ", cell).strip())
                continue
            if cell.tag not in ("td", "th"):
                loose += _block(cell)
                continue
            while busy.get(column, 0) > 0:
                column += 1
            span, deep = max(1, min(1000, _number(cell, "colspan", 1))), max(1, _number(cell, "rowspan", 1))
            cells[column] = _lines(cell), span
            if deep > 1:
                for c in range(column, column + span):
                    fresh[c] = deep - 1
            column += span
        taken = {c: n - 1 for c, n in busy.items() if n > 1} | fresh
        if any(lines for lines, _ in cells.values()):
            grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for c, (lines, span) in cells.items():
            if span == 1:
                widths[c] = max(widths.get(c, 0), *map(len, lines), 0)
    used = sorted(c for cells in grid for c in cells)
    columns = sorted(set(used))
    place, at = {}, 0
    for c in columns:
        place[c] = at
        at += widths.get(c, 0) + 2
    out = captions[:]
    for cells in grid:
        for k in range(max(len(lines) for lines, _ in cells.values())):
            line = ""
            for c in sorted(cells):
                lines, _ = cells[c]
                if k < len(lines) and lines[k]:
                    if line and len(line) >= place[c]:
                        line += "  "
                    line = line.ljust(place[c]) + lines[k]
            out.append(line.rstrip())
    return [*loose, *out]


def render(html: str | None) -> str:
    """All text that a reader of the page would see, laid out in lines."""
    if not html:
        return ""
    return "\n".join(_lines(build(html)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        html = len(names) - 1
        keep = range(html)
        texts = [render(x.as_py()) for x in batch.column(html)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string())], [*(names[i] for i in keep), "text"])


def extract_html(df: DataFrame, html_col: str = "html", columns: list[str] | None = None) -> DataFrame:
    """Adds ``text``, the visible text of each row's page, to ``columns`` (default: all but the page and ``text``).

    A start tag ends the elements that it cannot lie in, rows are put around bare cells,
    and unclosed elements end with their parents.  Not shown are scripts, styles, heads,
    templates, hidden elements, closed details and dialogs, and what display or visibility
    hides in a style attribute or in a sheet's rule for an element, class or id.  Inputs show
    their value or placeholder, svg and math their text.  Blocks
    start lines, paragraphs and their like leave an empty line, list items have their mark
    and indent, preformatted text stays as it is, table cells stand in aligned columns.

    No shuffle: each page is rendered where it is read, whole, however long; elements nested
    over ``MAX_DEPTH`` deep become siblings and keep their text.  A null or empty page gives an
    empty text; text without tags is text; tags that never end are text too; repeated rows
    come out alike; an empty table gives an empty result.
    """
    kept = columns if columns is not None else [c for c in df.columns if c not in (html_col, "text")]
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    source = df.select(*kept, F.col(html_col).cast("string").alias(f"html_{uuid.uuid4().hex}"))
    return source.mapInArrow(_extract, f"{fields}text string")
