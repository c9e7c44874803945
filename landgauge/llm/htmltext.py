"""Layout-aware rendering of HTML to plain text.

A tree builder supplies the tags that HTML lets authors leave out; visibility
rules (tags, attributes, inline styles and simple style sheets) decide what is
shown; the renderer walks the tree and emits all visible text with block
spacing, list markers, indents and aligned table cells. Walks use explicit
stacks, so nesting may be of any depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head title script style template noscript meta link base datalist area param rp noembed noframes source track "
    "iframe video audio canvas object colgroup col".split()
)
HEAD_ONLY = frozenset("title meta link base script style template noscript".split())
BLOCK = frozenset(
    "address article aside body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html "
    "legend li main menu nav ol option optgroup p pre search section summary table ul blockquote h1 h2 h3 h4 h5 h6 hr caption tr "
    "tbody thead tfoot dir select textarea".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu dir".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# start tag -> (open elements it closes, elements beyond which it doesn't look)
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
SHOWN_INPUTS = frozenset(["", "text", "search", "url", "tel", "email", "number", "submit", "button", "reset"])
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # the standard's bounds of colspan and rowspan

SPACES = re.compile(r"[ \t\n\r\f]+")
# in style sheets: what holds no rule (comments, strings, comment marks of HTML), and what ends a piece
ASIDE = re.compile(r"""(?s)/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|<!--|-->""")
MARK = re.compile(r"[{};]")
MEDIA = re.compile(r"(not\s+|only\s+)?([a-z-]+)?\s*((?:(?:and\s*)?\([^()]*\)\s*)*)$")
WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*(\d*\.?\d+)(px|em|rem)\s*\)$")
SCREEN_WIDTH = 1280  # pixels of the screen that pages are shown on
SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)$")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds a tree of Nodes and strings; self.root is the html element, self.sheets the text of style elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.body: Node | None = None
        self.stack = [self.root]
        self.open: dict[str, int] = {}  # how many elements of each tag are open
        self.sheets: list[str] = []

    def push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def pop_to(self, at: int) -> None:
        for node in self.stack[at:]:
            self.open[node.tag] -= 1
        del self.stack[at:]

    def in_body(self) -> None:
        """Leaves the head and opens the body, should that be due."""
        if self.open.get("head"):
            self.pop_to(next(i for i, n in enumerate(self.stack) if n.tag == "head"))
        if self.body is None:
            self.body = Node("body", {})
            self.push(self.body)

    def close(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        """Closes the outermost open element of `tags` that no element of `bounds` hides."""
        if not any(self.open.get(t) for t in tags):
            return
        found = -1
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                found = i
            elif self.stack[i].tag in bounds:
                break
        if found > 0:
            self.pop_to(found)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in reversed(attrs)}
        if tag == "html" or tag == "body" and self.body is not None:
            node = self.root if tag == "html" else self.body
            node.attrs = given | node.attrs
            return
        if tag == "head":
            if self.body is None and not self.open.get("head"):
                self.push(Node("head", given))
            return
        if tag == "body":
            self.in_body()
            self.body.attrs = given
            return
        if self.body is None and tag in HEAD_ONLY:
            if not self.open.get("head"):
                self.push(Node("head", {}))
        else:
            self.in_body()
        if tag in CLOSES_P:
            self.close({"p"}, {"table", "td", "th", "button", "caption"})
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if tag in IMPLIED_END:
            self.close(*IMPLIED_END[tag])
        if tag in ("td", "th", "tr") and self.open.get("table"):
            if self.stack[-1].tag == "table":
                self.push(Node("tbody", {}))
            if tag != "tr" and self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                self.push(Node("tr", {}))
        node = Node(tag, given)
        if tag in VOID:
            self.stack[-1].children.append(node)
        else:
            self.push(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in ("html", "body") or not self.open.get(tag):
            if tag == "p":  # an end tag alone stands for an empty paragraph
                self.in_body()
                self.stack[-1].children.append(Node("p", {}))
            return
        parts = ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption")
        bounds = {"table"} if tag in parts else {"td", "th", "table", "caption"}
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag or tag in HEADINGS and self.stack[i].tag in HEADINGS:
                self.pop_to(i)
                return
            if self.stack[i].tag in bounds:
                return

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag == "style":
            if media_holds(self.stack[-1].attrs.get("media", "")):
                self.sheets.append(data)
        elif self.stack[-1].tag not in HEAD_ONLY and (self.body is None or self.open.get("head")):
            if not data.strip(" \t\n\r\f"):
                return
            self.in_body()
        self.stack[-1].children.append(data)


def parse(html: str) -> TreeBuilder:
    builder = TreeBuilder()
    builder.feed(html)
    HTMLParser.close(builder)
    return builder


def declarations(style: str) -> dict[str, str]:
    pairs = (d.partition(":") for d in style.lower().split(";"))
    return {k.strip(): v.replace("!important", "").strip() for k, mark, v in pairs if mark}


def media_holds(query: str) -> bool:
    """Whether a list of media queries surely holds for a screen SCREEN_WIDTH wide.

    Types and widths are judged; what speaks of anything else counts as not holding.
    """

    def one(text: str) -> bool:
        m = MEDIA.match(text)
        if not m:
            return False
        prefix, kind, features = (m[1] or "").strip(), m[2] or "all", re.findall(r"\([^()]*\)", m[3])
        if kind not in ("all", "screen"):
            return prefix == "not"
        known = [WIDTH.match(f) for f in features]
        each = [(float(k[2]) * (1 if k[3] == "px" else 16) <= SCREEN_WIDTH) if k[1] == "min" else (float(k[2]) * (1 if k[3] == "px" else 16) >= SCREEN_WIDTH) for k in known if k]
        if prefix == "not":
            return not all(each)
        return all(known) and all(each)

    return not query.strip() or any(one(q.strip()) for q in query.lower().split(","))


def at_rule_holds(head: str) -> bool:
    """Whether the style rules inside an at-rule count; what is no group of style rules (keyframes, pages, fonts) never does."""
    name, _, rest = re.sub(r"^@([\w-]+)\s*", r"\1 ", head.lower()).partition(" ")
    return name == "layer" or name == "media" and media_holds(rest) or name == "supports" and not re.search(r"\bnot\b", rest)


def rules_in_force(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the style rules of a sheet that hold on a screen; those inside other style rules are left out."""
    sheet = ASIDE.sub(" ", sheet)
    open_blocks: list[str] = []  # "on": a group that holds, "rule": a style rule, "off": neither
    at, selectors, body = 0, "", []
    for m in MARK.finditer(sheet):
        piece, at = sheet[at : m.start()], m.end()
        if m[0] == "{":
            if open_blocks and open_blocks[-1] != "on":
                open_blocks.append("off")
            elif piece.strip().startswith("@"):
                open_blocks.append("on" if at_rule_holds(piece.strip()) else "off")
            else:
                open_blocks.append("rule")
                selectors, body = piece, []
        elif open_blocks and open_blocks[-1] == "rule":
            body.append(piece)
        if m[0] == "}" and open_blocks and open_blocks.pop() == "rule":
            yield selectors, ";".join(body)


def hiding_rules(sheets: list[str]) -> list[tuple[str, frozenset[str], frozenset[str], dict[str, str]]]:
    """(tag, classes, ids, declarations) of the simple selectors that speak of display, visibility or opacity."""
    out = []
    for sheet in sheets:
        for selectors, body in rules_in_force(sheet):
            found = {k: v for k, v in declarations(body).items() if k in ("display", "visibility", "opacity", "content-visibility")}
            for one in selectors.split(",") if found else ():
                m = SIMPLE.match(one.strip())
                if m and m[0]:
                    names = re.findall(r"[.#][\w-]+", m[2])
                    out.append(((m[1] or "").lower(), frozenset(n[1:] for n in names if n[0] == "."), frozenset(n[1:] for n in names if n[0] == "#"), found))
    return out


class Flow:
    """Lines of text with collapsed white space, pending breaks and indents."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.blank = False
        self.indent, self.marker = "", ""

    def text(self, data: str) -> None:
        data = SPACES.sub(" ", data)
        if data.startswith(" "):
            self.space = True
        bare = data.strip(" ")
        if not bare:
            return
        if self.space and self.parts:
            self.parts.append(" ")
        self.parts.append(bare)
        self.space = data.endswith(" ")

    def end_line(self) -> None:
        if self.parts:
            self.put("".join(self.parts))
            self.parts = []
        self.space = False

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = self.indent
        if self.marker:  # the marker takes the place of the innermost indent, once
            lead, self.marker = lead[: len(lead) - len(self.marker)] + self.marker, ""
        self.lines.append((lead + line).rstrip(" "))

    def verbatim(self, data: str) -> None:
        first, *rest = data.split("\n")
        self.parts.append(first)
        for line in rest:
            self.put("".join(self.parts))
            self.parts = [line]


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Aligned lines of rows of (lines of the cell, columns, rows that it spans)."""
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # column -> further rows that a cell above covers
    widths: dict[int, int] = {}
    for row in rows:
        line, column, covered = {}, 0, {c: n - 1 for c, n in taken.items() if n > 1}
        for cell, across, down in row:
            while column in taken:
                column += 1
            line[column] = cell
            if across == 1:
                widths[column] = max(widths.get(column, 0), max(map(len, cell), default=0))
            for c in range(column, column + across):
                if down > 1:
                    covered[c] = down - 1
            column += across
        taken = covered
        grid.append(line)
    shown = sorted(set(widths) | {c for line in grid for c in line})
    starts, at = {}, 0
    for c in shown:
        starts[c] = at
        at += widths.get(c, 0) + 2 * (widths.get(c, 0) > 0)
    out = []
    for line in grid:
        for i in range(max((len(cell) for cell in line.values()), default=0)):
            text = ""
            for c in sorted(line):
                if i < len(line[c]) and line[c][i]:
                    lead = starts[c]
                    text = text.ljust(lead) if len(text.rstrip(" ")) + (2 if text else 0) <= lead else text + "  "
                    text += line[c][i]
            out.append(text.rstrip(" "))
    return out


def number(value: str | None, most: int) -> int:
    digits = re.match(r"\s*(\d{1,9})", value or "")
    return min(max(int(digits[1]), 1), most) if digits else 1


class Renderer:
    def __init__(self, builder: TreeBuilder) -> None:
        self.root, self.rules = builder.root, hiding_rules(builder.sheets)
        self.flow = Flow()
        self.outer: list[Flow] = []
        self.tables: list[list[list[tuple[list[str], int, int]]]] = []
        self.lists: list[int | None] = []

    def style(self, node: Node) -> dict[str, str]:
        """Declarations that bear on visibility; inline ones win."""
        found: dict[str, str] = {}
        if self.rules:
            classes = set(node.attrs.get("class", "").split())
            for tag, wanted, ids, given in self.rules:
                if (not tag or tag == node.tag) and wanted <= classes and ids <= {node.attrs.get("id", "")}:
                    found |= given
        if "style" in node.attrs:
            found |= declarations(node.attrs["style"])
        return found

    def render(self) -> str:
        # entries: (node or text, visible, preformatted), or an exit action to call
        todo: list = [(self.root, True, False)]
        while todo:
            item = todo.pop()
            if callable(item):
                item()
                continue
            node, seen, pre = item
            if isinstance(node, str):
                if seen:
                    self.flow.verbatim(node.replace("\r\n", "\n")) if pre else self.flow.text(node)
                continue
            if node.tag in UNSEEN or "hidden" in node.attrs:
                continue
            style = self.style(node) if self.rules or "style" in node.attrs else {}
            if style:
                if style.get("display") == "none" or style.get("content-visibility") == "hidden" or re.fullmatch(r"0*\.?0+%?", style.get("opacity", "1")):
                    continue
                if style.get("visibility") in ("hidden", "collapse"):
                    seen = False
                elif style.get("visibility") == "visible":
                    seen = True
            children = node.children
            if node.tag == "dialog" and "open" not in node.attrs:
                continue
            if node.tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            leave = self.enter(node, seen, pre)
            if leave:
                todo.append(leave)
            inner = pre or node.tag in ("pre", "textarea", "listing")
            if inner and not pre and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]  # a line break right after the start tag doesn't count
            todo += [(c, seen, inner) for c in reversed(children)]
        self.flow.end_line()
        return "\n".join(self.flow.lines)

    def enter(self, node: Node, seen: bool, pre: bool):
        """Layout at the start of an element; returns what is to be done at its end."""
        flow, tag = self.flow, node.tag
        if tag == "br":
            if flow.parts:
                flow.end_line()
            elif seen:
                flow.blank = True
            return None
        if tag == "input":
            if seen and node.attrs.get("type", "").strip().lower() in SHOWN_INPUTS and node.attrs.get("value"):
                flow.text(f" {node.attrs['value']} ")
            return None
        if tag == "q" and seen:
            flow.text('"')
            return lambda: self.flow.parts.append('"')
        if tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.outer.append(flow)
            self.flow = Flow()
            return lambda: self.leave_cell(node)
        if tag == "tr" and self.tables:
            self.tables[-1].append([])
            return None
        if tag == "table":
            flow.end_line()
            flow.blank = True
            self.tables.append([])
            return self.leave_table
        if tag in ("tbody", "thead", "tfoot") or tag not in BLOCK:
            return None
        spaced = tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and self.lists)
        flow.end_line()
        flow.blank = flow.blank or spaced
        added, listed = "", False
        if tag in ("ul", "ol", "menu", "dir"):
            start = re.match(r"\s*(-?\d{1,9})", node.attrs.get("start", ""))
            self.lists.append((int(start[1]) if start else 1) if tag == "ol" else None)
            listed = True
        elif tag == "li":
            count = self.lists[-1] if self.lists else None
            flow.marker = "- " if count is None else f"{count}. "
            if count is not None:
                self.lists[-1] = count + 1
            added = " " * len(flow.marker)
        elif tag in ("dd", "blockquote"):
            added = "  "
        flow.indent += added

        def leave() -> None:
            flow.end_line()
            flow.blank = flow.blank or spaced
            flow.indent = flow.indent[: len(flow.indent) - len(added)]
            if tag == "li":
                flow.marker = ""
            if listed:
                self.lists.pop()

        return leave

    def leave_cell(self, node: Node) -> None:
        cell = self.flow
        cell.end_line()
        self.flow = self.outer.pop()
        if self.tables:
            self.tables[-1][-1].append((cell.lines, number(node.attrs.get("colspan"), MOST_COLUMNS), number(node.attrs.get("rowspan"), MOST_ROWS)))

    def leave_table(self) -> None:
        rows, flow = self.tables.pop(), self.flow
        flow.end_line()
        for line in table_lines(rows):
            flow.put(line)
        flow.blank = True


def html_to_text(html: str | None) -> str:
    """All visible text of a page, laid out in lines; null and empty give the empty text."""
    return Renderer(parse(html)).render() if html else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds `text`, the visible text, to every row; a column of that name is replaced.

    Null or empty html gives the empty text. A broken page never fails: stray
    end tags are passed over and open elements end with the page.
    """
    keep = [c for c in pages.columns if c not in ("text", html_col)]
    source = pages.select(*keep, F.col(html_col).cast("string").alias(html_col))
    schema = source.drop(html_col).schema.add("text", "string")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(keep))]
            texts = pa.array([html_to_text(h) for h in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, texts], names=[*keep, "text"])

    return source.mapInArrow(render, schema)
