"""Operator 5: layout-aware text of HTML pages.

A tree builder with implied end tags makes a tree of elements; visibility rules
drop what a reader would not see; a renderer emits all visible text: blocks on lines of
their own (with a blank line between paragraphs), list items with bullets or numbers, table cells aligned in columns,
preformatted text as it is.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML, by element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template iframe object svg annotation annotation-xml datalist audio video canvas area base link meta param source track rp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption thead tbody tfoot tr ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
#: Which open elements the start of an element ends, and what it looks no further up than.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "body": ({"head"}, {"html"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "a": ({"a"}, {"td", "th", "table", "body"}),
}
#: What stands straight in a table or its rows, and what does in a head; anything else moves before the table, or ends the head.
_TABLE = frozenset("table tbody thead tfoot tr".split())
_OF_TABLE = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
_STAYS = _OF_TABLE | frozenset("script style template".split())
_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
_P_ENDS = BLOCKS - {"html", "body", "li", "dd", "dt", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "legend"}
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_COMMENT_END = re.compile(r"--!?>|(?<=<!-)->|(?<=<!--)>")
#: Elements whose marks are text up to their own end (none ends plaintext), and inputs that show nothing of their value.
_TEXT_ONLY = frozenset("textarea xmp plaintext".split())
_MUTE = frozenset("hidden checkbox radio password file image color range".split())
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds a tree of ``Node`` and strings from any input; nothing raises."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.stack = [self.root]
        #: Places in the stack of the open elements of each tag, rising.
        self.open: dict[str, list[int]] = defaultdict(list)
        self.depth = 1

    def _push(self, node: Node) -> None:
        self.open[node.tag].append(len(self.stack))
        self.stack.append(node)
        self.depth = max(self.depth, len(self.stack))

    def _cut(self, at: int) -> None:
        """Closes the open elements from ``at`` on."""
        while len(self.stack) > at:
            self.open[self.stack.pop().tag].pop()

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 without one."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment ends at ``-->`` (also ``--!>``), at once if it begins with one, and with the page if nothing ends it."""
        end = _COMMENT_END.search(self.rawdata, i + 2 if self.rawdata.startswith(("<!-->", "<!--->"), i) else i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` and what follows is a comment up to the next ``>``, whatever it says."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def _end(self, tags: set[str], stop: set[str]) -> None:
        border = self._last(stop - tags)
        while (k := self._last(tags)) > border:
            self._cut(k)

    def _leave(self, head: bool, columns: bool) -> None:
        if head and self.stack[-1].tag == "head" or columns and self.stack[-1].tag == "colgroup":
            self._cut(len(self.stack) - 1)

    def _table(self) -> int:
        """Place of the innermost open table, 0 without one."""
        return self._last(("table",))

    def _before(self, at: int, child: Node | str) -> None:
        holder = self.stack[at - 1].children
        holder.insert(len(holder) - 1, child)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._leave(tag not in _HEAD, tag not in ("col", "template"))
        if tag in _OF_TABLE:
            # What was moved before the table ends here.
            k = self._last((*_TABLE, "td", "th", "caption"))
            if self.stack[k].tag in _TABLE:
                self._cut(k + 1)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "table" and self.stack[-1].tag in _TABLE and (at := self._table()):
            self._cut(at)
        if tag in _P_ENDS:
            self._end({"p"}, {"td", "th", "table", "button", "object", "li"} - {tag})
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.handle_starttag("tr", [])
        node = Node(tag, dict(attrs))
        at = self._table() if self.stack[-1].tag in _TABLE and tag not in _STAYS else 0
        if at and tag == "form":
            return
        self._before(at, node) if at else self.stack[-1].children.append(node)
        if tag not in VOID:
            self._push(node)
        if tag in _TEXT_ONLY:
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        k = self._last((tag,))
        border = 0 if tag in ("table", "tr", "tbody", "thead", "tfoot", "html", "body") else self._last(("td", "th", "table"))
        if k and k >= border:
            self._cut(k)

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag == "textarea":
            data = unescape(data)  # marks are text there, references are not
        if data.strip():
            self._leave(True, True)
            if self.stack[-1].tag in _TABLE and (at := self._table()):
                self._before(at, data)  # text straight inside a table stands before it
                return
        self.stack[-1].children.append(data)


def _style(node: Node) -> dict[str, str]:
    """display and visibility of an inline style, as far as it says."""
    return {k.lower(): v.lower() for k, v in _DECLARATION.findall(node.attrs.get("style") or "")}


def _dropped(node: Node, style: dict[str, str]) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs or style.get("display") == "none":
        return True
    return node.tag == "input" and (node.attrs.get("type") or "").lower() in _MUTE or node.tag == "dialog" and "open" not in node.attrs


def prune(root: Node) -> None:
    """Takes out what is not seen: elements without display with all they hold, and of those of hidden visibility their own text and marks, but no visible descendants."""
    todo, order = [(root, True)], []
    while todo:
        node, shown = todo.pop()
        kept = []
        # A closed details element shows its first summary alone.
        folded = node.tag == "details" and "open" not in node.attrs
        summary = next((c for c in node.children if isinstance(c, Node) and c.tag == "summary"), None) if folded else None
        for c in node.children:
            if isinstance(c, str):
                if shown and not folded:
                    kept.append(c)
                continue
            style = _style(c)
            if _dropped(c, style) or folded and c is not summary:
                continue
            if style.get("display") in ("block", "flex", "grid", "table") and c.tag not in BLOCKS | VOID | {"textarea"}:
                c.tag = "div"
            said = style.get("visibility")
            seen = said == "visible" if said in ("visible", "hidden", "collapse") else shown
            if seen or c.tag not in ("img", "input", "br"):
                kept.append(c)
                todo.append((c, seen))
        node.children = kept
        order.append((node, shown))
    hollow = set()
    for node, shown in reversed(order):
        node.children = [c for c in node.children if isinstance(c, str) or id(c) not in hollow]
        if not shown:
            node.attrs = {}
            if node.tag in ("li", "hr"):
                node.tag = "div"
            if not node.children:
                hollow.add(id(node))


class _Lines:
    """Finished lines and the one being filled; runs of white space count as one space."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False

    def text(self, s: str) -> None:
        words = _SPACE.sub(" ", s)
        if not words:
            return
        if words[0] == " ":
            self.space = True
            words = words[1:]
        if words:
            end = words[-1] == " "
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(words[:-1] if end else words)
            self.space = end

    def brk(self) -> None:
        self.lines.append("".join(self.now))
        self.now, self.space = [], False

    def block(self, spaced: bool = False) -> None:
        if self.now:
            self.brk()
        self.space = False
        if spaced and self.lines and self.lines[-1]:
            self.lines.append("")

    def done(self) -> list[str]:
        self.block()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines[next((k for k, x in enumerate(self.lines) if x), 0) :]


def _number(value: str | None, other: int) -> int:
    found = _NUMBER.match(value or "")
    return int(found[1]) if found else other


def _span(value: str | None, most: int) -> int:
    return min(max(_number(value, 1), 1), most)


def _table_lines(node: Node) -> list[str]:
    """Rows of cells, each column as wide as its widest line; cells of several columns are not counted for widths. A cell of several rows holds its columns free below itself."""
    groups, captions = [[]], []
    for c in node.children:
        if isinstance(c, str):
            continue
        if c.tag in ("thead", "tbody", "tfoot"):
            groups += [[r for r in c.children if not isinstance(r, str) and r.tag == "tr"], []]
            captions += [line for r in c.children if not isinstance(r, str) and r.tag == "caption" for line in _lines_of(r)]
        elif c.tag == "tr":
            groups[-1].append(c)
        elif c.tag == "caption":
            captions += _lines_of(c)
    rows: list[list[tuple[int, int, list[str]]]] = []
    for group in groups:
        until: dict[int, int] = {}  # rows that a column is still taken for
        for tr in group:
            at, cells, taken = 0, [], {k: n - 1 for k, n in until.items() if n > 1}
            for x in tr.children:
                if isinstance(x, str) or x.tag not in ("td", "th"):
                    continue
                while until.get(at, 0) > 0:
                    at += 1
                wide = _span(x.attrs.get("colspan"), 1000)
                high = len(group) if _number(x.attrs.get("rowspan"), 1) == 0 else _span(x.attrs.get("rowspan"), len(group))
                cells.append((at, wide, _lines_of(x)))
                if high > 1:
                    taken |= dict.fromkeys(range(at, at + wide), high - 1)
                at += wide
            until = taken
            rows.append(cells)
    width: dict[int, int] = {}
    for row in rows:
        for at, wide, lines in row:
            if wide == 1:
                width[at] = max([width.get(at, 0), *map(len, lines)])
    left, start, at = [], 0, 0
    for at in range(max(width, default=-1) + 1):  # where a column begins; columns of wide cells only have no width
        left.append(start)
        start += width[at] + 2 if at in width else 0
    out = list(captions)
    for row in rows:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for at, _, lines in row:
                begin = left[at] if at < len(left) else start
                line = line.ljust(begin) if len(line) + 2 <= begin or not line else line + "  "
                line += lines[k] if k < len(lines) else ""
            out.append(line.rstrip())
    return out


def _lines_of(node: Node) -> list[str]:
    out = _Lines()
    _walk(node, out)
    return out.done()


def _walk(node: Node, out: _Lines) -> None:
    """Render children, with a stack of our own: depth of nesting has no bound. Ordered items are numbered from ``start``."""
    todo: list[tuple] = [("children", node)]
    while todo:
        what, n, *more = todo.pop()
        if what == "close":
            out.block(n in SPACED)
            continue
        if what == "children":
            for c in reversed(list(_numbered(n))):
                todo.append(c)
            continue
        if isinstance(n, str):
            out.text(n)
        elif n.tag == "br":
            out.brk()
        elif n.tag in ("img", "input"):
            if shown := n.attrs.get("alt" if n.tag == "img" else "value"):
                out.text(shown)
        elif n.tag in ("pre", "listing") or n.tag in _TEXT_ONLY:
            out.block(True)
            out.lines += "".join(_raw(n)).strip("\n").split("\n")
            out.block(True)
        elif n.tag == "table":
            out.block(True)
            out.lines += _table_lines(n)
            out.block(True)
        elif n.tag == "li":
            out.block()
            lines = _lines_of(n)
            mark = more[0]
            out.lines += [(mark if k == 0 else " " * len(mark)) + x if x else x for k, x in enumerate(lines or [""])]
        elif n.tag in BLOCKS:
            out.block(n.tag in SPACED)
            todo.append(("close", n.tag))
            todo.append(("children", n))
        else:
            todo.append(("children", n))


def _numbered(n: Node) -> Iterator[tuple]:
    """Children, items with their marks: numbers from ``start`` on, falling if ``reversed``; an item's ``value`` sets its own."""
    items = sum(isinstance(c, Node) and c.tag == "li" for c in n.children) if n.tag == "ol" else 0
    step = -1 if "reversed" in n.attrs else 1
    number = _number(n.attrs.get("start"), items if step < 0 else 1)
    for c in n.children:
        mark = ""
        if isinstance(c, Node) and c.tag == "li":
            number = _number(c.attrs.get("value"), number)
            mark = f"{number}. " if n.tag == "ol" else "- "
            number += step
        yield "node", c, mark


def _raw(n: Node) -> Iterator[str]:
    todo: list = [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif x.tag == "br":
            yield "\n"
        else:
            todo += reversed(x.children)


def render(html: str | None) -> str:
    """All visible text of a page. Null and empty pages have none; broken markup is read as far as it goes, however deep it nests."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    if builder.cdata_elem and builder.rawdata:  # text that nothing ended
        builder.handle_data(builder.rawdata)
    prune(builder.root)
    before = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(before, 1000 + 8 * builder.depth))
        return "\n".join(_lines_of(builder.root))
    finally:
        sys.setrecursionlimit(before)


def page_texts(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add ``text_col`` to every row of ``pages`` (replacing a column of that name). Repeated rows stay; an empty table gives none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([render(x) for x in html], dtype=object)

    return pages.withColumn(text_col, F.pandas_udf(run, "string")(F.col(html_col).cast("string")))
