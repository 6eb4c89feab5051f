"""Visible text of HTML pages, laid out.

A tokenizer feeds a tree builder that closes elements whose end tags are implied. Visibility rules drop
elements that a browser does not show. The renderer writes the rest: blocks on lines of their own,
paragraphs and headings with an empty line around, lists with bullets or numbers and indents, table cells
in aligned columns, preformatted text as it is.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import text_of

VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = re.compile(r"script|style|textarea|title|xmp|iframe|noembed|noframes")
HIDDEN = set("head script style template noscript title iframe noembed noframes object svg math datalist option textarea audio video canvas".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hr html legend "
    "li main nav ol p pre section summary table tbody td tfoot th thead tr ul h1 h2 h3 h4 h5 h6 caption".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
#: Which open elements a start tag closes, and where the search for them stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
    "caption": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "colgroup": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
}
_NAME_END = re.compile(r"[\s/>]")
_ATTRIBUTES = re.compile(r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+>""")
_LETTER = re.compile("[A-Za-z]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
#: What may stand directly in a table and in its parts; other content moves before the table.
TABLE_PARTS = set("caption colgroup col thead tbody tfoot tr td th".split())
TABLE_OPEN = set("table thead tbody tfoot tr colgroup".split())
NEUTRAL = set("script style template form".split())
OUT_OF_CELLS = set("td th tr tbody thead tfoot table body html".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "shown", "children", "start")

    def __init__(self, tag: str, shown: bool, start: int = 1):
        self.tag, self.shown, self.children, self.start = tag, shown, [], start


def _visible(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether the element shows, and the first number of an ordered list."""
    if tag in HIDDEN:
        return False, 1
    if not attributes.strip():
        return True, 1
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _INVISIBLE.search(found.get("style", ""))
    hidden = hidden or (tag == "input" and found.get("type", "").lower() == "hidden") or (tag == "dialog" and "open" not in found)
    start = found.get("start", "1")
    return not hidden, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1


class _Closing:
    """Where the tag ends whose attributes begin at a place: the first ``>`` outside quotes.

    A search that fails may have read the rest of the page, so after the first failure all answers come from one
    pass over the quotes and ``>`` of the page, from its end.
    """

    def __init__(self, page: str):
        self.page, self.places, self.ends = page, None, None

    def after(self, at: int) -> int:
        """Place behind the ``>``, -1 if there is none."""
        if self.places is None:
            m = _ATTRIBUTES.match(self.page, at)
            if m:
                return m.end()
            self.places = [m.start() for m in re.finditer("['\">]", self.page)]
            self.ends, following = [-1] * (len(self.places) + 1), {}
            for i in range(len(self.places) - 1, -1, -1):
                c = self.page[self.places[i]]
                if c == ">":
                    self.ends[i] = self.places[i] + 1
                else:
                    close = following.get(c)
                    self.ends[i] = -1 if close is None else self.ends[close + 1]
                    following[c] = i
        return self.ends[bisect_left(self.places, at)]


def _tokens(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """``(text before, end tag?, name, attributes, place behind)`` of each tag, then the rest; name "" for comments and the rest.

    A place sent back is where to go on. Each character is read a bounded number of times, whatever is left open.
    """
    at = look = 0
    last, name_end, closing = page.rfind(">"), -1, _Closing(page)
    while (i := page.find("<", look)) >= 0:
        c = page[i + 1 : i + 2]
        if c in ("!", "?") and c:
            comment = page.startswith("<!--", i)
            end = page.find("-->" if comment else ">", i + (4 if comment else 2))
            end = len(page) if end < 0 else end + (3 if comment else 1)
            yield page[at:i], False, "", "", end
            at = look = end
            continue
        look = i + 1
        start = i + 2 if c == "/" else i + 1
        if i >= last or not _LETTER.match(page, start):
            continue
        if name_end < start:
            m = _NAME_END.search(page, start)
            name_end = m.start() if m else len(page)
        end = closing.after(name_end)
        if end < 0:
            continue
        back = yield page[at:i], c == "/", page[start:name_end].lower(), page[name_end : end - 1], end
        at = look = end if back is None else back
    yield page[at:], False, "", "", len(page)


class _Open:
    """The open elements, with the places of each tag, so that no search walks over all of them."""

    def __init__(self, root: Node):
        self.nodes, self.blocks, self.at = [root], [], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close all elements from a place on."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        """Place of the innermost element with one of the tags, 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def first(self, tags: set, above: int) -> int:
        """Place of the outermost element with one of the tags inside the one at ``above``."""
        found = len(self.nodes)
        for t in tags:
            places = self.at[t]
            i = bisect_right(places, above)
            if i < len(places):
                found = min(found, places[i])
        return found

    def top(self) -> Node:
        return self.nodes[-1]


def _place(stack: _Open) -> tuple[list, int]:
    """Where content goes that is no part of a table: the open element, or before the table it stands directly in."""
    children = stack.top().children
    if stack.top().tag in TABLE_OPEN:
        at = stack.last("table")
        if at:
            above = stack.nodes[at - 1].children
            # the open table is the last table of its parent; what came before it stays before
            return above, next(i for i in range(len(above) - 1, -1, -1) if above[i] is stack.nodes[at])
    return children, len(children)


def _text(stack: _Open, s: str) -> None:
    if not s:
        return
    shows = bool(s.strip(" \t\n\r\f"))
    if stack.top().tag == "head" and shows:
        stack.cut(len(stack.nodes) - 1)
    if shows:
        into, at = _place(stack)
        into.insert(at, s)
    else:
        stack.top().children.append(s)


def build(page: str) -> Node:
    """The tree of a page, in time linear in its length. End tags without a start are ignored; open elements end with the page.

    Rows without a tag are opened, and content that stands directly in a table moves before it.
    """
    root = Node("html", True)
    stack, size = _Open(root), len(page)
    tokens, back = _tokens(page), None
    while True:
        try:
            before, ends, tag, attributes, at = tokens.send(back)
        except StopIteration:
            return root
        back = None
        _text(stack, before)
        if not tag:
            continue
        if ends:
            at_tag = stack.last(tag)
            # an end tag does not reach out of its table cell
            if at_tag and (tag in OUT_OF_CELLS or at_tag >= stack.last("td", "th", "table")):
                stack.cut(at_tag)
            continue
        if tag in ("html", "body") and len(stack.nodes) == 1:
            shown, _ = _visible(tag, attributes)
            root.shown = root.shown and shown
            continue
        if tag in TABLE_PARTS:
            # a part of a table ends a caption, and what was moved before the table
            i = stack.last("table", *TABLE_PARTS)
            inner = stack.nodes[i].tag
            if i and inner not in ("td", "th"):
                stack.cut(i + (inner != "caption" and (inner != "colgroup" or tag == "col")))
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            stack.cut(stack.first(closed, stack.last(*stop)))
        elif tag in BLOCK:
            # a block ends an open paragraph, with what is open inside it
            if stack.blocks and stack.nodes[stack.blocks[-1]].tag == "p":
                stack.cut(stack.blocks[-1])
        if stack.top().tag == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "template", "noscript"):
            stack.cut(len(stack.nodes) - 1)
        if tag == "table" and stack.top().tag in TABLE_OPEN:
            # a table directly in a table ends that one
            stack.cut(stack.last("table") or len(stack.nodes))
        if tag in ("td", "th") and stack.top().tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", True)
            stack.top().children.append(row)
            stack.push(row)
        shown, start = _visible(tag, attributes)
        node = Node(tag, shown, start)
        children = stack.top().children
        into, place = (children, len(children)) if tag in TABLE_PARTS or tag in NEUTRAL else _place(stack)
        into.insert(place, node)
        if tag == "form" and stack.top().tag in TABLE_OPEN:
            continue
        if RAW.fullmatch(tag):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            back = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/"):
            stack.push(node)


class _Writer:
    """Lines of text; spaces collapse, and empty lines never double."""

    def __init__(self):
        self.lines, self.line, self.space, self.gap = [], [], False, 0

    def text(self, s: str, prefix: str) -> None:
        words = _SPACE.sub(" ", html.unescape(s))
        if words == " " or not words:
            self.space = self.space or words == " "
            return
        if not self.line:
            self.begin(prefix)
        elif self.space or words[0] == " ":
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def begin(self, prefix: str) -> None:
        self.lines += [""] * (self.gap if self.lines else 0)
        self.gap = 0
        self.line = [prefix]
        self.space = False

    def end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def raw(self, s: str, prefix: str, indent: str) -> None:
        """Text as it is; it goes on with the open line, so that markup inside a line does not break it."""
        first, *more = html.unescape(s).split("\n")
        if first:
            if not self.line:
                self.begin(prefix)
            self.line.append(first)
        for x in more:
            if not self.line:
                self.begin(indent)
            self.end()
            if x:
                self.begin(indent)
                self.line.append(x)


#: Bounds of the layout, which cut no text: deeper blocks keep this indent, and longer cells do not widen their column.
INDENT, COLUMN = 64, 200


def _table(rows: list[list[str]]) -> list[str]:
    """Cells padded to their columns' widths; a cell of several lines is joined by spaces, one over ``COLUMN`` runs over."""
    width: list[int] = []
    cells = [[" ".join(filter(None, c.split("\n"))) for c in row] for row in rows]
    for row in cells:
        width += [0] * (len(row) - len(width))
        for i, c in enumerate(row):
            width[i] = max(width[i], len(c) if len(c) <= COLUMN else 0)
    return ["  ".join(c.ljust(width[i]) for i, c in enumerate(row)).rstrip() for row in cells]


def _within(node: Node, tags: set, stop: set) -> Iterator[Node]:
    """Nearest descendants with one of ``tags``, in order, not below ``stop``."""
    walk = [iter(node.children)]
    while walk:
        child = next(walk[-1], None)
        if child is None:
            walk.pop()
        elif isinstance(child, Node) and child.shown:
            if child.tag in tags:
                yield child
            elif child.tag not in stop:
                walk.append(iter(child.children))


#: Tables deeper than this are read cell by cell as blocks, so that nesting costs no stack.
TABLE_DEPTH = 8


def render(root: Node, depth: int = 0) -> str:
    """Text of a tree. Goes over the tree with its own stack; only tables inside tables call it again."""
    if not root.shown:
        return ""
    w = _Writer()
    # entries: (node, position of the next child, indent, numbers of the enclosing list, preformatted?, in a list item?)
    stack = [[root, 0, "", [None], False, False]]
    bullet = None
    while stack:
        frame = stack[-1]
        node, i, indent, number, pre, item = frame
        if i >= len(node.children):
            stack.pop()
            if node.tag in BLOCK:
                w.end()
                bullet = None
                if node.tag in SPACED and not (node.tag in ("ul", "ol") and stack and stack[-1][5]):
                    w.gap = 1
            continue
        frame[1] += 1
        child = node.children[i]
        if isinstance(child, str):
            if pre:
                if node.tag == "pre":
                    # the line breaks around the text are those of the markup
                    child = child.lstrip("\n") if i == 0 else child
                    child = child.rstrip("\n") if i == len(node.children) - 1 else child
                w.raw(child, bullet if bullet is not None else indent, indent)
            else:
                w.text(child, bullet if bullet is not None else indent)
            if w.line:
                bullet = None
            continue
        if not child.shown:
            continue
        tag = child.tag
        if tag == "br":
            if w.line:
                w.end()
            continue
        if tag in BLOCK:
            w.end()
            if tag in SPACED and not (tag in ("ul", "ol") and item):
                w.gap = 1
        if tag == "table" and depth < TABLE_DEPTH:
            rows = [
                [render(_as_block(c), depth + 1) for c in _within(r, {"td", "th"}, {"table"})] for r in _within(child, {"tr"}, {"table"})
            ]
            for c in _within(child, {"caption"}, {"table", "tr"}):
                rows.insert(0, [render(_as_block(c), depth + 1)])
            for line in _table([r for r in rows if any(r)]):
                w.begin(indent)
                w.line.append(line)
                w.end()
            w.gap = 1
            continue
        inner, count = indent, number
        if tag in ("ul", "ol", "menu"):
            count = [child.start] if tag == "ol" else [None]
        elif tag == "li":
            mark = "- " if number[0] is None else f"{number[0]}. "
            if number[0] is not None:
                number[0] += 1
            bullet, inner = indent + mark, indent + " " * len(mark)
        elif tag in ("blockquote", "dd"):
            inner = indent + "  "
        inner = inner if len(inner) <= INDENT else indent
        stack.append([child, 0, inner, count, pre or tag == "pre", item or tag == "li"])
    w.end()
    return "\n".join(w.lines).strip("\n")


def _as_block(cell: Node) -> Node:
    block = Node("div", True)
    block.children = cell.children
    return block


def page_text(page: str) -> str:
    """Visible text of one page."""
    return render(build(page))


def extract(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """``(key, text, n_chars, n_lines)`` for each row; null and empty pages give an empty text and no line.

    Broken markup never fails: what is not a tag is text. Other columns are ignored.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "text": batch["t"].map(page_text)})

    # the key travels as text, so that nulls do not turn large numbers into floats
    rows = pages.select(F.col(key).cast("string").alias("key"), text_of(payload).alias("t")).mapInPandas(run, "key string, text string")
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return rows.select(F.col("key").cast(kind).alias(key), "text", F.length("text").cast("long").alias("n_chars"), n_lines.alias("n_lines"))
