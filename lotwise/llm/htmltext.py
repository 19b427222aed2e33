"""Operator 8, HTML extraction by layout-aware rendering.

A tree builder reads tags as browsers do, with implied end tags and tags closed out of order; visibility rules drop
what a browser doesn't show: attributes, inline styles, and the page's style sheets as far as their rules name a tag, a
class, an id, or a tag with one of the latter (other selectors and at-rules such as @media are left out); a renderer emits all text that is left, in the page's order. Blocks stand on lines of
their own, with an empty line where browsers leave a margin; list items bear their marks and indents; the cells of a
table's rows are aligned in columns, spans of rows and columns included; preformatted text keeps its spaces. The tree
has any depth. Beyond LEVELS lists, quotations and tables inside each other lines are indented no further and cells
stand below each other, as the indents would be longer than the page squared; a table whose padding would be many times
its text has narrower columns, out of which long cells stick. Text and marks stay in all of this. Reading a page takes
one pass, whatever it holds. Pages are rendered one at a time, without any other row.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: classes of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title datalist meta link param source track area base object audio video canvas".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table ul xmp caption tr tbody thead tfoot td th".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre listing xmp plaintext blockquote figure hr fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre listing search section table ul".split())
LISTS = frozenset("ul ol menu dir".split())
SCOPE = frozenset("html table td th caption button object template".split())
# A start tag closes these open elements, up to the nearest of the second set.
IMPLIED = {
    "li": (frozenset(["li"]), LISTS | SCOPE), "dt": (frozenset("dt dd".split()), frozenset(["dl"]) | SCOPE), "dd": (frozenset("dt dd".split()), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())), "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "tr": (frozenset("tr td th caption".split()), frozenset("table template".split())), "td": (frozenset("td th".split()), frozenset("tr table template".split())), "th": (frozenset("td th".split()), frozenset("tr table template".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th caption".split()), frozenset("table template".split())),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
# In svg and math: elements that are not drawn, those with HTML inside, and HTML tags that end svg and math.
UNDRAWN = frozenset("annotation annotation-xml desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HEAD_ONLY = frozenset("meta link base title script style template noscript head html".split())

LEVELS, COLUMN, BLANKS = 200, 60, 8
COLSPAN, ROWSPAN = 1000, 65534  # fixed values of HTML: the most that a cell can span
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
MARK = re.compile(r"[>\"']")
NUMBER = re.compile(r"[ \t\n\f\r]*([+-]?)0*([0-9]*)")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
SPACE = re.compile(r"[ \t\n\f\r]+")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SELECTOR = re.compile(r"([a-z][a-z0-9]*|\*)?(?:([.#])([\w-]+))?", re.I)
ZERO = re.compile(r"[+-]?(?:0+(?:\.0*)?|\.0+)%?")
# Fixed values of CSS.
PROPERTIES = frozenset("display visibility opacity white-space".split())
OWN_LINES = frozenset("block flex grid list-item table flow-root".split())
IN_LINE = frozenset("inline inline-block inline-flex inline-grid contents".split())
KEEPS = frozenset("pre pre-wrap pre-line break-spaces".split())
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


class Node:
    """An element. ``gone``: neither it nor what is in it is shown; ``seen``: its own text is; ``kept``: white space
    counts; ``lines``: whether it has lines of its own, where a style says so."""

    __slots__ = ("tag", "attributes", "children", "foreign", "gone", "seen", "kept", "lines")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.foreign = tag, attributes, [], False
        self.gone, self.seen, self.kept, self.lines = False, True, False, None

    def around(self, children: list) -> Node:
        """A block of some of its children."""
        node = Node("div")
        node.children, node.seen, node.kept = children, self.seen, self.kept
        return node

    def get(self, name: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def hidden(self) -> bool:
        """Whether it is hidden unless a style shows it."""
        low = self.attributes.lower()
        return "hidden" in low and self.get("hidden") is not None or self.tag == "dialog" and self.get("open") is None

    def never(self) -> bool:
        """Whether it is hidden whatever styles say."""
        if self.tag in HIDDEN or self.foreign and self.tag in UNDRAWN:
            return True
        return self.tag == "input" and "hidden" in self.attributes.lower() and (self.get("type") or "").lower() == "hidden"


def declarations(css: str) -> Iterator[tuple[str, str, bool]]:
    """(property, value, whether important) of those that bear on what is shown, lower-cased."""
    for part in css.lower().split(";"):
        name, colon, value = part.partition(":")
        if colon and (name := name.strip()) in PROPERTIES:
            value, mark, _ = value.partition("!")
            yield name, value.strip(), bool(mark)


class Sheet:
    """The rules of a page's style sheets by (tag, kind, name): of each property the value that wins, with its rank. A node
    looks up its tag, id and classes, however many rules there are."""

    def __init__(self):
        self.rules: dict[tuple, dict[str, tuple]] = {}
        self.order = 0

    def read(self, css: str) -> None:
        css, at = COMMENT.sub(" ", css.replace("<!--", " ").replace("-->", " ")), 0
        while (brace := css.find("{", at)) >= 0:
            head = css[at:brace].rpartition(";")[2].strip()
            if head.startswith("@"):  # with the rules inside it
                depth, at = 1, brace + 1
                for m in re.compile(r"[{}]").finditer(css, at):
                    depth += 1 if m[0] == "{" else -1
                    if not depth:
                        break
                at = m.end() if depth == 0 else len(css)
                continue
            end = css.find("}", brace)
            end = len(css) if end < 0 else end
            if found := [*declarations(css[brace + 1 : end])]:
                for selector in head.split(","):
                    if (m := SELECTOR.fullmatch(selector.strip())) and m[0]:
                        self.add(m, found)
            at = end + 1

    def add(self, selector: re.Match, found: list) -> None:
        tag, kind, name = (selector[1] or "*").lower(), selector[2] or "", selector[3] or ""
        weight = (kind == "#", kind == ".", tag != "*")
        own = self.rules.setdefault((tag, kind, name), {})
        for prop, value, important in found:
            self.order += 1
            own[prop] = max(own.get(prop, ((),)), ((important, 0, *weight, self.order), value))

    def of(self, node: Node) -> dict[str, str]:
        """What the rules and the node's own style say."""
        best: dict[str, tuple] = {}
        if self.rules:
            names = [("", "")]
            if node.attributes:
                names += [(".", c) for c in SPACE.split(node.get("class") or "") if c] + [("#", i) for i in [node.get("id")] if i]
            for kind, name in names:
                for tag in (node.tag, "*"):
                    for prop, ranked in self.rules.get((tag, kind, name), {}).items():
                        best[prop] = max(best.get(prop, ((),)), ranked)
        if node.attributes and "style" in node.attributes.lower():
            for i, (prop, value, important) in enumerate(declarations(COMMENT.sub(" ", node.get("style") or ""))):
                best[prop] = max(best.get(prop, ((),)), ((important, 1, False, False, False, i), value))
        return {prop: value for prop, (_, value) in best.items()}


def styled(root: Node) -> None:
    """Sets what is shown of each node: what a display or opacity hides is gone with all in it; visibility and white space
    are handed down until a node in it says otherwise."""
    sheet, more = Sheet(), [root]
    while more:
        node = more.pop()
        if node.tag == "style" and not node.foreign and (node.get("media") or "all").lower().strip() in ("", "all", "screen"):
            sheet.read("".join(c for c in node.children if isinstance(c, str)))
        elif node.tag not in ("template", "noscript"):
            more += reversed([c for c in node.children if isinstance(c, Node)])
    more = [(root, True, False)]
    while more:
        node, node.seen, node.kept = more.pop()
        says = sheet.of(node) if sheet.rules or node.attributes else {}
        display = says.get("display")
        node.gone = node.never() or display == "none" or display is None and node.hidden() or bool(ZERO.fullmatch(says.get("opacity", "1")))
        if node.gone:
            continue
        if (v := says.get("visibility")) in ("visible", "hidden", "collapse"):
            node.seen = v == "visible"
        if (w := says.get("white-space")) in KEEPS or w in ("normal", "nowrap"):
            node.kept = w in KEEPS
        elif node.tag in ("pre", "listing", "xmp", "plaintext", "textarea"):
            node.kept = True
        elif node.tag == "table":  # as browsers do in pages without a type
            node.kept = False
        node.lines = True if display in OWN_LINES else False if display in IN_LINE else None
        more += [(c, node.seen, node.kept) for c in node.children if isinstance(c, Node)]


def counted(number: int, kind: str | None) -> str:
    """A number as the mark of a list of type 1, a, A, i or I; decimal where that has none."""
    if kind in ("a", "A") and number > 0:
        out = ""
        while number:
            number, digit = divmod(number - 1, 26)
            out = chr(ord(kind) + digit) + out
        return out
    if kind in ("i", "I") and 0 < number < 4000:
        out = ""
        for value, sign in ROMAN:
            times, number = divmod(number, value)
            out += sign * times
        return out if kind == "i" else out.upper()
    return str(number)


class Builder:
    """The tree of a page, at any depth; ``places`` has where in the stack the open elements of a tag are."""

    def __init__(self, page: str):
        self.root = Node("html")
        self.stack, self.places = [self.root], defaultdict(list, html=[0])
        self.unclosed: set[int] = set()
        self.read(page)

    def tag_end(self, page: str, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: the first > outside quotes, or if none is, the first one; -1
        without any. Quotes met on a way that leads nowhere are kept, so that no other tag takes that way again."""
        place, met = at, []
        while (m := MARK.search(page, place)) and m.start() not in self.unclosed:
            if m[0] == ">":
                return m.start()
            met.append(m.start())
            if (place := page.find(m[0], m.end()) + 1) == 0:
                break
        self.unclosed.update(met)
        return page.find(">", at)

    def read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.text(page[at:])
                return
            if lt > at:
                self.text(page[at:lt])
            follow = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif follow in "!?" and follow:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            elif m := NAME.match(page, lt):
                tag, end = m[1].lower(), self.tag_end(page, m.end())
                if end < 0:  # no tag ends from here on
                    self.text(page[lt:])
                    return
                at = end + 1
                if follow == "/":
                    self.end(tag)
                else:
                    self.start(tag, page[m.end() : end])
                    if tag in RAW and self.stack[-1].tag == tag:
                        close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*+>?", re.I).search(page, at)
                        self.text(page[at : close.start() if close else n], tag in ("textarea", "title"))
                        at = close.end() if close else n
                        self.end(tag)
            elif follow == "/":
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                self.text("<")
                at = lt + 1

    def text(self, raw: str, references: bool = True) -> None:
        if references and "&" in raw:
            raw = html.unescape(raw)
        top = self.stack[-1]
        if top.tag == "head" and raw.strip():
            self.pop_to("head")
            top = self.stack[-1]
        top.children.append(raw)

    def pop_to(self, tag: str) -> None:
        if self.places[tag]:
            self.cut(self.places[tag][-1])

    def cut(self, at: int) -> None:
        """Closes the open elements from place ``at`` on."""
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def nearest(self, tags: frozenset) -> int:
        """The place of the innermost open element of ``tags``, -1 if none is open."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    def close(self, tags: frozenset, until: frozenset) -> None:
        """Closes the open elements of ``tags`` that stand above the nearest of ``until``."""
        if not any(self.places.get(t) for t in tags):
            return
        limit = self.nearest(until)
        found = [own[k] for t in tags if (own := self.places.get(t)) and (k := bisect_right(own, limit)) < len(own)]
        if found:
            self.cut(min(found))

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.places[tag]:
            return
        if self.places["head"] and tag not in HEAD_ONLY and tag != "body":
            self.close(frozenset(["head"]), frozenset())
        if tag in CLOSES_P and self.places["p"]:
            self.close(frozenset(["p"]), SCOPE)
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        if tag in ENDS_FOREIGN and self.inside():
            while self.inside():
                self.cut(len(self.stack) - 1)
        node = Node(tag, attributes)
        node.foreign = tag in ("svg", "math") or self.inside()
        self.stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and (node.foreign or tag not in BLOCK | RAW):
            return
        self.places[tag].append(len(self.stack))
        self.stack.append(node)

    def inside(self) -> bool:
        """Whether a new element belongs to svg or math."""
        top = self.stack[-1]
        return top.foreign and top.tag not in HOLDS_HTML

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag not in ("html", "body") and self.places[tag]:
            keep = frozenset(["table"]) if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else SCOPE - {tag} if tag != "table" else frozenset()
            if self.nearest(keep) < self.places[tag][-1]:
                self.pop_to(tag)


def wide(s: str) -> int:
    """Columns of a terminal that s takes."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Flow:
    """Lines of a block under construction."""

    def __init__(self):
        self.lines, self.now, self.space, self.gap, self.marks = [], [], False, False, []

    def text(self, raw: str, kept: bool = False) -> None:
        if kept:
            first, *more = raw.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for line in more:
                self.line(True)
                self.now.append(line)
            return
        words = SPACE.sub(" ", raw)
        if words[:1] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        if self.space and self.now:
            self.now.append(" ")
        self.space = words.endswith(" ")
        self.now.append(words.rstrip(" "))

    def line(self, empty: bool = False) -> None:
        if self.now or empty:
            self.put("".join(self.now).rstrip(" ") if not empty else "".join(self.now))
        self.now, self.space = [], False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if self.marks:
            line, self.marks = "".join(self.marks) + line if line else line, []
        self.lines.append(line)

    def block(self, margin: bool) -> None:
        self.line()
        self.gap |= margin

    def done(self) -> list[str]:
        self.line()
        return self.lines


def run(first: Generator):
    """The result of a generator that yields the generators whose results it needs: recursion on a stack of our own."""
    stack, value = [first], None
    while stack:
        try:
            more = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(more)
            value = None
    return value


def number(value: str | None, default: int, least: int, most: int) -> int:
    """The number at the start of an attribute's value, within its limits; ``default`` where there is none."""
    m = NUMBER.match(value or "")
    if m.end() == 0 or not m[0][-1:].isdigit():
        return default
    x = int(m[2] or 0) if len(m[2]) < 10 else 10**9
    return min(max(-x if m[1] == "-" else x, least), most)


Cell = tuple[list[str], int, int]  # lines, columns, rows


def cell(node: Node, lines: list[str]) -> Cell:
    if not node.attributes:
        return lines, 1, 1
    return lines, number(node.get("colspan"), 1, 1, COLSPAN), number(node.get("rowspan"), 1, 0, ROWSPAN) or ROWSPAN


def gridded(rows: list[tuple[int, list[Cell]]]) -> list[list[tuple[int, int, list[str]]]]:
    """(column, columns, lines) of each row's cells: in the first column that no cell of an earlier row of the same
    group reaches into. At most COLSPAN cells reach into further rows at a time, so that rows stay cheap."""
    out, held, last = [], [], None
    for group, cells in rows:
        if group != last:
            held, last = [], group
        column, k, own, more = 0, 0, [], []
        for lines, across, down in cells:
            while k < len(held) and held[k][0] <= column:
                column = max(column, held[k][1])
                k += 1
            own.append((column, across, lines))
            if down > 1 and len(held) + len(more) < COLSPAN:
                more.append((column, column + across, down))
            column += across
        held = sorted([(a, b, left - 1) for a, b, left in [*held, *more] if left > 1])
        out.append(own)
    return out


def columns(grid: list, limit: float) -> tuple[dict[int, int], int]:
    """The place of each column in which a cell starts, and how much padding these places take."""
    starts = sorted({c for row in grid for c, _, _ in row})
    width = dict.fromkeys(starts, 0)
    wider = []
    for row in grid:
        for c, across, lines in row:
            need = min(limit, max(map(wide, lines), default=0))
            if across == 1:
                width[c] = max(width[c], need)
            else:
                wider.append((across, c, need))
    for across, c, need in sorted(wider):
        own = starts[bisect_left(starts, c) : bisect_left(starts, c + across)]
        room = sum(width[x] + 2 for x in own) - 2
        width[own[-1]] += max(0, need - room)
    at, place = 0, {}
    for c in starts:
        place[c] = at
        at += width[c] + 2
    return place, sum(place[row[-1][0]] * max(len(lines) for _, _, lines in row) for row in grid if row)


class Place:
    """How many lists, quotations and tables are around a node, and how much more blank space its whole page may have."""

    def __init__(self, level: int, room: list[int]):
        self.level, self.room = level, room

    def inside(self) -> Place:
        return Place(self.level + 1, self.room)

    def take(self, blanks: int) -> bool:
        """Whether there is room for so many blanks, which are then taken."""
        if blanks > self.room[0]:
            return False
        self.room[0] -= blanks
        return True


def aligned(grid: list, at: Place) -> list[str]:
    text = sum(len(x) for row in grid for _, _, lines in row for x in lines)
    for limit in (float("inf"), COLUMN, 0):
        place, padding = columns(grid, limit)
        if padding <= 4096 + 8 * text and at.take(padding):
            break
    else:
        place = None
    out = []
    for row in grid:
        for i in range(max([len(lines) for _, _, lines in row], default=0)):
            line, end = [], 0
            for column, _, lines in row:
                piece = lines[i] if i < len(lines) else ""
                at = max(place[column] if place else 0, end)
                line.append(" " * (at - end) + piece if piece else "")
                if piece:
                    end = at + wide(piece)
                    line.append("  ")
                    end += 2
            out.append("".join(line).rstrip(" "))
    return out


def table(node: Node, at: Place) -> Generator:
    """A table's caption and rows, cells aligned in columns two spaces apart; cells of several lines stay side by side."""
    rows, captions, more, groups = [], [], [(node, 0)], 0
    while more:
        part, group = more.pop()
        own = []
        for child in part.children:
            if isinstance(child, str):
                if child.strip():
                    captions += yield lines_of(node.around([child]), at)
            elif child.gone:
                continue
            elif child.tag in ("tbody", "thead", "tfoot"):
                groups += 1
                own.append((child, groups))
            elif child.tag == "tr":
                cells = []
                for c in child.children:
                    if isinstance(c, Node) and c.tag in ("td", "th") and not c.gone:
                        cells.append(cell(c, (yield lines_of(c, at))))
                loose = [c for c in child.children if (not isinstance(c, Node) or c.tag not in ("td", "th"))]
                if text := (yield lines_of(child.around(loose), at)):
                    cells.append((text, 1, 1))
                rows.append((group, cells))
            elif child.tag in ("td", "th"):
                rows.append((group, [cell(child, (yield lines_of(child, at)))]))
            elif text := (yield lines_of(node.around([child]), at)):
                captions += text
        more += reversed(own)
    return captions + aligned(gridded(rows), at)


def rendered(node: Node, size: int) -> list[str]:
    """The lines of a page of so many characters. Blanks that indent and align are at most BLANKS times as many, for all
    tables, lists and quotations of the page together; where they run out, text stands without."""
    styled(node)
    return run(lines_of(node, Place(0, [4096 + BLANKS * size])))


def lines_of(node: Node, at: Place) -> Generator:
    flow = Flow()
    yield fill(flow, node, at)
    return flow.done()


def fill(flow: Flow, node: Node, at: Place) -> Generator:
    """Puts what is visible in node into flow. What is there but unseen stands as a space."""
    shut = node.tag == "details" and node.get("open") is None
    item, step, kind = 1, 1, None
    if node.tag == "ol" and node.attributes:
        if node.get("reversed") is not None:
            item, step = sum(isinstance(c, Node) and c.tag == "li" and not c.gone for c in node.children), -1
        item, kind = number(node.get("start"), item, -(10**9), 10**9), node.get("type")
    for child in node.children:
        if isinstance(child, str):
            if not shut:
                flow.text(child if node.seen else " ", node.seen and node.kept)
            continue
        tag = child.tag
        if child.gone or shut and tag != "summary":
            continue
        if tag == "br":
            flow.line(True)
        elif tag == "hr":
            flow.block(True)
        elif tag in ("img", "input") and not child.seen:
            continue
        elif tag == "img":
            if text := child.get("alt"):
                flow.text(text)
        elif tag == "input":
            if (text := child.get("value")) and (child.get("type") or "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url"):
                flow.text(f" {text} ")
        elif tag == "wbr":
            continue
        elif tag == "text" and child.foreign:  # a label at a place of its own
            flow.text(" ")
            yield fill(flow, child, at)
            flow.text(" ")
        elif child.lines is False and tag != "table":
            yield fill(flow, child, at)
        elif tag == "table" or tag == "li" or tag in ("blockquote", "dd"):
            margin = tag in MARGIN
            flow.block(margin)
            if tag == "li" and child.attributes:
                item = number(child.get("value"), item, -(10**9), 10**9)
            mark = ""
            if tag == "li":
                mark = ("- " if node.tag != "ol" else counted(item, (child.get("type") if child.attributes else None) or kind) + ". ") if child.seen else ""
                item += step
            if at.level >= LEVELS:
                start = len(flow.lines)
                if tag == "li":
                    flow.marks.append(mark)
                yield fill(flow, child, at)
                flow.block(margin)
                if tag == "li" and len(flow.lines) == start:
                    flow.marks.pop()
                continue
            if tag == "table":
                lines = yield table(child, at.inside())
            else:
                lines = yield lines_of(child, at.inside())
                mark = mark if tag == "li" else "  "
            indent = " " * len(mark) if at.take(len(mark) * len(lines)) else ""
            for i, line in enumerate(lines):
                flow.put((mark if not i else indent) + line if line else "")
            flow.block(margin)
        elif tag in BLOCK or child.lines:
            margin = tag in MARGIN and not (tag in LISTS and node.tag == "li")
            flow.block(margin)
            yield fill(flow, child, at)
            flow.block(margin)
        else:
            yield fill(flow, child, at)


def extract(page: str) -> tuple[str, str, dict[str, int]]:
    """Title, visible text and counts of elements of a page."""
    tree = Builder(page).root
    title, counts, more = "", Counter(), [tree]
    while more:
        node = more.pop()
        counts[node.tag] += 1
        if node.tag == "title" and not title:
            title = SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        more += [c for c in node.children if isinstance(c, Node)]
    lines = rendered(tree, len(page))
    return title, "\n".join(lines).strip("\n"), counts


OUT = "page_id bigint, url string, title string, text string, n_lines bigint, n_links bigint, n_items bigint, n_tables bigint"


def visible_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, n_lines, n_links, n_items, n_tables) a row of pages(page_id, url, html).

    Null, empty or blank pages have empty text and title and no lines. Broken markup is read as far as it goes, an
    unclosed comment or script to the page's end. Rows with equal ids or pages have their own rows; further columns
    of pages play no part.
    """
    kinds = [pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                title, text, n = extract(raw or "")
                rows.append((page, url, title, text, text.count("\n") + 1 if text else 0, n["a"], n["li"], n["table"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html").mapInArrow(run, OUT)
