"""HTML to text by layout: a tree builder with implied tags and visibility rules, then rendering of all that is visible.

Tags are read as the HTML standard's tokeniser reads them, each character once. The builder closes what HTML lets authors
leave open (p, li, dt, dd, option, rows and cells) and drops what browsers don't show: scripts, styles, templates, comments,
head, `hidden`, collapsed details, display:none, and visibility:hidden but for descendants that are visible again. Both
properties come from style attributes and from rules of <style> elements with selectors of tags, classes and ids.
The renderer keeps the spacing of blocks (a blank line around paragraphs, headings, lists and tables), list marks with
indentation, preformatted text, and tables with cells padded to a column's width. All options of a select are shown.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, with_defaults

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe noembed noframes audio video canvas datalist area base source track param".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table dl figure fieldset hr".split())
BLOCK = MARGIN | frozenset("html body div section article header footer nav main aside address ul ol menu li dt dd form dialog details summary figcaption legend center tr caption thead tbody tfoot option optgroup search hgroup".split())
#: What may stand in a head; anything else, text too, ends it.
IN_HEAD = frozenset("head title meta link style script noscript template base basefont bgsound noframes".split())
#: Opening one of these closes an open p.
CLOSES_P = BLOCK - frozenset("html body li dt dd tr caption thead tbody tfoot option optgroup summary legend figcaption".split())
#: Opening the tag closes the nearest of these that is open below the named containers.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
#: An end tag reaches no further than the nearest of these.
SCOPE = frozenset({"table", "td", "th", "html", "body"})

#: Elements nested deeper become their ancestor's children at this depth, as in browsers; their end tags are counted, so that none ends an ancestor.
MAX_DEPTH = 200

#: The standard's limits of a cell's spans.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65_534

#: A longer line of a cell doesn't widen its column: what stands right of it moves.
MAX_WIDTH = 200

#: A table that padding would make so many times longer than its texts (and 64 Ki characters) has two spaces between cells instead.
MAX_PADDING = 20

_COMMENT_END = re.compile("--!?>")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
_BETWEEN = re.compile(r"[\t\n\f\r /]*")
_ATTRIBUTE = re.compile(r"(=?[^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:([\"'])|([^\t\n\f\r >]*)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW}


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(html: str, at: int) -> tuple[dict[str, str], int, bool] | None:
    """(attributes, place after the tag, whether it closes itself) of a tag whose name ends at `at`; None where the page ends in it."""
    out: dict[str, str] = {}
    while True:
        between = _BETWEEN.match(html, at)
        at = between.end()
        if at >= len(html):
            return None
        if html[at] == ">":
            return out, at + 1, between[0].endswith("/")
        m = _ATTRIBUTE.match(html, at)
        at, value = m.end(), m[3] or ""
        if m[2]:
            end = html.find(m[2], at)
            if end < 0:
                return None
            value, at = html[at:end], end + 1
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)


def _after_comment(html: str, at: int) -> int:
    """The place after the comment, declaration or malformed end tag that begins at `at`."""
    if not html.startswith("<!--", at):
        end = html.find(">", at)
        return end + 1 if end >= 0 else len(html)
    for short in (">", "->"):
        if html.startswith(short, at + 4):
            return at + 4 + len(short)
    end = _COMMENT_END.search(html, at + 4)
    return end.end() if end else len(html)


def parse(html: str) -> Element:
    """The tree of a page; anything is accepted. What follows a tag that is never ended is part of that tag, as in browsers."""
    root = Element("html", {})
    stack, at, n, seen = [root], 0, len(html), 0
    beyond: list[str] = []  # tags of open elements that are nested too deep to be on the stack

    def text(a: int, b: int) -> None:
        if a < b:
            if stack[-1].tag == "head" and html[a:b].strip(" \t\n\r\f"):
                del stack[1:]
            stack[-1].children.append(unescape(html[a:b]))

    while True:
        at = html.find("<", at)
        if at < 0:
            text(seen, n)
            return root
        closing = html.startswith("/", at + 1)
        name = _NAME.match(html, at + 1 + closing)
        if name is None:
            if html.startswith("<![CDATA[", at) and any(x.tag in ("svg", "math") for x in stack):
                end = html.find("]]>", at)
                text(seen, at)
                stack[-1].children.append(html[at + 9 : end if end >= 0 else n])
                seen = at = end + 3 if end >= 0 else n
            elif html.startswith(("<!", "<?"), at) or closing and at + 2 < n:
                text(seen, at)
                seen = at = _after_comment(html, at)
            else:
                at += 1
            continue
        text(seen, at)
        read = _attributes(html, name.end())
        if read is None:
            return root
        attributes, at, closed = read
        seen, tag = at, name[0].lower()
        if closing:
            if not _close_beyond(beyond, tag):
                _close(stack, tag)
                if len(stack) < MAX_DEPTH:
                    beyond.clear()
            continue
        if not beyond:
            _imply(stack, tag)
        element = Element(tag, attributes)
        if tag not in ("html", "body"):
            stack[-1].children.append(element)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            stop = end.start() if end else n
            element.children.append(html[at:stop] if tag in ("script", "style") else unescape(html[at:stop]))
            at = html.find(">", stop) + 1 if end else n
            if not at:
                return root
            seen = at
        elif tag not in VOID and tag not in ("html", "body") and not (closed and any(x.tag in ("svg", "math") for x in [*stack, element])):
            if len(stack) < MAX_DEPTH:
                stack.append(element)
            else:
                beyond.append(tag)


def _imply(stack: list[Element], tag: str) -> None:
    if tag in IMPLIED:
        closes, within = IMPLIED[tag]
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in within:
                break
            if stack[k].tag in closes:
                lowest = k
                while tag in ("tr", "thead", "tbody", "tfoot") and stack[lowest - 1].tag in closes:
                    lowest -= 1
                del stack[lowest:]
                break
    elif tag in CLOSES_P:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in BLOCK or stack[k].tag in SCOPE:
                break
    if tag == "table":
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ("td", "th", "caption"):
                break
            if stack[k].tag == "table":  # a table outside any cell ends the one it stands in
                del stack[k:]
                break
    if tag == "body" and len(stack) > 1 and stack[1].tag == "head" or stack[-1].tag == "head" and tag not in IN_HEAD and tag != "html":
        del stack[1:]


def _close_beyond(beyond: list[str], tag: str) -> bool:
    """Whether an end tag belongs among the elements beyond the depth: it ends one of them, or reaches no further."""
    for k in range(len(beyond) - 1, -1, -1):
        if beyond[k] == tag:
            del beyond[k:]
            return True
        if beyond[k] in SCOPE and tag not in ("table", "tr", "thead", "tbody", "tfoot"):
            return True
    return False


def _close(stack: list[Element], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in SCOPE and tag not in ("table", "tr", "thead", "tbody", "tfoot"):
            return


_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_SHOWS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-zA-Z-]+)\s*(!\s*important)?", re.I)


def _declared(text: str) -> dict[str, tuple[bool, str]]:
    """property -> (important, value) of display and visibility in a declaration list; later ones win."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in _SHOWS.findall(text):
        if bool(important) >= out.get(name.lower(), (False,))[0]:
            out[name.lower()] = bool(important), value.lower()
    return out


class Sheet:
    """Rules on display and visibility, by one class, id or tag that an element must have."""

    def __init__(self, root: Element):
        self.rules: dict[str, dict[tuple, dict]] = {}
        self.known: dict[tuple, tuple[bool, str | None]] = {}
        todo, order = [root], 0
        while todo:
            element = todo.pop()
            if element.tag == "style":
                for selectors, body in self._blocks("".join(x for x in element.children if isinstance(x, str))):
                    declared = _declared(body)
                    for selector in selectors.split(",") if declared else ():
                        order += 1
                        self._add(selector.strip(), declared, order)
            todo += [x for x in reversed(element.children) if isinstance(x, Element)]

    @staticmethod
    def _blocks(css: str) -> Iterator[tuple[str, str]]:
        """(selectors, declarations) at the top level; blocks of at-rules are passed over."""
        css, at = re.sub(r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|<!--|-->", " ", css), 0
        while (start := css.find("{", at)) >= 0:
            head = css[at:start].rpartition(";")[2].strip()
            if not head.startswith("@"):
                end = css.find("}", start)
                yield head, css[start + 1 : end if end >= 0 else len(css)]
            else:
                depth, end = 1, start
                for m in re.compile("[{}]").finditer(css, start + 1):
                    depth += 1 if m[0] == "{" else -1
                    if not depth:
                        end = m.start()
                        break
                else:
                    return
            if end < 0:
                return
            at = end + 1

    def _add(self, selector: str, declared: dict, order: int) -> None:
        m = _SELECTOR.fullmatch(selector)
        if not m or not selector:
            return
        tag = (m[1] or "*").lower()
        parts = re.findall(r"[.#][\w-]+", m[2])
        weight = sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), tag != "*"
        rule = self.rules.setdefault(parts[0] if parts else tag, {}).setdefault((tag, frozenset(parts)), {})
        for name, (important, value) in declared.items():
            rule[name] = max(rule.get(name, ((-2,), "")), ((important, 0, *weight, order), value))

    def shows(self, element: Element) -> tuple[bool, str | None]:
        """(whether the element makes a box, its own visibility if it has any)."""
        a, tag = element.attributes, element.tag
        if tag in HIDDEN or tag == "dialog" and "open" not in a or tag == "input" and a.get("type", "").lower() == "hidden":
            return False, None
        style = a.get("style")
        if not self.rules and not style:
            return "hidden" not in a, None
        key = tag, a.get("class"), a.get("id"), style, "hidden" in a
        if key not in self.known:
            self.known[key] = self._cascade(*key)
        return self.known[key]

    def _cascade(self, tag: str, classes: str | None, own_id: str | None, style: str | None, hidden: bool) -> tuple[bool, str | None]:
        best: dict[str, tuple] = {"display": ((-1,), "none")} if hidden else {}
        marks = {f".{c}" for c in (classes or "").split()} | ({f"#{own_id}"} if own_id else set())
        for key in (*marks, tag, "*"):
            for (wanted, parts), rule in self.rules.get(key, {}).items():
                if wanted in ("*", tag) and parts <= marks:
                    for name, found in rule.items():
                        best[name] = max(best.get(name, ((-2,), "")), found)
        for name, (important, value) in _declared(style).items() if style else ():
            best[name] = max(best.get(name, ((-2,), "")), ((important, 1), value))
        display, own = (best.get(k, ((), None))[1] for k in ("display", "visibility"))
        return display != "none", own


class Page:
    """Lines of text as they come. Vertical margins collapse; inline white space does too, outside preformatted text."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.indent, self.mark, self.gap = "", "", False
        self.visible = True

    def write(self, text: str, pre: bool) -> None:
        if not self.visible:
            return
        if pre:
            first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.inline.append(first)
            for line in rest:
                self.flush(pre=True)
                self.inline.append(line)
        elif text:
            self.inline.append(_SPACE.sub(" ", text))

    def flush(self, pre: bool = False, always: bool = False) -> None:
        line = "".join(self.inline)
        self.inline.clear()
        line = line.rstrip() if pre else _SPACE.sub(" ", line).strip(" ")
        if not line and not (pre and self.lines) and not (always and self.lines):
            return
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.indent + self.mark + line).rstrip())
        if self.mark:
            self.indent, self.mark = self.indent + " " * len(self.mark), ""

    def margin(self) -> None:
        self.flush()
        self.gap = True

    def text(self) -> str:
        self.flush()
        return "\n".join(self.lines).strip("\n")


def render(element: Element, sheet: Sheet | None = None, visible: bool = True, pre: bool = False) -> str:
    page = Page()
    page.visible = visible
    _children(element, page, pre, sheet or Sheet(element))
    return page.text()


def _children(element: Element, page: Page, pre: bool, sheet: Sheet) -> None:
    number = 0
    for child in element.children:
        if isinstance(child, str):
            page.write(child, pre)
            continue
        shown, own = sheet.shows(child)
        if not shown or child.tag in ("desc", "metadata", "defs") and element.tag == "svg":
            continue
        if child.tag == "li":
            number += 1
        if own is None:
            _element(child, element, number, page, pre, sheet)
        else:
            before, page.visible = page.visible, own not in ("hidden", "collapse")
            _element(child, element, number, page, pre, sheet)
            page.visible = before


def _element(child: Element, parent: Element, number: int, page: Page, pre: bool, sheet: Sheet) -> None:
    tag = child.tag
    if tag == "br":
        page.flush(pre, always=not page.inline)
    elif tag == "hr":
        page.margin()
    elif tag == "li":
        page.flush()
        before = page.indent
        if page.visible:
            page.mark = f"{child.attributes.get('value', '') or number}. " if parent.tag == "ol" else "- "
        _children(child, page, pre, sheet)
        page.flush()
        page.indent, page.mark = before, ""
    elif tag in ("ul", "ol", "menu"):
        outer = parent.tag not in ("li", "ul", "ol", "menu")
        page.margin() if outer else page.flush()
        before = page.indent
        _children(child, page, pre, sheet)
        page.flush()
        page.indent = before
        page.gap = page.gap or outer
    elif tag == "table":
        page.margin()
        for line in _table(child, sheet, page.visible):
            page.inline.append(line)
            page.flush(pre=True)
        page.gap = True
    elif tag == "dd":
        page.flush()
        before, page.indent = page.indent, page.indent + "  "
        _children(child, page, pre, sheet)
        page.flush()
        page.indent = before
    elif tag == "details" and "open" not in child.attributes:
        page.flush()
        for x in child.children:
            if isinstance(x, Element) and x.tag == "summary" and sheet.shows(x)[0]:
                _children(x, page, pre, sheet)
                break
        page.flush()
    elif tag in BLOCK:
        page.margin() if tag in MARGIN else page.flush()
        before = page.indent
        page.indent = before + ("> " if tag == "blockquote" else "")
        _children(child, page, pre or tag == "pre", sheet)
        page.flush(pre or tag == "pre") if page.inline else None
        page.indent = before
        page.gap = page.gap or tag in MARGIN
    elif tag in ("td", "th"):  # a cell outside any table
        page.write(" ", False)
        _children(child, page, pre, sheet)
    elif tag == "img":
        page.write(child.attributes.get("alt", ""), False)
    elif tag == "input":
        if child.attributes.get("type", "").lower() in ("submit", "button", "reset"):
            page.write(child.attributes.get("value", ""), False)
    else:
        _children(child, page, pre, sheet)


_SECTIONS = ("thead", "tbody", "tfoot")


def _parts(element: Element, loose: list, rows: list[tuple[Element, bool]], sheet: Sheet, visible: bool) -> None:
    """Deals what stands in a table to its rows, a row for cells without one, and to the loose content that browsers move out."""
    implied = None
    for child in element.children:
        if isinstance(child, Element) and child.tag in ("td", "th"):
            if implied is None:
                rows.append((implied := Element("tr", {}), visible))
            implied.children.append(child)
            continue
        if isinstance(child, str):
            loose.append(child)
            continue
        if child.tag in ("colgroup", "col"):
            continue
        implied = None
        shown, own = sheet.shows(child)
        if not shown:
            continue
        seen = visible if own is None else own not in ("hidden", "collapse")
        if child.tag == "tr":
            rows.append((child, seen))
        elif child.tag in (*_SECTIONS, "form"):
            _parts(child, loose, rows, sheet, seen)
        else:
            loose.append(child)


def _grid(rows: list[tuple[Element, bool]], sheet: Sheet) -> list[list[tuple[int, int, list[str]]]]:
    """(column, columns spanned, lines) of the cells of each row."""
    grid: list[list[tuple[int, int, list[str]]]] = []
    held: list[tuple[int, int, int]] = []  # first column, column after the last, row after the last
    for k, (row, visible) in enumerate(rows):
        taken = [x for x in held if x[2] > k]
        held, cells, column, free = [], [], 0, 0
        for cell in row.children:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                wrapped = Element("td", {})
                wrapped.children = [cell]
                cell = wrapped
            shown, own = sheet.shows(cell)
            if not shown:
                continue
            while free < len(taken) and taken[free][0] <= column:
                column = max(column, taken[free][1])
                free += 1
            across = _count(cell.attributes.get("colspan"), MAX_COLSPAN, 1)
            down = _count(cell.attributes.get("rowspan"), MAX_ROWSPAN, len(rows))
            cells.append((column, across, render(cell, sheet, visible if own is None else own not in ("hidden", "collapse")).split("\n")))
            if down > 1 and k + 1 < len(rows):
                held.append((column, column + across, min(k + down, len(rows))))
            column += across
        grid.append(cells)
        held = _joined(sorted(taken + held))
    return [cells for cells in grid if any(x for _, _, lines in cells for x in lines)]


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbours that end in the same row as one."""
    out: list[tuple[int, int, int]] = []
    for a, b, end in spans:
        if out and out[-1][1] >= a and out[-1][2] == end:
            out[-1] = (out[-1][0], max(b, out[-1][1]), end)
        else:
            out.append((a, b, end))
    return out


def _table(table: Element, sheet: Sheet, visible: bool = True) -> list[str]:
    """Lines of a table: its caption, loose text, then rows with cells padded to their column's width."""
    loose, rows = Element("div", {}), []
    _parts(table, loose.children, rows, sheet, visible)
    lines = [x for x in render(loose, sheet, visible).split("\n") if x]
    grid = _grid(rows, sheet)
    columns = sorted({c for cells in grid for c, _, _ in cells})
    place = {c: i for i, c in enumerate(columns)}
    width = [0] * len(columns)
    wide = lambda own: max((len(x) for x in own if len(x) <= MAX_WIDTH), default=0)
    spanning, size = [], 1 << 16
    for cells in grid:
        for c, across, own in cells:
            size += MAX_PADDING * sum(map(len, own))
            first, last = place[c], bisect_left(columns, c + across) - 1
            if first == last:
                width[first] = max(width[first], wide(own))
            elif wide(own):
                spanning.append((first, last, wide(own)))
    for first, last, needed in spanning:  # a spanning cell may lean on all its columns; the last grows if need be
        width[last] += max(0, needed - sum(width[first : last + 1]) - 2 * (last - first))
    left = [0, *accumulate(w + 2 for w in width)]
    if left[-1] * sum(max(len(own) for _, _, own in cells) for cells in grid) > size:
        left = [0] * len(left)
    for cells in grid:
        for k in range(max(len(own) for _, _, own in cells)):
            line = ""
            for c, _, own in cells:
                if k < len(own) and own[k]:
                    line = line.ljust(left[place[c]]) if len(line) + 2 <= left[place[c]] or not line else line + "  "
                    line += own[k]
            lines.append(line.rstrip())
    return lines


def _count(text: str | None, most: int, none: int) -> int:
    """A span: 1 where it is missing or no number, `none` for 0, at most the standard's limit."""
    text = (text or "").strip()
    if not text.isascii() or not text.isdigit():
        return 1
    return min(int(text[:9]), most) if text.strip("0") else none


def visible_text(html: str | None) -> str:
    return render(parse(html or ""))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars per row of pages; null and empty html give empty text. Repeated rows and null ids stay as they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [visible_text(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "text", "n_chars"])

    return with_defaults(pages, page_id="long", html="string").mapInArrow(work, "page_id long, text string, n_chars long")
