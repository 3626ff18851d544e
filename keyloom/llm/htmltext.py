"""HTML to text, laid out as a reader sees it.

A tokenizer feeds a tree builder that keeps the stack of open elements and closes or opens what HTML implies (p before a
block, li before li, cells, rows, options, dt/dd, html/body). What an element shows follows from its kind, the attribute
hidden, its inline style and the page's style elements (selectors of a tag, classes and an id; others, and rules for other
media than screen, are passed over): display none hides all that is within, visibility hides text until an element within is
visible again. In SVG the text elements are shown, MathML is shown but for its annotations. All shown text is kept: blocks
start on new lines, paragraphs and headings are set off by a blank line, list items get their bullet or number and the indent
of their depth, `pre` keeps its white space, `br` breaks, and table cells are padded so that columns line up, over colspan
and rowspan.

Layout has bounds, text and visibility have none: beyond `TABLES` nested tables cells become blocks, beyond `INDENT` columns
lists indent no further, and of rowspans that reach down at the same time `SPANS` hold their columns.

Defined cases: null gives null, an empty page the empty text; unclosed, stray and misnested tags are repaired, never an
error; white space in the result is a space or a line break; of equal attributes the first counts; null or repeated ids are
rows like any other; an empty table gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from keyloom.llm.common import picked, texts_of

TABLES, INDENT, SPANS = 40, 60, 100

# Element names by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_SHOWN = frozenset("head title script style template noscript meta link base datalist iframe noframes noembed object audio video canvas rp annotation annotation-xml".split())
NOT_DRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())  # within svg
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCKS = SPACED | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav optgroup option section search summary tbody td tfoot th thead tr".split())
CLOSES_P = BLOCKS - frozenset("body caption html li option optgroup tbody td tfoot th thead tr legend dd dt".split()) | frozenset("li dd dt".split())
LISTS = frozenset("ul ol menu dir".split())
SCOPE = frozenset("table td th caption html button".split())
# Start tag -> elements that it closes, and elements at which the search stops.
IMPLIED = {
    "li": (frozenset(["li"]), LISTS | SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup"]) | SCOPE),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"]) | SCOPE),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
HEAD_ONLY = frozenset("base link meta title style script noscript template head html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^ \t\n\r\f/>=]+)(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\r\f>]+)))?")
_ASKED = re.compile(r"hidden|style", re.IGNORECASE)
_NAMED = re.compile(r"class|id", re.IGNORECASE)
_STYLE = re.compile(r"<style", re.IGNORECASE)
_COMPOUND = re.compile(r"(?P<tag>\*|[a-z][\w-]*)?(?P<rest>(?:[.#][\w-]+)*)\Z", re.IGNORECASE)
_NUMBER = re.compile(r"\s*(\d{1,9})")
_NOT_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*\"|'[^']*'|\([^)]*\)", re.DOTALL)
_START = re.compile(r"\s*(-?\d{1,9})")
_SPACES = re.compile(r"[ \t\n\r\f\v   \x85\x1c-\x1f]+")


def attributes_of(raw: str) -> dict[str, str]:
    """Names in lower case and values without quotes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def declared(css: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a list of declarations, each with whether it is marked important."""
    held: dict[str, tuple[bool, str]] = {}
    for x in _NOT_CSS.sub(" ", css).lower().split(";"):
        name, _, value = x.partition(":")
        value, mark, _ = value.partition("!")
        name, value, strong = name.strip(), value.strip(), bool(mark)
        if name in ("display", "visibility") and value and strong >= held.get(name, (False, ""))[0]:
            held[name] = strong, value
    return held


class Sheet:
    """The rules of a page's style elements that say something about display or visibility."""

    def __init__(self) -> None:
        #: By one name that the selector asks for ("#id", ".class", "tag" or "*"): rank, all names asked for, declarations.
        self.rules: dict[str, list[tuple[tuple, frozenset, dict]]] = {}
        self.order = 0

    def add(self, css: str) -> None:
        css = re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.DOTALL)
        at = 0
        while (brace := css.find("{", at)) >= 0:
            prelude, end, depth = css[at:brace].rpartition(";")[2].strip(), brace + 1, 1
            for m in re.compile(r"[{}]").finditer(css, brace + 1):
                depth += 1 if m[0] == "{" else -1
                end = m.end()
                if not depth:
                    break
            else:
                end = len(css)
            body, at = css[brace + 1 : end - (depth == 0)], end
            if prelude.lower().startswith("@media"):
                if prelude[6:].strip().lower() in ("all", "screen", "only screen", "only all"):
                    self.add(body)
            elif not prelude.startswith("@"):
                self._rule(prelude, declared(body))

    def _rule(self, selectors: str, says: dict[str, tuple[bool, str]]) -> None:
        self.order += 1
        for selector in selectors.split(",") if says else ():
            m = _COMPOUND.match(selector.strip())
            if not m or not m[0]:
                continue
            names = re.findall(r"[.#][\w-]+", m["rest"])
            tag = (m["tag"] or "*").lower()
            rank = (sum(x[0] == "#" for x in names), sum(x[0] == "." for x in names), tag != "*", self.order)
            key = names[0] if names else tag
            self.rules.setdefault(key, []).append((rank, frozenset([*names, *([] if tag == "*" else [tag])]), says))

    def fitting(self, names: set[str]) -> Iterator[tuple[tuple, dict]]:
        for x in (*names, "*"):
            for rank, asked, says in self.rules.get(x, ()):
                if asked <= names:
                    yield rank, says


def sheet_of(page: str) -> Sheet:
    sheet, at = Sheet(), 0
    while _STYLE.search(page, at):
        m = _TOKEN.search(page, at)
        if m is None:
            break
        at, name = m.end(), (m[2] or "").lower()
        if name in RAW or name in ("noscript", "template"):
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            inner, at = page[at : end.start() if end else len(page)], end.end() if end else len(page)
            if name == "style" and attributes_of(m[3]).get("media", "").strip().lower() in ("", "all", "screen"):
                sheet.add(inner)
    return sheet


def seen(name: str, raw: str, sheet: Sheet) -> tuple[str, str]:
    """What is said about an element's display and visibility, each empty if nothing."""
    if not sheet.rules and not (raw and _ASKED.search(raw)):
        return "", ""
    found = attributes_of(raw) if raw and (_ASKED.search(raw) or _NAMED.search(raw)) else {}
    held: dict[str, tuple[tuple, str]] = {}
    if found.get("hidden", "until-found").strip().lower() != "until-found":
        held["display"] = (False,), "none"
    if sheet.rules:
        names = {name, *(f".{x}" for x in found.get("class", "").split()), *([f"#{found['id']}"] if found.get("id") else [])}
        for rank, says in sheet.fitting(names):
            for what, (strong, value) in says.items():
                held[what] = max(held.get(what, ((False,), "")), ((strong, False, rank), value))
    for what, (strong, value) in declared(found["style"]).items() if found.get("style") else ():
        held[what] = max(held.get(what, ((False,), "")), ((strong, True, ()), value))
    return held.get("display", ((), ""))[1], held.get("visibility", ((), ""))[1]


class Layout:
    """Collects lines. `gap`: line breaks still owed before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now, self.owed, self.space, self.indent, self.lead = "", 0, False, "", ""

    def text(self, s: str, kept: bool) -> None:
        if kept:
            first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").replace("\t", "    ").split("\n")
            self._put(first)
            for x in rest:
                self.line()
                self._put(x)
            return
        words = _SPACES.sub(" ", s)
        if words == " ":
            self.space = self.space or bool(self.now)
            return
        if words:
            if words[0] == " ":
                self.space = self.space or bool(self.now)
            body = words.strip(" ")
            self._put((" " if self.space and self.now else "") + body)
            self.space = words[-1] == " "

    def _put(self, s: str) -> None:
        if not s:
            return
        if self.owed:
            if self.lines:
                self.lines += [""] * (self.owed - 1)
            self.owed = 0
        if not self.now:
            s = (self.lead or self.indent) + s
            self.lead = ""
        self.now += s
        self.space = False

    def line(self) -> None:
        """End the line; an empty one counts (br, pre)."""
        self.lines.append(self.now.rstrip())
        self.now, self.space = "", False

    def block(self, spaced: bool) -> None:
        if self.now:
            self.line()
        self.space = False
        if self.lines:
            self.owed = max(self.owed, 2 if spaced else 1)

    def result(self) -> str:
        if self.now:
            self.line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        at = 0
        while at < len(lines) and not lines[at]:
            at += 1
        return "\n".join(lines[at:])


class Table:
    def __init__(self, outer: Layout):
        self.outer, self.captions = outer, []
        self.rows: list[list[tuple[str, int, int]]] = []  # text, colspan, rowspan (0: to the table's end)

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """The cells of each row as first column, column after the last, lines; columns that a rowspan holds are passed over."""
        out, held = [], []  # held: (first, end, row after the last) of the rowspans, in the order of their columns
        for r, row in enumerate(self.rows):
            held = [x for x in held if x[2] > r]
            at, k, cells, new = 0, 0, [], []
            for text, wide, high in row:
                while k < len(held) and held[k][0] <= at:
                    at = max(at, held[k][1])
                    k += 1
                cells.append((at, at + wide, text.split("\n") if text else []))
                if high != 1:
                    new.append((at, at + wide, r + high if high else len(self.rows)))
                at += wide
            held = sorted(held + new)[:SPANS] if new else held
            out.append(cells)
        return out

    def put(self) -> None:
        """The rows, cells padded to their columns' widths, written to the layout around the table."""
        for text in self.captions:
            if text:
                for line in text.split("\n"):
                    self.outer._put(line)
                    self.outer.line()
        rows = [row for row in self.placed() if any(lines for _, _, lines in row)]
        columns = sorted({cell[0] for row in rows for cell in row})  # others are never the first of a cell and take no room
        widths = dict.fromkeys(columns, 0)
        for row in rows:
            for first, end, lines in row:
                if end <= first + 1 or bisect_left(columns, end) == bisect_left(columns, first) + 1:
                    widths[first] = max(widths[first], max(map(len, lines), default=0))
        for row in rows:
            for first, end, lines in row:
                a, b = bisect_left(columns, first), bisect_left(columns, end)
                if lines and b > a + 1:  # what a wide cell lacks, its last column gets
                    lack = max(map(len, lines)) - sum(widths[c] for c in columns[a:b]) - 2 * (b - a - 1)
                    widths[columns[b - 1]] += max(0, lack)
        starts, at = {}, 0
        for c in columns:
            starts[c] = at
            at += widths[c] + 2
        for row in rows:
            for n in range(max(len(lines) for _, _, lines in row)):
                line = ""
                for first, _, lines in row:
                    if n < len(lines) and lines[n]:
                        line = line.ljust(starts[first]) if len(line) < starts[first] else line and line + " "
                        line += lines[n]
                if line := line.rstrip():
                    self.outer._put(line)
                    self.outer.line()


class Open(NamedTuple):
    """An open element. how: what it is to the layout, empty if it is not displayed."""

    name: str
    gone: bool
    unseen: bool
    silent: bool
    how: str


_ROOT = Open("", False, False, False, "")


class Builder:
    def __init__(self, sheet: Sheet) -> None:
        self.layout, self.sheet = Layout(), sheet
        self.stack: list[Open] = []
        self.at: dict[str, list[int]] = {}  # where in the stack each name is, so that no search grows with the depth
        self.pre = 0
        self.lists: list[list] = []  # [ordered, next number, indent before]
        self.indents: list[str] = []  # before each dd
        self.tables: list[Table] = []
        self.spans: list[tuple[int, int]] = []
        self.flat = 0  # open tables beyond TABLES
        self.layouts: list[Layout] = []

    def start(self, name: str, attributes: str) -> None:
        if name in IMPLIED:
            closes, stops = IMPLIED[name]
            self._close_until(closes, stops)
        elif name not in HEAD_ONLY and any(x.name == "head" for x in self.stack[:3]):
            self._close_until(frozenset(["head"]), frozenset())
        if name in CLOSES_P:
            self._close_until(frozenset(["p"]), SCOPE | LISTS if name == "li" else SCOPE)
        if name in ("td", "th") and (self.tables or self.flat) and not self._open_since("tr", "table"):
            self.start("tr", "")
        if name in ("td", "th", "tr", "caption") and not self._open_since("table", ""):
            name = "div"  # outside of any table it's a block like others
        up = self.stack[-1] if self.stack else _ROOT
        display, visibility = seen(name, attributes, self.sheet)
        gone = up.gone or name in NEVER_SHOWN or display == "none"
        if name == "dialog" and not display:
            gone = gone or "open" not in attributes_of(attributes)
        if self.at.get("svg") and name in NOT_DRAWN:
            gone = True
        unseen = name == "mphantom" or (up.unseen if visibility in ("", "inherit", "unset", "revert") else visibility in ("hidden", "collapse"))
        silent = name == "svg" or (up.silent and name not in ("text", "foreignobject"))
        if name in VOID:
            if not (gone or unseen or silent):
                if name == "br":
                    self.layout.line() if not self.layout.owed else self.layout._put("")
                elif name == "hr":
                    self.layout.block(True)
            return
        how = "" if gone else name
        if how == "table" and len(self.tables) >= TABLES:
            how = "flat"
        elif how in ("tr", "td", "th", "caption") and (self.flat or not self.tables):
            how = "div"  # of a table that is nested too deep
        elif how == "text" and up.silent:
            how = "div"  # each text of a drawing stands for itself
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append(Open(name, gone, unseen, silent, how))
        if how:
            self._opened(how, attributes)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
            return
        if name == "p" and not self.at.get("p"):
            self.start("p", "")
        stops = frozenset(["table"]) if name in ("tr", "td", "th", "tbody", "thead", "tfoot") else frozenset(["td", "th", "caption"]) if name not in ("table", "body", "html") else frozenset()
        self._close_until(frozenset([name]), stops - {name}, last=True)

    def text(self, s: str) -> None:
        up = self.stack[-1] if self.stack else _ROOT
        if up.gone or up.unseen or up.silent:
            return
        if up.how in ("table", "tr") or (up.how in ("tbody", "thead", "tfoot") and self.tables and not self.flat):
            if s.strip():  # text between cells is shown before the table
                self.tables[-1].outer.text(s, False)
            return
        self.layout.text(s, self.pre > 0)

    def finish(self) -> str:
        while self.stack:
            self._pop()
        return self.layout.result()

    def _innermost(self, names: Iterable[str]) -> int:
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)

    def _open_since(self, name: str, stop: str) -> bool:
        return self._innermost([name]) > self._innermost([stop])

    def _close_until(self, names: frozenset, stops: frozenset, last: bool = False) -> None:
        """Close the outermost (last: the innermost) open element of these names above any stop, and all within it."""
        stop = self._innermost(stops - names)
        if last:
            at = self._innermost(names)
        else:
            open_ = [self.at[x] for x in names if self.at.get(x)]
            at = min((x[bisect_right(x, stop)] for x in open_ if x[-1] > stop), default=-1)
        if at > stop:
            while len(self.stack) > at:
                self._pop()

    def _deeper(self, before: str, by: int) -> str:
        return before + " " * by if len(before) < INDENT else before

    def _opened(self, how: str, attributes: str) -> None:
        if how in LISTS:
            nested = bool(self.lists)
            self.layout.block(not nested)
            start = _START.match(attributes_of(attributes).get("start", "")) if how == "ol" and attributes else None
            self.lists.append([how == "ol", int(start[1]) if start else 1, self.layout.indent])
        elif how == "li":
            self.layout.block(False)
            before = self.lists[-1][2] if self.lists else self.layout.indent
            mark = "- "
            if self.lists and self.lists[-1][0]:
                mark = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            self.layout.lead, self.layout.indent = before + mark, self._deeper(before, len(mark)) if self.lists else before
        elif how == "dd":
            self.layout.block(False)
            self.indents.append(self.layout.indent)
            self.layout.indent = self._deeper(self.layout.indent, 4)
        elif how == "table":
            self.layout.block(True)
            self.tables.append(Table(self.layout))
        elif how == "flat":
            self.layout.block(False)
            self.flat += 1
        elif how == "tr":
            self.tables[-1].rows.append([])
        elif how in ("td", "th", "caption"):
            found = attributes_of(attributes) if attributes else {}
            wide, high = _NUMBER.match(found.get("colspan", "1")), _NUMBER.match(found.get("rowspan", "1"))
            # The spans that HTML allows.
            self.spans.append((min(max(int(wide[1]), 1), 1000) if wide else 1, min(int(high[1]), 65534) if high else 1))
            self.layouts.append(self.layout)
            self.layout = Layout()
        elif how in BLOCKS:
            self.layout.block(how in SPACED)
            if how == "pre":
                self.pre += 1

    def _pop(self) -> None:
        name, *_, how = self.stack.pop()
        self.at[name].pop()
        if not how:
            return
        if how in LISTS:
            self.layout.indent, self.layout.lead = self.lists.pop()[2], ""
            self.layout.block(not self.lists)
        elif how == "li":
            self.layout.block(False)
            self.layout.lead = ""
            if self.lists:
                self.layout.indent = self.lists[-1][2]
        elif how == "dd":
            self.layout.block(False)
            self.layout.indent = self.indents.pop()
        elif how == "table":
            self.tables.pop().put()
            self.layout.block(True)
        elif how == "flat":
            self.flat -= 1
            self.layout.block(False)
        elif how in ("td", "th", "caption"):
            text, self.layout = self.layout.result(), self.layouts.pop()
            wide, high = self.spans.pop()
            if how == "caption":
                self.tables[-1].captions.append(text)
            else:
                self.tables[-1].rows[-1].append((text, wide, high))
        elif how in BLOCKS and how != "tr":
            if how == "pre":
                self.pre -= 1
            self.layout.block(how in SPACED)


def render(page: str | None) -> str | None:
    if page is None:
        return None
    out, at, find = Builder(sheet_of(page) if _STYLE.search(page) else Sheet()), 0, _TOKEN.search
    while True:
        m = find(page, at)
        if m is None:
            if at < len(page):
                out.text(html.unescape(page[at:]))
            return out.finish()
        if m.start() > at:
            out.text(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2]:
            name = m[2].lower()
            out.start(name, m[3])
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                inner = page[at : end.start() if end else len(page)]
                out.text(html.unescape(inner) if name in ("textarea", "title") else inner)
                out.end(name)
                at = end.end() if end else len(page)
        elif m[1]:
            out.end(m[1].lower())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, text, n_chars, n_lines (null where html is)."""
    rows = picked(pages, page_id=id_col, html=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [render(x) for x in texts_of(batch.column(1))]
            n = [None if x is None else len(x) for x in found]
            lines = [None if x is None else x.count("\n") + bool(x) for x in found]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string()), pa.array(n, pa.int64()), pa.array(lines, pa.int64())], names=["page_id", "text", "n_chars", "n_lines"])

    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, text string, n_chars long, n_lines long")
