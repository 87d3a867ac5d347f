"""Markdown blocks inside quotes, list items and HTML, by an automaton over lines.

The state is the stack of open containers (a quote, or an item with the columns its content
must be indented) and the open leaf (paragraph, fence, HTML or indented code). Each line first
matches what it can of the stack, which strips its prefix; the rest opens new containers, goes
on with the leaf or starts another one. Blocks are handed on as soon as they close, with the
line of the whole text they began at.

Only texts with a sign of such blocks come here (``NEEDED``); ``markdown.blocks`` cuts the others
without leaving the JVM, and both agree on what both can cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

#: A line that may open a quote, an item or an HTML block, or define a link. A turn marker is none.
NEEDED = r"(?m)(?d)^[ \t]*+(?:>|[-+*](?:[ \t]|$)|[0-9]{1,9}[.)](?:[ \t]|$)|<(?!!--)[A-Za-z/!?]|\[[^\]\n]++\]:)"

#: Texts of a batch whose blocks are held as Python objects at once.
TEXTS = 64
_TAB = 4
_LEAD = re.compile(r"[ \t]*")
_FENCE = re.compile(r"(`{3,}|~{3,})(.*)\Z", re.S)
_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*)|)\Z", re.S)
_ATX_END = re.compile(r"(?:[ \t]+#+|\A#+)[ \t]*\Z")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_SETEXT = re.compile(r"(=+|-+)[ \t]*\Z")
_ITEM = re.compile(r"([-+*]|([0-9]{1,9})[.)])(?=[ \t]|\Z)")
_STARTS = frozenset(">`~#*-+_=<0123456789")
_DEFINITION = re.compile(
    r"[ \t]{0,3}\[(?:[^\[\]\\]|\\.)*[^\[\]\\\s](?:[^\[\]\\]|\\.)*\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)"
    r"""(?:[ \t]*(?:\n[ \t]*|[ \t])(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|\Z)""", re.S)

#: Fixed values of the format: elements that start an HTML block up to a blank line.
_ELEMENTS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|"
    "fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|"
    "main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|"
    "title|tr|track|ul"
)
_ATTRIBUTE = r"""[ \t]+[A-Za-z_:][A-Za-z0-9_.:-]*(?:[ \t]*=[ \t]*(?:[^ \t"'=<>`]+|'[^']*'|"[^"]*"))?"""
_TAG = rf"<(?:[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*[ \t]*/?|/[A-Za-z][A-Za-z0-9-]*[ \t]*)>[ \t]*\Z"
#: How an HTML block starts, how it ends (None: in front of a blank line), and whether it ends a paragraph.
_HTML = [(re.compile(start, re.I), end and re.compile(end, re.I), ends) for start, end, ends in (
    (r"<(?:script|pre|style|textarea)(?=[ \t>]|\Z)", r"</(?:script|pre|style|textarea)>", True),
    (r"<!--", r"-->", True),
    (r"<\?", r"\?>", True),
    (r"<![A-Z]", r">", True),
    (r"<!\[CDATA\[", r"\]\]>", True),
    (rf"</?(?:{_ELEMENTS})(?=[ \t>]|/>|\Z)", None, True),
    (_TAG, None, False),
)]


def _indent(rest: str, column: int) -> tuple[int, int]:
    """Columns of white space in front of ``rest``, which starts at ``column``; and its characters."""
    at = column
    lead = _LEAD.match(rest).end()
    for c in rest[:lead]:
        at += 1 if c == " " else _TAB - at % _TAB
    return at - column, lead


def _take(rest: str, column: int, most: int) -> tuple[str, int]:
    """``rest`` without up to ``most`` columns of white space; what is left of a cut tab becomes spaces."""
    at, i = column, 0
    while i < len(rest) and at - column < most and rest[i] in " \t":
        at += 1 if rest[i] == " " else _TAB - at % _TAB
        i += 1
    over = max(at - column - most, 0)
    return " " * over + rest[i:], at - over


class _Leaf:
    """An open leaf block: its kind, first line, lines so far and what ends it."""

    def __init__(self, kind: str, line: int, **more) -> None:
        self.kind, self.line, self.lines = kind, line, []
        self.__dict__.update(more)


class Cutter:
    """Reads the lines of one text in order; ``found`` has the closed blocks."""

    def __init__(self) -> None:
        self.found: list[dict] = []
        #: Columns of content of an item, or None for a quote; and the items that have no content yet.
        self.stack: list[int | None] = []
        self.bare: int | None = None
        self.leaf: _Leaf | None = None

    def read(self, text: str) -> Cutter:
        number = -1
        for number, line in enumerate(text.split("\n")):
            self._line(number, line)
        self.lines = number + 1
        return self

    def blocks(self) -> list[dict]:
        self._close(self.lines, closed=False)
        return sorted(self.found, key=lambda b: b["line"])

    def open_at_end(self) -> bool:
        """Whether a fence, or HTML with an end of its own, takes in what follows at the left margin."""
        leaf = self.leaf
        return not self.stack and leaf is not None and (
            leaf.kind == "fence" or leaf.kind == "html" and leaf.end is not None)

    # --- one line ---------------------------------------------------------------------------
    def _line(self, number: int, line: str) -> None:
        rest, column, depth = line, 0, 0
        for needed in self.stack:
            indent, lead = _indent(rest, column)
            blank = lead == len(rest)
            if needed is None:
                if indent > 3 or not rest.startswith(">", lead):
                    break
                rest, column = self._after_quote(rest[lead:], column + indent)
            elif blank and depth != self.bare:
                rest, column = _take(rest, column, needed)
            elif not blank and indent >= needed:
                rest, column = _take(rest, column, needed)
            else:
                break
            depth += 1
        if depth == len(self.stack) and self.leaf is not None and self.leaf.kind != "para" and self._go_on(number, rest, column):
            return
        self._start(number, rest, column, depth)

    @staticmethod
    def _after_quote(rest: str, column: int) -> tuple[str, int]:
        return _take(rest[1:], column + 1, 1)

    def _go_on(self, number: int, rest: str, column: int) -> bool:
        """Whether the line belongs to the open fence, HTML or code."""
        leaf = self.leaf
        indent, lead = _indent(rest, column)
        blank = lead == len(rest)
        if leaf.kind == "fence":
            body = rest[lead:].rstrip(" \t")
            if indent <= 3 and len(body) >= len(leaf.mark) and not body.strip(leaf.mark[0]):
                self._close(number + 1, closed=True)
            else:
                leaf.lines.append(_take(rest, column, leaf.indent)[0] if leaf.indent else rest)
            return True
        if leaf.kind == "html":
            if leaf.end is None and blank:
                self._close(number, closed=True)
                return False
            if leaf.end is not None and leaf.end.search(rest):
                self._close(number + 1, closed=True)
            return True
        if blank or indent >= 4:
            return True
        self._close(number, closed=True)
        return False

    def _start(self, number: int, rest: str, column: int, depth: int) -> None:
        """What is left of a line behind the containers it matched: new containers, then a leaf."""
        new = False  # the line opened something, so no open paragraph goes on

        def open_new() -> None:
            nonlocal new
            if not new:
                self._close(number, closed=False)
                del self.stack[depth:]
                self.bare = None if self.bare is not None and self.bare >= depth else self.bare
                new = True

        while True:
            indent, lead = _indent(rest, column)
            body = rest[lead:]
            if not body:
                break
            # Only a paragraph of the innermost matched container can be interrupted.
            para = not new and self.leaf is not None and self.leaf.kind == "para"
            inside = para and depth == len(self.stack)
            if indent >= 4:
                if para:
                    break
                open_new()
                self._content()
                self.leaf = _Leaf("code", number)
                return
            if body[0] not in _STARTS:
                break
            if body[0] == ">":
                open_new()
                self._content()
                self.stack.append(None)
                rest, column = self._after_quote(body, column + indent)
                continue
            if (fence := _FENCE.match(body)) and not (body[0] == "`" and "`" in fence[2]):
                open_new()
                self._content()
                self.leaf = _Leaf("fence", number, mark=fence[1], indent=indent, info=fence[2])
                return
            if heading := _ATX.match(body):
                open_new()
                self._content()
                self._put("heading", number, level=len(heading[1]), text=_ATX_END.sub("", (heading[2] or "").strip()).strip())
                return
            if body[0] == "<":
                end = next(((end,) for start, end, ends in _HTML if start.match(body) and (ends or not para)), None)
                if end is None:
                    break
                open_new()
                self._content()
                self.leaf = _Leaf("html", number, end=end[0])
                if end[0] is not None and end[0].search(body):
                    self.leaf = None
                return
            if inside and (line := _SETEXT.match(body)) and self._paragraph() is not None:
                start, text = self._paragraph()
                self.leaf = None
                self._put("heading", start, level=1 if line[1][0] == "=" else 2, text=text)
                return
            if _RULE.match(body):
                open_new()
                self._content()
                return
            item = _ITEM.match(body)
            if not item:
                break
            tail, at = body[item.end():], column + indent + item.end()
            gap, gap_lead = _indent(tail, at)
            empty = gap_lead == len(tail)
            if inside and (empty or item[2] is not None and int(item[2]) != 1):
                break
            open_new()
            self._content()
            width = 1 if empty or gap > 4 else gap
            rest, column = _take(tail, at, width)
            self.stack.append(indent + item.end() + width)
            if empty:
                self.bare = len(self.stack) - 1
                return
        if not body:
            self._blank(number, depth, new)
        elif not new and self.leaf is not None and self.leaf.kind == "para":
            self.leaf.lines.append(rest)  # with unmatched containers it goes on lazily
        else:
            open_new()
            self._content()
            self.leaf = _Leaf("para", number)
            self.leaf.lines.append(rest)

    def _blank(self, number: int, depth: int, new: bool) -> None:
        if not new:
            self._close(number, closed=False)
            del self.stack[depth:]
            if self.bare is not None and self.bare >= depth:
                self.bare = None

    def _content(self) -> None:
        """The innermost item has content now, so blank lines no longer end it."""
        self.bare = None

    # --- closed blocks ------------------------------------------------------------------------
    def _paragraph(self) -> tuple[int, str] | None:
        """First line and text of the open paragraph without the link definitions in front."""
        text, line = "\n".join(self.leaf.lines), self.leaf.line
        while found := _DEFINITION.match(text):
            line += found[0].count("\n")
            text = text[found.end():]
        text = text.strip()
        return (line, text) if text else None

    def _close(self, number: int, *, closed: bool) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        if leaf.kind == "para":
            self.leaf = leaf
            kept = self._paragraph()
            self.leaf = None
            if kept:
                self._put("para", kept[0], text=kept[1])
        elif leaf.kind == "fence":
            info = leaf.info.split()
            self._put("fence", leaf.line, label=info[0].lower() if info else None,
                      body="".join(line + "\n" for line in leaf.lines), line_end=number, closed=closed)

    def _put(self, kind: str, line: int, **values) -> None:
        self.found.append({"line": line, "ord": 1, "kind": kind, **values})


def _plain(text: str) -> str:
    """Line ends as ``\\n``, without the last one."""
    return text.replace("\r\n", "\n").removesuffix("\n")


BLOCKS_ARROW = pa.list_(pa.struct([
    ("line", pa.int32()), ("ord", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()),
    ("label", pa.string()), ("body", pa.string()), ("line_end", pa.int32()), ("closed", pa.bool_()),
    ("turn", pa.int64()), ("role", pa.string())]))


def _texts(column: pa.Array) -> Iterator[str | None]:
    for value in column:
        text = value.as_py()
        yield None if text is None else _plain(text)


def blocks_of(column: pa.Array) -> pa.Array:
    """Fences, headings and paragraphs of each text; null stays null.

    The blocks of a few texts at a time are Python objects, which take many times what their column takes.
    """
    parts = [pa.array([None if t is None else Cutter().read(t).blocks() for t in _texts(column.slice(at, TEXTS))], BLOCKS_ARROW)
             for at in range(0, len(column), TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], BLOCKS_ARROW)


def open_ends_of(column: pa.Array) -> pa.Array:
    return pa.array([None if t is None else Cutter().read(t).open_at_end() for t in _texts(column)], pa.bool_())
