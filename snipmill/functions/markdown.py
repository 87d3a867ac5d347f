"""Markdown blocks of a text as one array column.

Lines are numbered first (``12\\x01line``). One alternation regex then cuts the
numbered text into blocks that cover it without gaps, so each block carries its
own line number and no running count is needed. Loops over lines are
possessive, which keeps the JVM regex engine from recursing per line.

This cuts fences with backticks or tildes, ATX and setext headings, paragraphs,
thematic breaks, HTML comments and indented code. Texts with a sign of quotes, lists,
other HTML or link definitions go through the automaton of ``containers`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import containers as C
from snipmill.functions import text as T

_NO = r"[0-9]++\x01"  # the number of a line
_END = r"(?:\n|\z)"
_RULE = (
    r" {0,3}(?:(?:\*[ \t]*+){3,}+|(?:-[ \t]*+){3,}+|(?:_[ \t]*+){3,}+)" + _END
)
_TICKS_OPEN = r" {0,3}`{3,}+[^`\n]*+" + _END
_UNDERLINE = r" {0,3}(?:=++|-++)[ \t]*+" + _END
# What ends a paragraph on the next line.
_BREAK = (
    r"(?:[ \t]*+" + _END + r"|" + _TICKS_OPEN + r"| {0,3}~{3,}| {0,3}#{1,6}(?:[ \t\n]|\z)"
    r"| {0,3}<!--| {0,3}>| {0,3}[-+*][ \t]++[^ \t\n]| {0,3}1[.)][ \t]++[^ \t\n]"
    r"|" + _UNDERLINE + r"|" + _RULE + r")"
)


def _fence(mark: str, info: str, group: int, end: str = r"|\z") -> str:
    return (
        rf"{_NO} {{0,3}}({mark}{{3,}}+){info}{_END}[\s\S]*?"
        rf"(?:(?<=\n){_NO} {{0,3}}\{group}{mark}*+[ \t]*+{_END}{end})"
    )


# One alternative per kind of block; the last one takes any other line.
BLOCKS = "|".join([
    _fence("`", r"[^`\n]*+", 1),
    _fence("~", r"[^\n]*+", 2),
    rf"{_NO} {{0,3}}<!--[\s\S]*?(?:-->[^\n]*+{_END}|\z)",
    rf"{_NO} {{0,3}}#{{1,6}}(?:[ \t][^\n]*+)?+{_END}",
    rf"{_NO}{_RULE}",
    rf"{_NO}[ \t]*+{_END}",
    rf"{_NO}(?: {{4}}| {{0,3}}\t)[^\n]*+{_END}",
    rf"{_NO}[^\n]*+{_END}(?:{_NO}(?!{_BREAK})[^\n]++{_END})*+(?:{_NO}{_UNDERLINE})?+",
])

_CLOSED_TOKEN = "|".join([
    rf"\A{_fence('`', '[^`\n]*+', 1, '')}\z", rf"\A{_fence('~', '[^\n]*+', 2, '')}\z",
])
_TICK_TOKEN = rf"\A{_NO} {{0,3}}(?:`{{3,}}+[^`\n]*+{_END}|~{{3,}})"
_ATX_TOKEN = rf"\A{_NO} {{0,3}}#{{1,6}}(?:[ \t\n]|\z)"
_OTHER_TOKEN = (
    rf"\A{_NO}(?: {{0,3}}<!--|{_RULE}\z|[ \t]*+{_END}\z|(?: {{4}}| {{0,3}}\t)[^\n]*+{_END}\z)"
)
BLOCK_TYPE = (
    "struct<line:int,ord:int,kind:string,level:int,text:string,label:string,"
    "body:string,line_end:int,closed:boolean,turn:bigint,role:string>"
)


_FIRST_KINDS = [
    ("fence", r"\A {0,3}(?:`{3,}+[^`\n]*+(?:\n|\z)|~{3,})"),
    ("heading", r"\A {0,3}#{1,6}(?:[ \t\n]|\z)"),
    ("html_block", r"\A {0,3}<(?:[!?/]|[A-Za-z])"),
    ("hr", r"\A" + _RULE),
    ("code_block", r"\A(?: {4}| {0,3}\t)"),
    ("blockquote", r"\A {0,3}>"),
    ("bullet_list", r"\A {0,3}[-+*](?:[ \t\n]|\z)"),
    ("ordered_list", r"\A {0,3}[0-9]{1,9}[.)](?:[ \t\n]|\z)"),
    ("heading", r"\A[^\n]++\n(?:(?!" + _BREAK + r")[^\n]++\n)*+" + _UNDERLINE),
]


def first_block(text: Column) -> Column:
    """struct(line, kind) of the first block that is not blank; NULL kind when none."""
    lead = F.regexp_extract(T.unix_newlines(text), r"\A(?:[ \t]*+\n)*+", 0)
    rest = F.substring(T.unix_newlines(text), F.length(lead) + 1, F.length(text))

    def name(block: Column) -> Column:
        chain = F.when(T.is_blank(block), F.lit(None).cast("string"))
        for kind, pattern in _FIRST_KINDS:
            chain = chain.when(block.rlike(pattern), F.lit(kind))
        return chain.otherwise("paragraph")

    return F.struct(T.newlines(lead).alias("line"), T.let(rest, name).alias("kind"))


def may_hold_fence(text: Column) -> Column:
    return text.contains("```") | text.contains("~~~")


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(T.unix_newlines(text), r"\n\z", ""), "\n", -1)


def _unnumber(block: Column) -> Column:
    return F.regexp_replace(block, r"(?m)(?d)^[0-9]+\x01", "")


def _outdent(line: Column, most: int) -> Column:
    """The line without up to ``most`` columns of indent; what is left of a tab becomes spaces."""
    return F.regexp_replace(F.regexp_replace(line, rf"^ {{0,{most - 1}}}\t", " " * 4), rf"^ {{1,{most}}}", "")


def _inner(block: Column) -> Column:
    """The lines of a fence block between opener and closer, opener indent removed."""
    opener = F.regexp_extract(block, r"\A[0-9]+\x01( {0,3})((`|~)\3{2,})", 2)
    indent = F.length(F.regexp_extract(block, r"\A[0-9]+\x01( {0,3})", 1))
    lines = F.split(_unnumber(F.regexp_replace(block, r"\n\z", "")), "\n", -1)

    def build(parts: Column) -> Column:
        last = F.trim(F.element_at(parts["lines"], -1))
        closed = (
            (F.size(parts["lines"]) > 1)
            & F.element_at(parts["lines"], -1).rlike(r"^ {0,3}(?:`{3,}|~{3,})[ \t]*\z")
            & last.startswith(parts["mark"])
            & (F.replace(F.rtrim(last), F.substring(last, 1, 1), F.lit("")) == "")
        )
        keep = F.size(parts["lines"]) - 1 - closed.cast("int")
        body = F.transform(
            F.slice(parts["lines"], F.lit(2), F.greatest(keep, F.lit(0))),
            lambda l: F.when(parts["indent"] == 0, l)
            .when(parts["indent"] == 1, _outdent(l, 1))
            .when(parts["indent"] == 2, _outdent(l, 2))
            .otherwise(_outdent(l, 3)),
        )
        return F.struct(
            F.concat(F.array_join(body, "\n"), F.when(keep > 0, F.lit("\n")).otherwise("")).alias("body"),
            F.size(parts["lines"]).alias("n"),
            closed.alias("closed"),
            F.regexp_extract(
                F.regexp_extract(parts["lines"][0], r"^ {0,3}(?:`+|~+)(.*)\z", 1),
                rf"(?U)\A{T.SPACE}*([^\s\x1c-\x1f]*)", 1,
            ).alias("info"),
        )

    return T.let(
        F.struct(lines.alias("lines"), opener.alias("mark"), indent.alias("indent")), build
    )


def _block(line: Column, kind: str, *, level: Column | None = None, text: Column | None = None,
           label: Column | None = None, body: Column | None = None,
           line_end: Column | None = None, closed: Column | None = None,
           turn: Column | None = None, role: Column | None = None, order: int = 1) -> Column:
    def or_null(value: Column | None, dtype: str) -> Column:
        return (F.lit(None) if value is None else value).cast(dtype)

    return F.struct(
        line.cast("int").alias("line"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"),
        or_null(level, "int").alias("level"), or_null(text, "string").alias("text"),
        or_null(label, "string").alias("label"), or_null(body, "string").alias("body"),
        or_null(line_end, "int").alias("line_end"), or_null(closed, "boolean").alias("closed"),
        or_null(turn, "bigint").alias("turn"), or_null(role, "string").alias("role"),
    )


def _classify(block: Column) -> Column:
    line = F.regexp_extract(block, r"\A([0-9]+)\x01", 1)
    atx = T.strip(
        F.regexp_replace(
            F.regexp_replace(T.strip(_unnumber(block)), r"\A#{1,6}", ""),
            r"(?:[ \t]+#+|\A#+)[ \t]*\z", "",
        )
    )
    level = F.length(F.regexp_extract(block, r"\A[0-9]+\x01 {0,3}(#{1,6})", 1))
    setext = T.strip(F.regexp_replace(_unnumber(block), r"\n? {0,3}(?:=+|-+)[ \t]*\n?\z", ""))
    setext_level = F.when(block.rlike(r"=[ \t]*\n?\z"), 1).otherwise(2)
    paragraph = T.strip(
        F.regexp_replace(
            _unnumber(block),
            r"(?m)(?d)^ {0,3}> ?|\A {0,3}(?:[-+*]|[0-9]{1,9}[.)])[ \t]+", "",
        )
    )
    fence = T.let(
        _inner(block),
        lambda f: _block(
            line, "fence", label=F.when(f["info"] != "", F.lower(f["info"])), body=f["body"],
            line_end=line.cast("int") + f["n"], closed=f["closed"],
        ),
    )
    return (
        F.when(block.rlike(_TICK_TOKEN), fence)
        .when(block.rlike(_ATX_TOKEN), _block(line, "heading", level=level, text=atx))
        .when(block.rlike(_OTHER_TOKEN), F.lit(None).cast(BLOCK_TYPE))
        .when(
            block.rlike(rf"\n{_NO}{_UNDERLINE}\z"),
            _block(line, "heading", level=setext_level, text=setext),
        )
        .otherwise(_block(line, "para", text=paragraph))
    )


def _plainly_closed(text: Column) -> Column:
    """A cheap sign that no fence stays open: ``` lines in pairs, each second one bare.

    Other runs, tildes or an HTML comment beyond one marker need the full test.
    """
    marks = F.regexp_extract_all(text, F.lit(r"(?m)(?d)^ {0,3}(?:`{3,}|~{3,})[^\n]*"), F.lit(0))

    def paired(found: Column) -> Column:
        fits = F.transform(found, lambda m, i: F.when(i % 2 == 1, m == "```").otherwise(
            m.rlike(r"^ {0,3}```[^`]*\z")))
        return ~F.array_contains(fits, False)

    one_comment = F.size(F.split(text, "<!--", 3)) <= 2
    return one_comment & T.let(marks, lambda found: (F.size(found) % 2 == 0) & paired(found))


@T.built_once
def _container_udfs() -> tuple:
    """Blocks of a text, and whether it ends open; both give null for null."""
    return F.arrow_udf(C.blocks_of, f"array<{BLOCK_TYPE}>"), F.arrow_udf(C.open_ends_of, "boolean")


def _nested(text: Column) -> Column:
    """The text if it needs the automaton, else null, which costs the automaton nothing."""
    return F.when(text.rlike(C.NEEDED), text)


def may_stay_open(text: Column) -> Column:
    """A cheap sign of a fence, or of HTML that goes on over blank lines."""
    return may_hold_fence(text) | text.rlike(r"(?i)<(?:script|pre|style|textarea|\?|![a-z\[])")


def ends_open(text: Column) -> Column:
    """Whether the text ends inside a fence, or HTML with an end of its own, that no container holds."""
    plain = F.when(_plainly_closed(text), F.lit(False)).otherwise(_last_block_open(text))
    return F.coalesce(_container_udfs()[1](_nested(text)), plain)


def _last_block_open(text: Column) -> Column:
    """The full test: cut the text into blocks; only the last one can be open."""
    plain = F.regexp_replace(T.unix_newlines(text), r"\n\z", "")
    # Without line numbers a blank block could be empty, so ask for one character.
    some = r"(?=[\s\S])(?:" + BLOCKS.replace(_NO, "") + ")"
    cut = F.regexp_extract_all(plain, F.lit(some), F.lit(0))
    return T.let(
        F.get(cut, F.size(cut) - 1),
        lambda last: last.rlike(_TICK_TOKEN.replace(_NO, ""))
        & ~last.rlike(_CLOSED_TOKEN.replace(_NO, "")),
    )


def blocks(text: Column) -> Column:
    """Fences, headings and paragraphs in line order, those in containers too; lines count from 0."""
    return F.coalesce(_container_udfs()[0](_nested(text)), flat_blocks(text))


def flat_blocks(text: Column) -> Column:
    """Blocks of a text without containers."""
    numbered = F.array_join(
        F.transform(_lines(text), lambda l, i: F.concat(i.cast("string"), F.lit("\x01"), l)), "\n"
    )
    cut = F.regexp_extract_all(numbered, F.lit(BLOCKS), F.lit(0))
    return F.filter(F.transform(cut, _classify), lambda b: b.isNotNull())


def markers(text: Column) -> Column:
    """Turn marker lines wherever they stand, as blocks of kind ``marker``."""
    hits = F.filter(
        F.transform(
            F.split(text, "\n", -1), lambda l, i: F.struct(i.alias("line"), l.alias("text"))
        ),
        lambda l: l["text"].contains("<!--") & l["text"].rlike(fixed.TURN_MARKER),
    )
    return F.transform(
        hits,
        lambda l: _block(
            l["line"], "marker", order=0,
            turn=F.regexp_extract(l["text"], fixed.TURN_MARKER, 1).cast("bigint"),
            role=F.lower(F.regexp_extract(l["text"], fixed.TURN_MARKER, 2)),
        ),
    )


def events(text: Column) -> Column:
    """Markers and blocks of a text in line order (marker first on a shared line)."""
    return F.array_sort(
        F.concat(F.when(text.contains("<!--"), markers(text)).otherwise(
            F.array().cast(f"array<{BLOCK_TYPE}>")), blocks(text))
    )
