"""Column builders for text: slugs, normal forms, first sentences, regex matches."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import wraps
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from snipmill import fixed

# Whitespace as str.strip() and str.split() see it.
SPACE = r"[\s\x1c-\x1f]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


_BUILT: dict[tuple, Any] = {}


def built_once(build: Callable) -> Callable:
    """Keep the Columns a builder returns for the life of the session.

    A Column is a tree of JVM objects and a large one takes thousands of calls
    to build. Builders marked with this name their input columns and take only
    hashable arguments, so the tree can be used again in any frame.
    """
    @wraps(build)
    def builder(*args):
        key = (build, args, id(SparkContext._active_spark_context))
        if key not in _BUILT:
            _BUILT[key] = build(*args)
        return _BUILT[key]

    return builder


def table(rows: Iterable) -> tuple:
    """A pattern table as a hashable value."""
    return tuple(tuple(row) for row in rows)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A lambda variable is bound per row, so a long chain of rewrites does not
    multiply its own expression tree.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def strip_newlines(text: Column) -> Column:
    return F.btrim(text, F.lit("\n"))


def one_line(text: Column) -> Column:
    """All whitespace runs become one space, none at the ends."""
    return strip(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def unix_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def rstrip_lines(text: Column) -> Column:
    """Trim each line from its end, without a regex at every blank of the text."""
    return F.array_join(F.transform(F.split(text, "\n", -1), rstrip), "\n")


def slug(text: Column, max_len: int = fixed.ARTIFACT_SLUG_MAX) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.regexp_replace(F.substring(trimmed, 1, max_len), "-+$", "")


def normalize(body: Column) -> Column:
    """Normal form that is hashed: LF ends, no trailing blanks, one final newline."""
    return F.concat(
        F.rtrim(rstrip_lines(unix_newlines(body)), F.lit("\n")), F.lit("\n")
    )


def content_hash(body: Column) -> Column:
    return F.sha2(normalize(body), 256)


def artifact_body(body: Column, *, strip_shebang: bool = False) -> Column:
    """Body of a draft: normal lines, no blank lines at either end."""
    text = unix_newlines(body)
    if strip_shebang:
        text = F.regexp_replace(text, r"\A#![^\n]*\n?", "")
    return F.concat(
        strip_newlines(rstrip_lines(text)), F.lit("\n")
    )


def first_sentence(text: Column, limit: int = fixed.SENTENCE_MAX) -> Column:
    sentence = F.split(one_line(text), rf"(?U)(?<=[.!?]){SPACE}+", 2)[0]
    return rstrip(F.substring(sentence, 1, limit))


def strip_lead_in(text: Column) -> Column:
    rest = strip(F.regexp_replace(text, fixed.LEAD_IN, ""))
    rest = strip(F.regexp_replace(rest, r":+\z", ""))
    return let(rest, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 2**30)))


def newlines(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\n]+", ""))


def lookup(mapping: dict[str, str | None], key: Column, default: Column | None = None) -> Column:
    """A small fixed map as one CASE chain."""
    chain = None
    for value, result in mapping.items():
        chain = (F if chain is None else chain).when(key == value, F.lit(result))
    return chain.otherwise(F.lit(None).cast("string") if default is None else default)


def first_of(rules: Iterable[tuple[Column, str]]) -> Column:
    """Name of the first rule that holds, in order; NULL when none does."""
    chain = None
    for condition, name in rules:
        chain = (F if chain is None else chain).when(condition, F.lit(name))
    return chain


def rewrite(text: Column, pattern: str, replace: Callable[..., Column], groups: list[int],
            matches: Column | None = None) -> Column:
    """Replace every match by ``replace(group, ...)``, a Column of its groups.

    ``split`` gives the text between the matches and ``regexp_extract_all``
    the matches, so zipping both rebuilds the text in one linear pass.
    """
    rx = F.lit(pattern)
    between = F.split(text, pattern, -1)
    parts = F.arrays_zip(
        *[F.regexp_extract_all(text, rx, F.lit(g)).alias(f"g{g}") for g in groups]
    )
    filled = F.transform(parts, lambda m: replace(*[m[f"g{g}"] for g in groups]))
    joined = F.array_join(
        F.zip_with(between, filled, lambda b, r: F.concat(b, F.coalesce(r, F.lit("")))), ""
    )
    return F.when(text.rlike(pattern) if matches is None else matches, joined).otherwise(text)


def line_of_match(text: Column, pattern: str, index: Column | int) -> Column:
    """1-based line on which match number ``index`` (from 0) starts."""
    index = F.lit(index) if isinstance(index, int) else index
    between = F.slice(F.split(text, pattern, -1), F.lit(1), index + 1)
    before = F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(1), index)
    return (
        F.aggregate(F.concat(between, before), F.lit(1), lambda n, s: n + newlines(s))
    ).cast("int")


def json_string(text: Column) -> Column:
    """A JSON string literal that keeps non-ASCII characters."""
    return F.regexp_replace(F.to_json(F.array(text)), r"\A\[|\]\z", "")


def ascii_json(document: Column) -> Column:
    """The same JSON with every non-ASCII UTF-16 unit as a lower-case \\uXXXX escape."""
    # Rewrite run by run, so the ASCII text between the runs is kept as it is.
    return F.when(
        document.rlike(r"[^\x00-\x7f]"),
        rewrite(
            document, r"[^\x00-\x7f]+",
            lambda run: F.regexp_replace(
                F.lower(F.hex(F.encode(run, "UTF-16BE"))), "([0-9a-f]{4})", r"\\u$1"
            ),
            [0],
        ),
    ).otherwise(document)
