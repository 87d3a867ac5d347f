"""Column builders that find and redact secrets with an ordered pattern table.

A pattern table is a short list of ``(label, regex)`` rows. Rows are bound as
literals, so the scan is one narrow projection with no join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import text as T

Patterns = list[tuple[str, str]]

HIT_TYPE = "struct<label:string,line:int>"


def is_literal_value(value: Column) -> Column:
    """True when the right side of key=value looks like a literal credential."""
    bare = F.regexp_replace(T.strip(value), r'\A"+|"+\z', "")
    bare = F.regexp_replace(bare, r"\A'+|'+\z", "")

    def judge(v: Column) -> Column:
        verdict = v.rlike(fixed.KV_LITERAL)
        for prefix in fixed.KV_REFERENCE_PREFIXES:
            verdict = verdict & ~v.startswith(prefix)
        for hint in fixed.KV_PLACEHOLDER_HINTS:
            verdict = verdict & ~F.lower(v).contains(hint)
        return verdict

    return T.let(bare, judge)


def literal_flags(text: Column, pattern: str) -> Column:
    """For each key=value match, whether its value is a literal secret."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(3)), is_literal_value)


def _matches(text: Column, label: str, pattern: str) -> Column:
    """``rlike`` behind the cheap substring test, for the built-in patterns."""
    match = text.rlike(pattern)
    if (label, pattern) not in fixed.SECRET_PATTERNS:
        return match
    hinted = F.lit(False)
    for hint in fixed.SECRET_HINTS[label]:
        hinted = hinted | text.contains(hint)
    return hinted & match


def find_secret(text: Column, patterns: Patterns | None = None) -> Column:
    """First hit in pattern order, then match order: struct(label, line) or NULL."""
    chain = None
    for label, pattern in patterns or fixed.SECRET_PATTERNS:
        if label == fixed.KV_LABEL:
            flags = literal_flags(text, pattern)
            hit = _matches(text, label, pattern) & F.array_contains(flags, True)
            index = (F.array_position(flags, True) - 1).cast("int")
        else:
            hit, index = _matches(text, label, pattern), F.lit(0)
        found = F.struct(
            F.lit(label).alias("label"), T.line_of_match(text, pattern, index).alias("line")
        )
        chain = (F if chain is None else chain).when(hit, found)
    return chain


def has_secret(text: Column, patterns: Patterns | None = None) -> Column:
    """Whether any pattern hits; the same rule as ``find_secret`` without the line."""
    hit = F.lit(False)
    for label, pattern in patterns or fixed.SECRET_PATTERNS:
        match = _matches(text, label, pattern)
        if label == fixed.KV_LABEL:
            match = match & F.exists(
                F.regexp_extract_all(text, F.lit(pattern), F.lit(3)), is_literal_value
            )
        hit = hit | match
    return hit


def _tail(label: str, secret: Column) -> Column:
    last4 = T.let(
        T.strip(secret),
        lambda s: F.when(F.length(s) >= 4, F.substring(s, -4, 4)).otherwise(
            F.lit(fixed.REDACTED_SHORT)
        ),
    )
    return F.concat(F.lit(f"[REDACTED:{label}:"), last4, F.lit("]"))


def _redact_step(label: str, pattern: str) -> Callable[[Column], Column]:
    if label == fixed.KV_LABEL:
        return lambda t: T.rewrite(
            t, pattern, lambda key, sep, value: F.concat(key, sep, _tail(label, value)), [1, 2, 3],
            _matches(t, label, pattern),
        )
    return lambda t: T.rewrite(
        t, pattern, lambda match: _tail(label, match), [0], _matches(t, label, pattern)
    )


def redact(text: Column, patterns: Patterns | None = None) -> Column:
    """Replace every hit, one pattern after the other; key=value keeps its key."""
    for label, pattern in patterns or fixed.SECRET_PATTERNS:
        text = T.let(text, _redact_step(label, pattern))
    return text
