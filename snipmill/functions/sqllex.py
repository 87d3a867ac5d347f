"""Lexical profile of SQL text as one column: no parse, no database.

Text is cut into small tokens and folded once, left to right. The fold knows
five states: normal, quoted, dollar quoted, block comment and line comment.
Which quotes exist depends on the dialect family.

Known gap: inside ``$tag$`` text, a ``$other$`` directly followed by ``$``
hides a closing ``$$`` that starts on its last character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# GO lines, dollar tags, words, blanks, then any single character.
TOKENS = (
    r"(?im)(?d)^[ \t]*GO(?:[ \t]+[0-9]+)?[ \t]*(?=--|\n|\z)"
    r"|\$(?:[A-Za-z_][A-Za-z0-9_]*)?\$|[\p{IsAlphabetic}\p{IsDigit}_]+|[ \t\r]+|[\s\S]"
)

_FIELDS = {
    "mode": "'normal'", "close": "''", "back": "false", "depth": "0", "skip": "false", "line": "1",
    "start": "0", "what": "''", "statements": "0", "pending": "0",
    "opens": "cast(array() as array<int>)", "error": "''",
}
_SINGLE, _DOUBLE, _TICK, _BACK = "chr(39)", "chr(34)", "chr(96)", "chr(92)"


def _state(**changes: str) -> str:
    values = {name: f"a.{name}" for name in _FIELDS} | changes
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in values.items()) + ")"


def _content(**changes: str) -> str:
    """A token that belongs to a statement starts one when none is pending."""
    return _state(pending="if(a.pending = 0, a.line, a.pending)", **changes)


def _open(close: str, what: str, back: str = "false") -> str:
    return _content(mode="'quoted'", close=close, back=back, start="a.line", what=f"'{what}'")


def _step(family: str) -> str:
    nested = f"{family} IN ('postgres', 'tsql')"
    ident = r"rlike '[\\p{IsAlphabetic}\\p{IsDigit}_$]$'"
    e_string = (
        f"({family} = 'postgres' AND t.prev IN ('e', 'E') AND NOT coalesce(t.prev2 {ident}, false))"
    )
    end_statement = _state(
        statements="a.statements + if(a.pending > 0, 1, 0)", pending="0",
    )
    rules = [
        ("a.error <> ''", _state()),
        ("a.skip", _state(skip="false", line="a.line + if(t.tok = '\\n', 1, 0)")),
        # inside something
        ("t.tok = '\\n' AND a.mode = 'line'", _state(mode="'normal'", line="a.line + 1")),
        ("t.tok = '\\n'", _state(line="a.line + 1")),
        ("a.mode = 'line'", _state()),
        (f"a.mode = 'quoted' AND a.back AND t.tok = {_BACK}", _state(skip="true")),
        ("a.mode = 'quoted' AND t.tok = a.close AND t.next = a.close", _state(skip="true")),
        ("a.mode = 'quoted' AND t.tok = a.close", _state(mode="'normal'")),
        ("a.mode = 'quoted'", _state()),
        ("a.mode = 'dollar' AND t.tok = a.close", _state(mode="'normal'")),
        ("a.mode = 'dollar'", _state()),
        ("a.mode = 'block' AND t.tok = '*' AND t.next = '/'", _state(
            skip="true", depth="a.depth - 1", mode="if(a.depth = 1, 'normal', 'block')")),
        (f"a.mode = 'block' AND t.tok = '/' AND t.next = '*' AND {nested}",
         _state(skip="true", depth="a.depth + 1")),
        ("a.mode = 'block'", _state()),
        # normal text
        (f"{family} = 'tsql' AND t.tok rlike '(?i)^[ \\\\t]*GO(?:[ \\\\t]+[0-9]+)?[ \\\\t]*$' "
         "AND (t.prev IS NULL OR t.prev = '\\n') AND (t.next IS NULL OR t.next IN ('\\n', '-'))",
         end_statement),
        ("t.tok rlike '^[ \\\\t\\\\r]+$'", _state()),
        (f"(t.tok = '-' AND t.next = '-') OR (t.tok = '#' AND {family} = 'mysql')",
         _state(mode="'line'")),
        ("t.tok = '/' AND t.next = '*'", _state(
            mode="'block'", depth="1", skip="true", start="a.line", what="'block comment'")),
        (f"t.tok = {_SINGLE}", _open(_SINGLE, "string literal", f"({family} = 'mysql' OR {e_string})")),
        (f"t.tok = {_DOUBLE} AND {family} = 'mysql'", _open(_DOUBLE, "string literal", "true")),
        (f"t.tok = {_DOUBLE}", _open(_DOUBLE, "quoted identifier")),
        (f"t.tok = {_TICK} AND {family} IN ('mysql', 'sqlite')", _open(_TICK, "quoted identifier")),
        (f"t.tok = '[' AND {family} IN ('tsql', 'sqlite')", _open("']'", "bracketed identifier")),
        (f"{family} = 'postgres' AND t.tok rlike '^[$].*[$]$' AND length(t.tok) > 1 "
         f"AND NOT coalesce(t.prev {ident}, false)",
         _content(mode="'dollar'", close="t.tok", start="a.line",
                  what="concat('dollar-quoted string ', t.tok)")),
        ("t.tok = '('", _content(opens="array_append(a.opens, a.line)")),
        ("t.tok = ')' AND size(a.opens) = 0",
         _state(error="concat('unbalanced \\')\\' on line ', a.line)")),
        ("t.tok = ')'", _state(opens="slice(a.opens, 1, size(a.opens) - 1)")),
        ("t.tok = ';'", end_statement),
    ]
    chain = " ".join(f"WHEN {condition} THEN {state}" for condition, state in rules)
    return f"CASE {chain} ELSE {_content()} END"


def sql_scan(text: str, family: str) -> Column:
    """struct(statements, trailing, open_line, error) of SQL text in a column.

    Both arguments are column names. ``family`` is postgres, mysql, sqlite,
    tsql or NULL for the common rules. ``trailing`` is the line where an
    unterminated last statement starts.
    """
    start = "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in _FIELDS.items()) + ")"
    pattern = TOKENS.replace("\\", "\\\\")
    return F.expr(f"""
      transform(
        array(named_struct('toks', regexp_extract_all({text}, '{pattern}', 0),
                           'family', coalesce({family}, ''))),
        x -> aggregate(
          transform(x.toks, (t, i) -> named_struct('tok', t, 'next', get(x.toks, i + 1),
            'prev', get(x.toks, i - 1), 'prev2', get(x.toks, i - 2))),
          {start}, (a, t) -> {_step("x.family")},
          a -> named_struct('statements', a.statements, 'trailing', nullif(a.pending, 0),
            'open_line', get(a.opens, size(a.opens) - 1),
            'error', CASE WHEN a.error <> '' THEN a.error
              WHEN a.mode IN ('quoted', 'dollar', 'block')
                THEN concat(a.what, ' opened on line ', a.start, ' is never closed') END)))[0]
    """)
