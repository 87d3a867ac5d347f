"""Checks over artifact texts."""

from __future__ import annotations

import pytest

from snipmill.operators import verify as V
from snipmill.plans.compile import verify_corpus


def head(dialect):
    return f"-- name: x\n-- dialect:     {dialect}\n\n"


SQL = [
    (head("unspecified") + "SELECT 1;", "passed", 1),
    (head("unspecified") + "SELECT 'it''s; -- x' /* ; ' */ FROM (a);\n", "passed", 1),
    (head("postgresql") + "DO $f$ begin ' ; end $f$; /* a /* b */ c */ SELECT E'\\'' ;", "passed", 2),
    (head("postgresql") + "SELECT nameE'\\';", "passed", 1),
    (head("ansi") + "/* a /* b */ c */ SELECT 1;", "passed", 1),
    (head("mysql") + "SELECT 'a\\'b' # c ' \n, \"x\\\"\";", "passed", 1),
    (head("tsql") + "SELECT [a]]b;(]\nGO\nSELECT 2\n  go 5 -- x", "passed", 2),
    (head("tsql") + "SELECT 'x\nGO\n'", "failed", 0),
    (head("ansi") + "SELECT 1\nGO", "failed", 0),
    (head("sqlite") + "SELECT `a'`, [b'] FROM t;", "passed", 1),
    (head("ansi") + "SELECT `a'`;", "failed", 0),
    (head("ansi") + "SELECT (1;", "failed", 1),
    (head("ansi") + "SELECT 1);", "failed", 0),
    ("-- name: x\n", "failed", 0),
    (head("ansi") + ";;", "failed", 0),
    (head("tsql") + "/* a /* b */ SELECT 1;", "failed", 0),
]


def test_sql_lexical(spark):
    frame = spark.createDataFrame([(str(i), s[0]) for i, s in enumerate(SQL)], "ref string, text string")
    got = {int(r["ref"]): (r["status"], r["statements"]) for r in V.sql_lexical_profile(frame).collect()}
    assert got == {i: s[1:] for i, s in enumerate(SQL)}


def test_sql_messages(spark):
    frame = spark.createDataFrame([("a", SQL[11][0]), ("b", SQL[12][0]), ("c", SQL[15][0]), ("d", head("mysql") + "SELECT 1")],
                                  "ref string, text string")
    said = {r["ref"]: r["detail"] for r in V.sql_lexical_profile(frame).collect()}
    assert said["a"].startswith("'(' opened on line 4 is never closed (dialect ansi")
    assert said["b"].startswith("unbalanced ')' on line 4")
    assert said["c"] == "block comment opened on line 4 is never closed"
    assert said["d"] == "the last statement (from line 4) does not end with ';'"


def front(kind, **changes):
    rows = {k: '"v"' for k in ("kind", "name", "source", "compiled", "description", "review", "verify-with")}
    rows |= {"kind": f'"{kind}"', "risk-flags": "[]"}
    if kind == "prompt":
        rows["placeholders"] = '["x"]'
    rows |= changes
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in rows.items() if v is not None) + "---\n"


@pytest.mark.parametrize("matter, status, part", [
    (front("prompt"), "passed", ""), (front("prompt").replace("---\n", "---\n\n# note\n", 1), "passed", ""),
    ("no\n", "failed", "no front matter"), ("---\nkind: \"prompt\"\n", "failed", "never closed"),
    (front("prompt", name=None), "failed", "missing keys: name"), (front("prompt", name="[]"), "failed", "'name' must be a string"),
    (front("prompt", **{"risk-flags": "[null]"}), "failed", "must be a list of strings"),
    (front("prompt", **{"risk-flags": '["a", 1]'}), "failed", "must be a list of strings"),
    (front("prompt", extra="foo"), "failed", "line 11: value is not"), (front("runbook"), "failed", "kind is"),
    (front("prompt") .replace('name: "v"\n', 'name: "v"\nname: "w"\n'), "failed", "line 4: key 'name' appears more than once"),
])
def test_front_matter(spark, matter, status, part):
    frame = spark.createDataFrame([("prompts/a.md", matter + "body\n")], "ref string, text string")
    row = V.lint_front_matter(frame, "prompt").first()
    assert row["status"] == status and part in row["detail"], row


def test_prompt_and_runbook_checks(spark):
    texts = {
        "prompts/ok.md": front("prompt") + "\nUse {x} but not ${y}, {z-1}, {z}} or {0}.\n",
        "prompts/blank.md": front("prompt") + " \n\n",
        "prompts/odd.md": front("prompt") + "{{ a.b }} [insert name]\nFIXME todo\n",
        "runbooks/ok.md": front("runbook") + "\n\nTitle\n---\n\n```sh\nx\n```\n",
        "runbooks/list.md": front("runbook") + "- item\n\n~~~\nx\n~~~\n",
    }
    frame = spark.createDataFrame(list(texts.items()), "ref string, text string")
    body = {r["ref"]: r["status"] for r in V.lint_prompt_body(frame).collect()}
    assert body["prompts/blank.md"] == "failed" and body["prompts/ok.md"] == "passed"
    named = {r["ref"]: r["detail"] for r in V.lint_placeholders(frame).collect()}
    assert named["prompts/ok.md"] == ""
    assert named["prompts/odd.md"] == (
        "undeclared placeholders: a.b; declared but unused placeholders: x; "
        "editorial fill-ins remain: '[insert name]' (line 12), 'FIXME' (line 13)")
    titles = {r["ref"]: r["detail"] for r in V.lint_runbook_title(frame).collect()}
    assert titles["runbooks/ok.md"] == ""
    assert titles["runbooks/list.md"] == "the first block of the body (line 11) is a bullet_list, not a heading"
    bare = {r["ref"]: r["detail"] for r in V.lint_unlabeled_fences(frame).collect()}
    assert bare["runbooks/list.md"].endswith("at lines 13") and bare["runbooks/ok.md"] == ""


def test_headers(spark):
    frame = spark.createDataFrame([
        ("scripts/a.sql", head("tsql") + "-- dialect: x\n"), ("scripts/b.sql", "SELECT 1\n-- dialect: tsql\n"),
        ("scripts/c.sh", "#!/bin/sh\n# name: c\n# risk-flags: sudo, disk \nx\n"), ("scripts/d.sh", "x\n# risk-flags: sudo\n"),
        ("runbooks/e.md", front("runbook", **{"risk-flags": '["sudo"]'})), ("prompts/f.txt", "x"),
    ], "ref string, text string")
    got = {r["ref"]: (r["emitter"], r["dialect"], r["flags"]) for r in V.header_fields(frame).collect()}
    assert got == {
        "scripts/a.sql": ("sql", "tsql", []), "scripts/b.sql": ("sql", None, []),
        "scripts/c.sh": ("bash", None, ["sudo", "disk"]), "scripts/d.sh": ("bash", None, []),
        "runbooks/e.md": ("runbook", None, ["sudo"]), "prompts/f.txt": (None, None, []),
    }


def test_verdicts_of_a_corpus(spark):
    files = spark.createDataFrame([
        ("prompts/ok.md", front("prompt") + "{x}\n", "draft", "g"), ("scripts/a.sh", "#!/bin/sh\nx\n", "draft", "g"),
        ("scripts/b.ps1", "Get-Date\n", "approved", "g"), ("scripts/c.sql", head("ansi") + "SELECT 1", "draft", "g"),
    ], "ref string, text string, state string, compiled string")
    linters = spark.createDataFrame([
        ("scripts/a.sh", "bash-syntax", "passed", ""), ("scripts/a.sh", "shellcheck", "passed", ""),
        ("scripts/c.sql", "sqlfluff-parse", "failed", "advisory"),
    ], "ref string, check_name string, status string, detail string")
    got = {r["ref"]: (r["verdict"], r["reasons"]) for r in verify_corpus(files, "now", linters).collect()}
    assert got["prompts/ok.md"][0] == "passed" and got["scripts/a.sh"] == ("passed", ["all 2 required check(s) passed"])
    assert got["scripts/b.ps1"][0] == "inconclusive" and len(got["scripts/b.ps1"][1]) == 2
    assert got["scripts/c.sql"] == ("failed", ["required check sql-lexical failed"])
