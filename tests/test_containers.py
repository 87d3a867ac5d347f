"""Blocks in quotes, lists and HTML against what the format says about them."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snipmill.functions import containers as C
from snipmill.functions import markdown as M
from snipmill.operators import extract as X


def kinds(text):
    """(line, kind, what it holds) of the blocks of a text."""
    found = C.blocks_of(pa.array([text])).to_pylist()[0]
    return [(b["line"], b["kind"], b["body"] if b["kind"] == "fence" else b["text"]) for b in found]


@pytest.mark.parametrize(("text", "expected"), [
    ("> ```sh\n> a\n> ```\nb", [(0, "fence", "a\n"), (3, "para", "b")]),
    ("> ```sh\n> a\nb", [(0, "fence", "a\n"), (2, "para", "b")]),
    ("> ```\n\n> b", [(0, "fence", ""), (2, "para", "b")]),
    ("- a\n\n  ```sh\n  x\n    y\n\n  z\n  ```\n", [(0, "para", "a"), (2, "fence", "x\n  y\n\nz\n")]),
    ("10.   wide\n\n      ~~~\n      x\n      ~~~", [(0, "para", "wide"), (2, "fence", "x\n")]),
    ("- - > ```\n    > x\n    > ```\n", [(0, "fence", "x\n")]),
    ("- ```\n  x\n\n\ny", [(0, "fence", "x\n\n\n"), (4, "para", "y")]),
    ("1. a\n2. b\n3. c", [(0, "para", "a"), (1, "para", "b"), (2, "para", "c")]),
    ("text\n2. not a list", [(0, "para", "text\n2. not a list")]),
    ("text\n1. a list", [(0, "para", "text"), (1, "para", "a list")]),
    ("text\n-\nmore", [(0, "heading", "text"), (2, "para", "more")]),
    ("- a\n  2. b", [(0, "para", "a\n2. b")]),
    ("> a\nlazy\n> b", [(0, "para", "a\nlazy\nb")]),
    ("> a\n===\n", [(0, "para", "a\n===")]),
    ("> a\n---\nb", [(0, "para", "a"), (2, "para", "b")]),
    ("> # H\n> t\n> ===", [(0, "heading", "H"), (1, "heading", "t")]),
    ("- # H #\n- x\n  ---", [(0, "heading", "H"), (1, "heading", "x")]),
    ("-\n  a", [(1, "para", "a")]),
    ("-\n\n  a", [(2, "para", "a")]),
    ("-     code\n\n  a", [(2, "para", "a")]),
    ("* * *\n* a", [(1, "para", "a")]),
    ("-\ta\n\n\tb", [(0, "para", "a"), (2, "para", "b")]),
    (">\t```\n>\tx\n>\t```", [(0, "fence", "x\n")]),
    ("<div>\n```\nx\n```\n</div>\n\n```\ny\n```", [(6, "fence", "y\n")]),
    ("<pre>\n\n```\nx\n```\n</pre>\n```\ny\n```", [(6, "fence", "y\n")]),
    ("<script>\n# no\n\n</script>\n# yes", [(4, "heading", "yes")]),
    ("<b>\n# in html\n\nout", [(3, "para", "out")]),
    ("a\n<b>\nc", [(0, "para", "a\n<b>\nc")]),
    ("a\n<p>\n# c", [(0, "para", "a")]),
    ("<?x\n\n# no\n?>\n# yes", [(4, "heading", "yes")]),
    ("<![CDATA[\n# no\n]]>\n# yes", [(3, "heading", "yes")]),
    ("> <div>\n# yes", [(1, "heading", "yes")]),
    ("[a]: /x 'T'\n[b]:\n  <y z>\nrest", [(3, "para", "rest")]),
    ("[a]: /x\n", []),
    ("[a]: /x\n===\nz", [(1, "para", "===\nz")]),
    ("[a]: /x y z", [(0, "para", "[a]: /x y z")]),
    ("a\n[b]: /x", [(0, "para", "a\n[b]: /x")]),
    ("- a\n\n\n      code\n", [(0, "para", "a")]),
    ("1234567890. no", [(0, "para", "1234567890. no")]),
    ("", []),
    ("- ", []),
])
def test_format(text, expected):
    assert kinds(text) == expected


def test_lines_labels_and_closers():
    text = "> ````Sql x\n> a\n> ```\n> ````\n- ~~~\n  b"
    found = C.blocks_of(pa.array([text, None])).to_pylist()
    assert found[1] is None
    assert [(b["line"], b["line_end"], b["label"], b["closed"]) for b in found[0]] == [(0, 4, "sql", True), (4, 6, None, False)]


@pytest.mark.parametrize(("text", "expected"), [
    ("```\nx", True), ("> ```\n> x", False), ("- ```\n  x", False), ("<pre>\n\nx", True), ("<div>\nx", False),
    ("<?php\n", True), ("<pre>x</pre>", False), ("- a\n\n```\nb", True), ("a", False), ("", False),
])
def test_what_stays_open(spark, text, expected):
    row = spark.createDataFrame([(text,)], "text string").select(
        (M.may_stay_open(F.col("text")) & M.ends_open(F.col("text"))).alias("open")).first()
    assert row["open"] is expected


def test_automaton_and_regex_agree_without_containers(spark):
    random.seed(5)
    lines = ["# A", "text", "more text", "", "```sh", "```", "~~~", "~~~~ x", "---", "===", "    code", "\ttab", "<!-- c -->",
             "<!-- open", "-->", "## B ##", "   ```", "* * *", "x `y`", "#no", "  para"]
    texts = ["\n".join(random.choices(lines, k=random.randint(0, 14))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    flat = {r["i"]: [b.asDict() for b in r["b"]] for r in rows.select("i", M.flat_blocks(F.col("text")).alias("b")).collect()}
    for i, found in enumerate(C.blocks_of(pa.array(texts)).to_pylist()):
        assert found == flat[i], texts[i]


def test_long_nesting_and_long_texts():
    assert kinds(">" * 500 + " a") == [(0, "para", "a")]
    body = "x\n" * 200_000
    assert kinds("- ```\n" + "".join(f"  {line}\n" for line in body.splitlines()) + "  ```") == [(0, "fence", body)]


def test_fences_of_turns_end_with_their_container(spark):
    turns = spark.createDataFrame([
        (1, 1, "user", "> ```sh\n> quoted", None), (1, 2, "assistant", "```sh\nnext\n```", None),
        (2, 1, "user", "<pre>\nstays open", None), (2, 2, "assistant", "```sh\nhidden\n```\n</pre>\n```sh\nseen\n```", None),
    ], "doc_key long, idx int, role string, content_md string, ts string")
    rows = X.extract_fences(X.turn_segments(turns)).orderBy("doc_key", "fence_no").collect()
    assert [(r.doc_key, r.body, r.turn, r.closed) for r in rows] == [
        (1, "quoted\n", 1, False), (1, "next\n", 2, True), (2, "seen\n", 2, True)]


def test_nested_headings_and_paragraphs_are_context(spark):
    text = "> ## In a quote\n\n1. First step\n2. Second step.\n3. Third step\n\n```sh\nx\n```\n\n[l]: /u\n\n```sh\ny\n```\n"
    docs = spark.createDataFrame([(1, text)], "doc_key int, text string")
    rows = X.candidate_description(X.document_fences(docs)).orderBy("fence_no").collect()
    assert [r.description for r in rows] == ["Third step", "In a quote"]
    assert [r.heading_path for r in rows] == [["In a quote"]] * 2


def test_the_automaton_runs_once_for_a_text(spark):
    docs = spark.createDataFrame([(1, "> ```sh\n> a\n> ```"), (2, "```sh\nb\n```"), (3, "none")], "doc_key long, text string").repartition(2)
    found = X.document_fences(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("blocks_of(") == 1
    assert sorted((r.doc_key, r.body) for r in found.collect()) == [(1, "a\n"), (2, "b\n")]


def test_a_batch_is_cut_a_few_texts_at_a_time(monkeypatch):
    texts = ["> ```sh\n> a\n> ```\nb", None, "", "- a\n\n  ```sh\n  x\n  ```", None, "# T\n\np", "> q"]
    whole, read = C.blocks_of(pa.array(texts)), []
    monkeypatch.setattr(C, "TEXTS", 3)
    monkeypatch.setattr(C, "_texts", lambda part, of=C._texts: read.append(len(part)) or of(part))
    assert C.blocks_of(pa.array(texts)) == whole and len(whole) == 7
    assert read == [3, 3, 1]
    assert C.blocks_of(pa.array([], pa.string())).to_pylist() == []
