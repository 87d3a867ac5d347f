"""One importer, emitter and check of one's own, without a change in the library."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from snipmill.operators import emit
from snipmill.operators import extract as X
from snipmill.plans import compile as C
from snipmill.plans.extensions import BUILT_IN, Check, Emitter, Importer, detect, import_entries


def read_log(entries):
    """A format with one text an entry."""
    text = F.variant_get("entry", "$.log", "string")
    headers = entries.select(F.col("conv_key").alias("doc_key"), F.lit("log").alias("adapter"), F.lit("Log").alias("title"))
    turns = entries.where(text.isNotNull()).select(
        F.col("conv_key").alias("doc_key"), F.lit(1).alias("idx"), F.lit("assistant").alias("role"), text.alias("content_md"))
    return headers, turns, entries.where(text.isNull()).select("conv_key", F.lit("no log").alias("error"))


def no_tabs(rows):
    bad = F.col("text").contains("\t")
    return rows.select("ref", F.lit("no-tabs").alias("check_name"), F.when(bad, "failed").otherwise("passed").alias("status"),
                       F.when(bad, "a tab").otherwise("").alias("detail"))


MORE = BUILT_IN.plus(
    Importer("log", ("log",), read_log),
    Emitter("fish", "script", "bash", ".fish", False, "scripts",
            lambda p: F.concat(p.comments("#!"), p.body), ((1, "no-tabs", "in-process", True, None, ()),)),
    Check("no-tabs", "scripts", ".fish", no_tabs),
)


def test_names_are_taken_once():
    with pytest.raises(ValueError, match="already have 'fish'"):
        MORE.plus(Emitter("fish", "script", None, ".f", False, "scripts", lambda p: p.body))
    assert len(BUILT_IN.emitters) == 6 and len(MORE.emitters) == 7


def test_importer_by_name(spark):
    inputs = spark.createDataFrame([("a.json", '[{"log": "# A"}]'), ("b.json", '[{"chat_messages": []}]'), ("c.json", "[1]")], "path string, text string")
    assert {r.path: r.adapter or r.error for r in detect(inputs, MORE).collect()} == {
        "a.json": "log", "b.json": detect(inputs).where("path = 'b.json'").first().adapter, "c.json": "unsupported"}
    assert detect(inputs).where("path = 'a.json'").first().error == "unsupported"
    entries = spark.createDataFrame([("k1", "log", '{"log": "# A"}'), ("k2", "log", "{}"), ("k3", "other", "{}")],
                                    "conv_key string, adapter string, json string").select("conv_key", "adapter", F.parse_json("json").alias("entry"))
    headers, turns, errors = import_entries(entries, MORE)
    assert [(r.doc_key, r.content_md) for r in turns.collect()] == [("k1", "# A")]
    assert {(r.conv_key, r.error) for r in errors.collect()} == {("k2", "no log"), ("k3", "unknown importer")}


def test_emitter_and_check_by_name(spark):
    docs = spark.createDataFrame([(1, "# Run it\n\n```bash\nls\n```\n"), (2, "# Run tab\n\n```bash\nls\t-l\n```\n")], "doc_key int, text string")
    none = spark.createDataFrame([], "namespace string, kind string, filename string")
    out = C.compile_corpus(X.strip_front_matter(docs), none, emit.RenderContext(compiled_at="T0"), top=0, similarity=False,
                           enabled=["fish", "python"], extensions=MORE)
    drafts = {r.filename: r.content for r in out.drafts.collect()}
    assert set(drafts) == {"run-it.fish", "run-tab.fish"}
    assert drafts["run-it.fish"].startswith("#! name:") and drafts["run-it.fish"].endswith("\nls\n")
    files = out.drafts.select(F.concat(F.lit("scripts/"), "filename").alias("ref"), F.col("content").alias("text"))
    found = {(r.ref, r.check_name): (r.status, r.detail) for r in C.run_checks(files, extensions=MORE).collect()}
    assert found == {("scripts/run-it.fish", "no-tabs"): ("passed", ""), ("scripts/run-tab.fish", "no-tabs"): ("failed", "a tab")}
    assert C.run_checks(files).count() == 0
