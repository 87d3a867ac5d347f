"""A whole compile over small documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from snipmill.operators import emit
from snipmill.operators import extract as X
from snipmill.plans.compile import compile_corpus, import_corpus
from snipmill.sources import sinks

CONTEXT = emit.RenderContext(compiled_at="T0")
DOCS = [
    (1, "# Clean logs\n\n```bash\n#!/bin/sh\n\nrm -rf /var/log/old  \n\n```\n\n```prompt\nFix {bug} \"now\"\n```\n"),
    (2, "# Clean logs\n\n```bash\nfind / -name x\n```\n\n# Two\n```pwsh\n#!/usr/bin/env pwsh\nGet-Date\n```\n"),
    (3, "# Leak\n\n```bash\nexport A=1\n```\n\nThe password: hunter2hunter2\n"),
    (4, "# Clean logs\n\n```py\nx = 1\n```\n```console\n$ x\n```\n"),
]


@pytest.fixture(scope="module")
def compiled(spark):
    docs = spark.createDataFrame(DOCS, "doc_key int, text string")
    taken = spark.createDataFrame([("library", "scripts", "clean-logs.sh"), ("library", "scripts", "clean-logs-3.sh")],
                                  "namespace string, kind string, filename string")
    sources = docs.select("doc_key", F.concat(F.lit("chat\n"), "doc_key").alias("source"))
    return compile_corpus(X.strip_front_matter(docs), taken, CONTEXT, sources=sources, top=0,
                          enabled=["bash", "python", "prompt"])


def test_outcomes(compiled):
    names = {(r["doc_key"], r["fence_no"]): (r["filename"], r["renamed"]) for r in compiled.drafts.collect()}
    assert names == {(1, 1): ("clean-logs-2.sh", True), (1, 2): ("clean-logs.md", False),
                     (2, 1): ("clean-logs-4.sh", True), (4, 1): ("clean_logs.py", False)}
    assert {(r["doc_key"], r["fence_no"], r["reason"], r["lang"]) for r in compiled.skipped.collect()} == {
        (2, 2, "unsupported-emitter", "powershell"), (4, 2, "console", "console")}
    assert [tuple(r) for r in compiled.refused.collect()] == [(3, "kv-secret", 7)]
    assert compiled.outcomes().groupBy().count().first()[0] == 7


def test_content(compiled):
    text = {(r["doc_key"], r["fence_no"]): r["content"] for r in compiled.drafts.collect()}
    assert text[1, 1] == (
        "#!/usr/bin/env bash\n# name:        clean-logs-2.sh\n# source:      chat 1\n"
        "# compiled:    snipmill 0.1.0 T0\n# description: Clean logs\n# review:      DRAFT — not executable until approved\n"
        "# risk-flags:  rm-rf\n# verify-with: (fill in before approve)\nset -euo pipefail\nIFS=$'\\n\\t'\n\nrm -rf /var/log/old\n")
    assert text[1, 2].endswith('placeholders: ["bug"]\nverify-with: "(fill in before approve)"\n---\n\nFix {bug} "now"\n')
    assert 'risk-flags: []\n' in text[1, 2] and 'source: "chat 1"\n' in text[1, 2]


def test_powershell_shebang_goes_first(spark):
    docs = spark.createDataFrame(DOCS, "doc_key int, text string").where("doc_key = 2")
    none = spark.createDataFrame([], "namespace string, kind string, filename string")
    out = compile_corpus(X.strip_front_matter(docs), none, CONTEXT, top=0).drafts.where("emitter = 'powershell'").first()
    assert out["content"].startswith("#!/usr/bin/env pwsh\n# name:        two.ps1\n# source:      -\n")
    assert out["content"].endswith("\n\nGet-Date\n")


def test_emitter_rules(spark):
    with pytest.raises(ValueError):
        emit.enabled_rules(["bash", "cobol"])
    with pytest.raises(ValueError):
        emit.enabled_rules(["bash", "bash"])
    found = spark.createDataFrame([("script", "bash", None, "")], "artifact_type string, lang string, reason string, detail string")
    both = [("a", "script", "bash", ".sh", True, "scripts"), ("b", "script", None, ".x", False, "scripts")]
    with pytest.raises(Exception, match="several emitters"):
        emit.assign_emitter(found, both).collect()


def test_import(spark):
    headers = spark.createDataFrame(
        [(1, "s", "a", "c", "Plan", None, "in/1"), (2, "s", "a", None, "token = abcdefghijkl", None, "in/2"), (3, "s", "a", None, "Plan", None, "in/3")],
        "doc_key int, source string, adapter string, conversation_id string, title string, exported_at string, source_path string")
    turns = spark.createDataFrame([(1, 1, "user", "hi", None), (2, 1, "user", "clean", None)],
                                  "doc_key int, idx int, role string, content_md string, ts string")
    none = spark.createDataFrame([], "namespace string, kind string, filename string")
    out = import_corpus(headers, turns, none, year="2026", month="01", ts=F.lit("t"))
    ledger = {r["source_path"]: (r["result"], r["detail"], r["turns"]) for r in out.ledger.collect()}
    assert ledger == {"in/1": ("ok", "transcripts/2026/01/plan.md", 1), "in/2": ("refused", "secret:kv-secret", 1),
                      "in/3": ("ok", "transcripts/2026/01/plan-2.md", 0)}
    assert [tuple(r) for r in out.refused.collect()] == [(2, "kv-secret", 7)]
    assert {r["doc_key"] for r in out.parts.collect()} == {1, 3}
    dry = import_corpus(headers, turns, none, year="2026", month="01", ts=F.lit("t"), dry_run=True)
    assert dry.ledger.count() == 0


def _compile(spark, docs, sources=None, **more):
    frame = spark.createDataFrame(docs, "doc_key int, text string")
    none = spark.createDataFrame([], "namespace string, kind string, filename string")
    return compile_corpus(X.strip_front_matter(frame), none, CONTEXT, sources=sources, top=0, **more)


def test_secrets_of_headers_and_labels_refuse(spark):
    body = "# T\n\n```bash\nls\n```\n"
    sources = spark.createDataFrame([(1, "chat"), (2, "chat password: hunter2hunter2"), (3, "chat")], "doc_key int, source string")
    out = _compile(spark, [(1, "---\ntitle: a\npassword: hunter2hunter2\n---\n" + body), (2, body), (3, body)], sources)
    assert sorted(r["doc_key"] for r in out.drafts.collect()) == [3]
    assert {(r["doc_key"], r["line"]) for r in out.refused.collect()} == {(1, 3), (2, 1)}


def test_equal_headings_all_get_a_draft(spark):
    docs = [(i, f"# Setup\n\n```bash\necho {i}\n```\n") for i in range(1100)]
    out = _compile(spark, docs, similarity=False).outcomes().groupBy("outcome").agg(
        F.count("*").alias("n"), F.countDistinct("what").alias("names")).collect()
    assert [tuple(r) for r in out] == [("draft", 1100, 1100)]


def test_names_clash_within_a_library_only(spark):
    docs = [(i, f"# Setup\n\n```bash\necho {i}\n```\n") for i in range(4)]
    drafts = _compile(spark, docs, similarity=False, namespace=F.concat(F.lit("lib"), F.col("doc_key") % 2)).drafts.collect()
    assert sorted(r["filename"] for r in drafts) == ["setup-2.sh", "setup-2.sh", "setup.sh", "setup.sh"]


def test_accounting_balances_and_a_lost_fence_stops_the_sink(spark, compiled, tmp_path):
    counts = {r["doc_key"]: (r["fences_seen"], r["drafts"], r["skipped"], r["unsupported"]) for r in compiled.accounting.collect()}
    assert counts == {1: (2, 2, 0, 0), 2: (2, 1, 0, 1), 4: (2, 1, 1, 0)}
    seen = spark.createDataFrame([(1,), (1,)], "doc_key int")
    lost = X.fence_accounting(seen, spark.createDataFrame([(1, "draft")], "doc_key int, outcome string"))
    with pytest.raises(Exception, match="fences lost in document 1"):
        sinks.sink_drafts(compiled.drafts, str(tmp_path / "drafts"), lost)
    assert not (tmp_path / "drafts").exists()
