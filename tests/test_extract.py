"""Extraction on small documents, and against brute force."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import markdown as M
from snipmill.operators import extract as X

TALK = """---
kind: transcript
title: pump station
---
<!-- turn 1 role=user -->
Which valve do I close first? I forgot.

```bash
# tried by hand
echo valve
```

<!-- turn 2 role=Assistant ts=2026-01-01 -->
Here is a script that closes them:

# Valves

## Close valve

```bash
#!/usr/bin/env bash
sudo close-valve --id 1
sudo iptables -L
```

<!-- turn 3 role=user -->
Make it safer.

<!-- turn 4 role=assistant -->
```bash
#!/usr/bin/env bash
set -e
sudo close-valve --id 1
```

## Output

```console
$ ok
```

~~~json
{}
~~~
"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_key int, text string")


def rows(frame):
    return [r.asDict(recursive=True) for r in frame.orderBy("doc_key", "fence_no").collect()]


def test_conversation_with_two_revisions(spark):
    found = rows(X.supersede_by_similarity(X.candidates(X.document_fences(docs(spark, TALK)))))
    assert [r["reason"] for r in found] == ["user-turn", "superseded", None, "console", "non-target-lang"]
    last = found[2]
    assert last["name_proposal"] == "close-valve" and last["superseded_count"] == 1
    assert last["supersedes"] == found[1]["sha256"] and found[1]["detail"] == "→ close-valve"
    assert last["description"] == "Make it safer."
    assert found[1]["description"] == "Which valve do I close first?"
    assert last["heading_path"] == ["Valves", "Close valve"] and (last["turn"], last["role"]) == (4, "assistant")
    assert found[1]["flags"] == ["sudo", "firewall"]
    lines = TALK.split("\n")
    for r in found:
        assert lines[r["line_start"] - 1].startswith(("```", "~~~")) and lines[r["line_end"] - 1] in ("```", "~~~")


def test_options(spark):
    fences = X.document_fences(docs(spark, TALK))
    both = rows(X.supersede_by_name(X.candidates(fences, include_user=True), all_revisions=True))
    assert [r["reason"] for r in both][:3] == [None, None, None]
    with pytest.raises(ValueError):
        X.candidates(fences, ["cobol"])


def test_plain_paste(spark):
    text = (
        "# Notes\n\nLead text.\n\n## Disk\n\nHere's a script that lists big files. More.\n\n```sh\ndu -sh /var\n```\n\n"
        "### Deep\n```bash\nset -e\n```\n\n# Other\n\n```python\nx=1\n```\n```\nbare\n```\n```bash\n\n```\n"
    )
    found = rows(X.candidates(X.document_fences(docs(spark, text))))
    assert [r["reason"] for r in found] == [None, None, "non-target-lang", "unlabeled", "empty"]
    assert found[0]["description"] == "Lists big files." and found[0]["name_proposal"] == "disk"
    assert found[1]["description"] == "Notes / Disk / Deep"
    assert found[2]["detail"] == "python not selected" and found[2]["heading_path"] == ["Other"]


def test_names_without_heading(spark):
    text = "```bash\n#!/bin/sh\n# set -e\n# Rotate keys now\nx\n```\n```sql\n-- Daily totals\nSELECT 1;\n```\n```py\nx=1\n```\n```pwsh\n#Requires -Version 7\n# Copy items\n```\n"
    found = rows(X.candidates(X.document_fences(docs(spark, text)), fixed.LANGUAGES))
    assert [r["name_proposal"] for r in found] == ["rotate-keys-now", "daily-totals", "block-03", "copy-items"]


def test_same_hash_for_equal_content(spark):
    bodies = ["a  \nb\n\n", "a\r\nb", "a\nb\n"]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert X.normalize_and_hash(frame).select("sha256").distinct().count() == 1


def test_open_fence_swallows_later_turns(spark):
    turns = spark.createDataFrame([
        (1, 1, "user", "Q one", None), (1, 2, "assistant", "## H\n\n```bash\necho 1", None),
        (1, 3, "user", "still inside", None), (1, 4, "assistant", "```\n\nafter\n\n```sh\necho 2\n```", None),
        (2, 1, "user", "Q", None), (2, 2, "assistant", "```bash\nok\n```", None),
    ], "doc_key int, idx int, role string, content_md string, ts string")
    found = rows(X.extract_fences(X.turn_segments(turns)))
    one = [r for r in found if r["doc_key"] == 1]
    assert [r["lang_raw"] for r in one] == ["bash", "sh"]
    assert one[0]["body"] == (
        "echo 1\n\n<!-- turn 3 role=user -->\nstill inside\n\n<!-- turn 4 role=assistant -->\n")
    # A marker line inside the fence still moves the turn for what follows.
    assert (one[0]["turn"], one[1]["turn"]) == (2, 4)
    front = 10
    whole = "\n".join(["x"] * front) + "\n\n" + "\n\n".join([
        "<!-- turn 1 role=user -->\nQ one", "<!-- turn 2 role=assistant -->\n## H\n\n```bash\necho 1",
        "<!-- turn 3 role=user -->\nstill inside",
        "<!-- turn 4 role=assistant -->\n```\n\nafter\n\n```sh\necho 2\n```"]) + "\n"
    lines = whole.split("\n")
    assert lines[one[0]["line_start"] - 1] == "```bash" and lines[one[1]["line_start"] - 1] == "```sh"


def test_turn_numbers_out_of_order(spark):
    text = (
        "<!-- turn 5 role=user -->\nLate question.\n\n<!-- turn 2 role=user -->\nEarly question.\n\n"
        "<!-- turn 4 role=assistant -->\n```bash\nx\n```\n"
    )
    found = rows(X.candidate_description(X.document_fences(docs(spark, text))))
    assert found[0]["description"] == "Early question."


def scan(lines):
    """Fences of a text without other block constructs, line by line."""
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        indent = len(line) - len(line.lstrip(" "))
        mark = line.lstrip(" ")[:1]
        run = len(line.lstrip(" ")) - len(line.lstrip(" ").lstrip(mark)) if mark in ("`", "~") else 0
        rest = line.lstrip(" ")[run:]
        if indent > 3 or run < 3 or (mark == "`" and "`" in rest):
            i += 1
            continue
        j, body = i + 1, []
        while j < len(lines):
            s = lines[j].lstrip(" ")
            n = len(s) - len(s.lstrip(mark))
            if len(lines[j]) - len(s) <= 3 and n >= run and not s[n:].strip():
                break
            cut = min(indent, len(lines[j]) - len(s))
            body.append(lines[j][cut:] + "\n")
            j += 1
        closed = j < len(lines)
        label = rest.split()[0].lower() if rest.split() else None
        out.append((i, j + closed, label, "".join(body), closed))
        i = j + closed
    return out


def test_fences_against_line_scanner(spark):
    rng = random.Random(3)
    pool = ["text", "", "```", "```sh", "````", "~~~", "~~~~ Py x", "  ```", "   ~~~", "``` a`b", "`` x", "  body", " ```js", "~~~ `a`"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) + "\n" for _ in range(400)]
    frame = docs(spark, *texts).select("doc_key", M.blocks(F.col("text")).alias("b"), M.ends_open(F.col("text")).alias("open"))
    for r in frame.collect():
        lines = texts[r["doc_key"]][:-1].split("\n")
        expected = scan(lines)
        got = [(b["line"], b["line_end"], b["label"], b["body"], b["closed"]) for b in r["b"] if b["kind"] == "fence"]
        assert got == expected, texts[r["doc_key"]]
        assert bool(r["open"]) == any(not e[4] for e in expected), texts[r["doc_key"]]


def test_blocks(spark):
    text = "A\nb\n===\npara one\nmore\n\n- item\n> quote\n\n    code\n***\n##  Two ##\n#no\n<!-- c -->\ntail\n---\n"
    kinds = docs(spark, text).select(M.blocks(F.col("text")).alias("b")).first()["b"]
    assert [(b["kind"], b["level"], b["text"]) for b in kinds] == [
        ("heading", 1, "A\nb"), ("para", None, "para one\nmore"), ("para", None, "item"), ("para", None, "quote"),
        ("heading", 2, "Two"), ("para", None, "#no"), ("heading", 2, "tail"),
    ]


def first_fit(rows):
    groups = []
    for lang, name, body in rows:
        for g in groups:
            l, n, b = rows[g[-1]]
            if l == lang and (n == name or SequenceMatcher(None, b, body).ratio() >= 0.70):
                g.append(rows.index((lang, name, body)))
                break
        else:
            groups.append([rows.index((lang, name, body))])
    return groups


def test_similarity_against_first_fit(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "echo", "sudo ls", "mv a b", "rm x"]
    data, texts = [], []
    for d in range(12):
        parts = []
        for i in range(rng.randrange(2, 9)):
            body = "\n".join(rng.choice(words) for _ in range(rng.randrange(2, 40))) + f"\n# {d} {i}\n"
            lang = rng.choice(["bash", "python"])
            name = f"n{rng.randrange(6)}"
            data.append((d, lang, name, body))
            parts.append(f"# {name}\n\n```{lang}\n{body}```\n")
        texts.append("\n".join(parts))
    found = X.candidates(X.document_fences(docs(spark, *texts)), fixed.LANGUAGES)
    got = rows(X.supersede_by_similarity(found, top=0))
    for d in range(12):
        mine = [(lang, name, body) for k, lang, name, body in data if k == d]
        groups = first_fit(mine)
        counts = {g[-1]: len(g) - 1 for g in groups}
        assert {r["fence_no"] - 1: r["superseded_count"] for r in got if r["doc_key"] == d and r["reason"] is None} == counts


def test_library_duplicates_and_accounting(spark):
    text = "# A\n```bash\nx\n```\n# B\n```bash\ny\n```\n"
    found = X.supersede_by_name(X.candidates(X.document_fences(docs(spark, text))), top=0)
    held = found.where("fence_no = 1").select("sha256")
    marked = X.dedup_against_library(found, held.unionByName(held))
    assert [(r["reason"], r["detail"]) for r in rows(marked)] == [("dupe-in-library", "a"), (None, None)]
    outcomes = marked.withColumn("outcome", F.when(F.col("reason").isNull(), "draft").otherwise("skipped"))
    assert X.fence_accounting(found, outcomes).count() == 1
    with pytest.raises(Exception, match="fences lost"):
        X.fence_accounting(found, outcomes.limit(1)).collect()


RISKS = [
    ("powershell", "Remove-Item C:\\t -Recurse -Force", "remove-recurse-force", True),
    ("powershell", "rm .\\build -fo -r", "remove-recurse-force", True),
    ("powershell", "Remove-Item .\\x -Recurse", "remove-recurse-force", False),
    ("powershell", "ps.exe -ep bypass -File x", "execution-policy", True),
    ("powershell", "Get-ExecutionPolicy", "execution-policy", False),
    ("powershell", "iwr https://a.test/i.ps1 | iex", "download-execute", True),
    ("powershell", "iwr https://a.test/f.zip -OutFile f.zip", "download-execute", False),
    ("powershell", "Start-Process pwsh -Verb runas", "run-as-admin", True),
    ("sql", "alter table t drop column c;", "drop", True),
    ("sql", "SELECT 1;\nDELETE FROM t", "delete-no-where", True),
    ("sql", "DELETE FROM s\nWHERE e < now();", "delete-no-where", False),
    ("sql", "CREATE TABLE c (p int REFERENCES p ON DELETE CASCADE);", "delete-no-where", False),
    ("sql", "UPDATE a SET b = 0;", "update-no-where", True),
    ("sql", "UPDATE t\nSET a = 1\nWHERE id = 2;", "update-no-where", False),
    ("sql", "GRANT all privileges ON d TO u;", "grant-all", True),
    ("python", "os.popen('ls')", "os-system", True),
    ("python", "run(c, shell = True)", "shell-true", True),
    ("python", "ast.literal_eval(s)", "eval-exec", False),
    ("python", "exec (code)", "eval-exec", True),
    ("bash", "DROP TABLE x; eval(w)", "drop", False),
    ("bash", "rm -fr /x", "rm-rf", True),
    ("bash", "curl -s u | sudo bash", "pipe-to-shell", False),
    ("bash", "curl -s u | bash", "pipe-to-shell", True),
    ("bash", "echo x >> /etc/hosts", "etc-write", True),
    ("bash", "pip3 install x", "pkg-install", True),
    ("bash", "pseudo x", "sudo", False),
]


def test_risk_vectors(spark):
    frame = spark.createDataFrame([(i, lang, body) for i, (lang, body, _, _) in enumerate(RISKS)],
                                  "i int, lang string, body string")
    got = {r["i"]: r["flags"] for r in X.risk_flags(frame).collect()}
    for i, (lang, body, flag, hit) in enumerate(RISKS):
        assert (flag in got[i]) == hit, (lang, body, got[i])


def test_risk_tables_can_be_replaced(spark):
    frame = spark.createDataFrame([("sql", "sudo DROP")], "lang string, body string")
    flags = X.risk_flags(frame, [("custom", "DROP")], {"sql": [("custom", "sudo")]}).first()["flags"]
    assert flags == ["custom"]
