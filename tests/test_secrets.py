"""Secret vectors: first hit, literal filter, redaction, refusal across turns."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import secrets as S
from snipmill.operators import refuse
from snipmill.operators.extract import turn_segments
from snipmill.sources.files import scan_pattern_table

PAT = "ghp_" + "a1" * 20
KEY = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
CASES = [
    ("plain text", None),
    (f"x\n{PAT}", ("gh-token", 2)),
    (f"password = abcdefghijkl\n{PAT}", ("gh-token", 2)),     # pattern order beats line order
    ("a\n\npassword = abcdefghijkl", ("kv-secret", 3)),
    ("token: $(cat x)\nsecret='abcdefghijklm'", ("kv-secret", 2)),
    ("token=your-token-goes-here", None), ("password=short", None), ('api_key = "$KEY_FROM_ENV"', None),
    ("API-KEY:\n  abcdefghijklmnop", ("kv-secret", 1)),
    (f"line\n{KEY}", ("private-key", 2)), ("Bearer abcdefghijklmnop", ("bearer", 1)),
    ("AKIA" + "A" * 16, ("aws-key", 1)), ("tskey-auth-" + "k" * 16, ("ts-key", 1)),
    ("github_pat_" + "b" * 22, ("gh-pat", 1)), ("mytoken=abcdefghijklmnop", None),
]


def _texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_key int, text string")


def test_vectors(spark):
    frame = _texts(spark, [c[0] for c in CASES])
    rows = frame.select("doc_key", S.find_secret(F.col("text")).alias("h"), S.has_secret(F.col("text")).alias("any")).collect()
    for r in rows:
        expected = CASES[r["doc_key"]][1]
        assert (tuple(r["h"]) if r["h"] else None) == expected, CASES[r["doc_key"]][0]
        assert r["any"] == (expected is not None)


def _redact(text):
    for label, pattern in fixed.SECRET_PATTERNS:
        rx = re.compile(re.sub(r"\(\?([a-zA-Z]+)\)", lambda m: "(?" + m.group(1).replace("d", "").replace("U", "") + ")"
                               if m.group(1).replace("d", "").replace("U", "") else "", pattern))

        def tail(s):
            s = s.strip()
            return s[-4:] if len(s) >= 4 else "----"

        if label == "kv-secret":
            text = rx.sub(lambda m: f"{m[1]}{m[2]}[REDACTED:{label}:{tail(m[3])}]", text)
        else:
            text = rx.sub(lambda m, l=label: f"[REDACTED:{l}:{tail(m[0])}]", text)
    return text


def test_redaction_against_sequential_rule(spark):
    texts = [c[0] for c in CASES] + ["pwd=a pwd : xy token=\n\nabc secret=", f"{PAT} {PAT}\n{KEY} password=" + PAT]
    rows = refuse.redact_text(_texts(spark, texts)).collect()
    for r in rows:
        assert r["text"] == _redact(texts[r["doc_key"]])


def test_nested_redaction_keeps_keys(spark):
    frame = spark.sql("SELECT struct(array('pwd=abcd', 'x') AS a, map('token', 'token=abcdef') AS m, 5 AS n, "
                      "struct(cast(null AS string) AS s) AS i) AS v")
    v = refuse.redact_nested(frame, "v").first()["v"].asDict(recursive=True)
    assert v["a"] == ["pwd=[REDACTED:kv-secret:abcd]", "x"] and v["n"] == 5 and v["i"] == {"s": None}
    assert v["m"] == {"token": "token=[REDACTED:kv-secret:cdef]"}


def test_key_that_spans_turns(spark):
    begin, end = KEY.split("\nabc\n")
    turns = spark.createDataFrame([
        (1, 1, "user", f"see\n{begin}", None), (1, 2, "user", "more", None), (1, 3, "user", end, None),
        (2, 1, "user", end, None), (2, 2, "user", begin, None), (3, 1, "user", "clean", None),
        (4, 1, "user", "ok", None), (4, 2, "user", "token=abcdefghijkl", None),
    ], "doc_key int, idx int, role string, content_md string, ts string")
    accepted, refused = refuse.refuse_segments(turn_segments(turns))
    assert {tuple(r) for r in refused.collect()} == {(1, "private-key", 14), (4, "kv-secret", 16)}
    assert {r["doc_key"] for r in accepted.collect()} == {2, 3}


def test_pattern_table(spark):
    table = scan_pattern_table('[patterns]\nnet = "\\\\bnc\\\\b"\nbad = "("\n', fixed.SECRET_PATTERNS, "(?is)")
    assert [label for label, _ in table] == ["net"]
    hits = refuse.secret_scan(_texts(spark, ["x NC y", PAT]), table).collect()
    assert [(r["doc_key"], r["label"]) for r in hits] == [(0, "net")]
    for broken in (None, "", "not toml [", "[patterns]\nbad = '('"):
        assert scan_pattern_table(broken, fixed.SECRET_PATTERNS) == fixed.SECRET_PATTERNS


@pytest.mark.parametrize("value, literal", [
    ("abcdefghijkl", True), ('"abcdefghijkl"', True), ("'\"abcdefghijkl", False), ("<abcdefghijkl>", False),
    ("`abcdefghijkl", False), ("changeme12345", False), ("abc...defghijkl", False), ("abcdefghijk", False), ("", False),
])
def test_literal_values(spark, value, literal):
    frame = spark.createDataFrame([(value,)], "v string")
    assert frame.select(S.is_literal_value(F.col("v"))).first()[0] is literal


def test_rows_without_text_are_accepted(spark):
    docs = spark.createDataFrame([(1, None), (2, "fine")], "doc_key int, text string")
    accepted, refused = refuse.refuse_documents(docs)
    assert (accepted.count(), refused.count()) == (2, 0)
