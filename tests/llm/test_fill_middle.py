from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from snipmill.llm import fill_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text):
    """The contract, step by step."""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    random.seed(3)
    letters = list("ab é世😀\n\t\r\x0b\x85\xa0<>PSM ")
    texts = ["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(1500)]
    return texts + ["", " ", "\n", "a", " a", "a ", "<P>", "x <S> y", "<", "<S", "P>", "w " * 40_000, "z" * 100_000, " " * 70_000]


def test_ranks_count():
    random.seed(1)
    values = np.array(random.choices(range(8), k=1000), np.uint8)
    matrix = M.WaveletMatrix(values, 3)
    at = np.arange(1001)
    for v in range(8):
        assert matrix.rank(v, at).tolist() == np.concatenate([[0], np.cumsum(values == v)]).tolist()
    assert M.WaveletMatrix(values[:0], 3).rank(1, np.array([0])).tolist() == [0]


def test_cuts_are_the_ends_of_units():
    texts = odd_texts()
    units = M.Units(texts)
    assert units.counts.tolist() == [len(TOKEN.findall(t)) for t in texts]
    for k in (0, 1, 2, 5):
        after = np.minimum(k, units.counts)
        assert units.cut(after).tolist() == [len("".join(TOKEN.findall(t)[:k])) for t in texts]
    assert units.cut(units.counts).tolist() == [len(t) for t in texts]


def test_lines_as_units():
    texts = ["a\nb\nc", "a\n", "", "\n\n", "x"]
    units = M.Units(texts, "line")
    assert units.counts.tolist() == [3, 1, 0, 2, 1]
    assert units.cut(np.minimum(1, units.counts)).tolist() == [2, 2, 0, 1, 1]


def test_rows_equal_the_contract_and_are_restored(documents):
    texts = odd_texts()
    made = M.fill_in_middle(documents(enumerate(texts))).withColumn("restored", M.restored())
    rows = made.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, texts[r.doc_id])
        assert r.restored == texts[r.doc_id]
    assert {r.form for r in rows} == {"plain", "spm", "psm"}


def test_nulls_repeats_and_clashing_names(spark, documents):
    docs = documents([(None, "a b c"), (7, None), (7, "a b"), (7, "a b")]).withColumnRenamed("lang", "key").withColumnRenamed("source", "form")
    rows = M.fill_in_middle(docs).collect()
    assert sorted((r.doc_id or 0, r.n) for r in rows) == [(0, 3), (7, 0), (7, 2), (7, 2)]
    assert [r.form for r in rows if r.n == 0] == ["plain"]
    assert len({r.output for r in rows if r.n == 2}) == 1
    assert M.fill_in_middle(documents([]).limit(0)).collect() == []


def test_rates(documents):
    docs = documents([(i, "one two three four") for i in range(2000)])
    every = M.fill_in_middle(docs, rate=100, suffix_first=0).groupBy("form").agg(F.count("*").alias("n")).collect()
    assert [(r.form, r.n) for r in every] == [("psm", 2000)]
    assert M.fill_in_middle(docs, rate=0).where("form <> 'plain'").count() == 0
    half = M.fill_in_middle(docs).where("form <> 'plain'").count()
    assert 850 < half < 1150
