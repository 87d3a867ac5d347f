from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from snipmill.llm import term_search as S

ITEMS = "item_id long, text string, source string"


def terms(text):
    return re.findall(S.TERMS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, best=50):
    """Every score by its definition."""
    counted = [(key, Counter(t)) for key, text in docs if (t := terms(text))]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    asked: dict = {}
    for key, text in items:
        asked.setdefault(key, set()).update(terms(text))
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, words in asked.items():
        rows = []
        for key, c in counted:
            m = 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in words if t in c)
            if score > 0:
                rows.append((-score, -math.inf if key is None else key))
        out += [(item, rank, None if key == -math.inf else key, -score) for rank, (score, key) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture
def benchmark(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], ITEMS)


def some(seed, n, words=60):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Été", "世界", "A1", "x"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, random.choice([" ", "-", "\n", "_"]).join(random.choices(vocabulary, weights, k=random.randint(0, 40)))) for i in range(n)]


def test_terms_of_bytes_are_those_of_the_pattern():
    texts = ["Ab cd_EF-9é!x", "ÀÉ É", "世界。a", "", "\0a\x7fb\x80c\xa0d", "a" * 1000]
    assert [[t.decode() for t in S.terms_of(x)] for x in texts] == [terms(x) for x in texts]


@pytest.mark.parametrize("block", [8192, 40, 3])
def test_scores_equal_brute_force(documents, benchmark, block):
    docs, items = some(1, 600), some(2, 25)
    assert found(S.search(documents(docs), benchmark(items), best=7, block_size=block)) == expected(docs, items, 7)
    assert found(S.search(documents(docs), benchmark(items), block_size=block)) == expected(docs, items)


def test_blocks_and_bundles_drop_nothing_that_could_win():
    docs, items = some(3, 900, 200), some(4, 12, 200)
    number = {t: i for i, t in enumerate(sorted({t for _, x in items for t in terms(x)}))}
    counted = [Counter(terms(x)) for _, x in docs if terms(x)]
    spread = [(n, sum(t in c for c in counted), max([c[t] for c in counted])) for t, n in number.items() if any(t in c for c in counted)]
    plan = S.Plan({k: [number[t] for t in set(terms(x))] for k, x in items}, spread, len(counted), sum(c.total() for c in counted), 5)
    import numpy as np

    norms = plan.norms([c.total() for c in counted])
    lists = {}
    for t, n in number.items():
        at = np.array([i for i, c in enumerate(counted) if t in c], np.int64)
        tf = np.array([counted[i][t] for i in at], np.int64)
        if len(at):
            lists[n] = (at, 10**9 * tf // (1000 * tf + 20 * norms[at]))
    bundles, sizes = {}, []
    for stage in range(S.OWNERS):
        own = {t: v for t, v in lists.items() if plan.owner[t] == stage}
        bundles = {item: (at, scores) for item, at, scores in plan.step(stage, bundles, own, len(counted))}
        sizes.append(sum(len(at) for at, _ in bundles.values()))
    for item in range(len(items)):
        whole = np.zeros(len(counted), np.int64)
        for term, weight in [p for s in plan.stages for p in s.get(item, ())]:
            whole[lists[term][0]] += weight * lists[term][1]
        best = sorted(whole[whole > 0].tolist(), reverse=True)[:5]
        assert sorted(bundles.get(item, ((), np.array([])))[1].tolist(), reverse=True)[:5] == best
    assert sizes[-1] < sum(len(v[0]) for v in lists.values())


def test_rounds_of_items(documents, benchmark, monkeypatch):
    monkeypatch.setattr(S, "ROUND", 50)
    docs, items = some(5, 200), some(6, 15)
    assert found(S.search(documents(docs), benchmark(items), best=3)) == expected(docs, items, 3)


def test_nulls_ties_repeats_and_empty_tables(documents, benchmark):
    docs = [(None, "a b"), (5, "a b"), (5, "a b"), (3, "a b"), (4, None), (6, ""), (7, "long " * 50_000 + "a"), (8, "-- !!")]
    items = [(1, "a"), (1, "B zzz"), (None, "long"), (2, None), (3, "nothing here"), (4, "A a A")]
    assert found(S.search(documents(docs), benchmark(items))) == expected(docs, items)
    clash = documents(docs).withColumnRenamed("lang", "key").withColumnRenamed("source", "item")
    assert found(S.search(clash, benchmark(items).withColumnRenamed("source", "term"))) == expected(docs, items)
    assert found(S.search(documents([]).limit(0), benchmark(items))) == []
    empty = S.search(documents(docs), benchmark([]).limit(0))
    assert (empty.columns, empty.collect()) == (["item_id", "rank", "doc_id", "score"], [])


def test_items_with_text_keys(spark, documents):
    items = spark.createDataFrame([("q", "w0 w1"), (None, "w2")], "item_id string, text string")
    docs = some(7, 50)
    assert found(S.search(documents(docs), items)) == expected(docs, [("q", "w0 w1"), (None, "w2")])
