"""Similarity and revision groups against the standard library and the rule itself."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from snipmill.operators import revisions as R

ROWS = "doc_key long, lang string, fence_no int, name_proposal string, body_norm string, reason string"


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(["ab", "abc", "abcdefghij \n", "etaoin shrdlu\n{}();=", "é世x😀"])
        a = "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 30, 150, 250])))
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 3))):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.choice(letters))
        yield a, "".join(b) if rng.random() < 0.7 else "".join(rng.choices(letters, k=rng.choice([0, 3, 40, 260])))


def test_similarity_equals_the_standard_library():
    for a, b in texts(1, 600):
        ratio = SequenceMatcher(None, a, b).ratio()
        assert R.similarity(a, b) == ratio, (a, b)
        assert R.alike(a, b) == (ratio >= 0.7), (a, b)
        assert 2 * R.common_subsequence(a, b) >= ratio * (len(a) + len(b)) - 1e-9


def test_bounds_never_lose_a_match():
    held, bodies = R.Open(), [a for a, _ in texts(2, 60)]
    for i, body in enumerate(bodies):
        held.put(i, f"n{i}", body)
    for _, later in texts(3, 40):
        expected = [i for i, body in enumerate(bodies) if SequenceMatcher(None, body, later).ratio() >= 0.7]
        assert list(held.matches("none", later, 0.7)) == expected


def first_fit(rows):
    groups = {}
    for doc, lang, fence, name, body, reason in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if reason is None:
            mine = groups.setdefault((doc, lang), [])
            for group in mine:
                if group[-1][0] == name or SequenceMatcher(None, group[-1][1], body).ratio() >= 0.7:
                    break
            else:
                group = []
                mine.append(group)
            group.append((name, body, fence))
    return {(doc, fence): n for (doc, _), mine in groups.items() for n, group in enumerate(mine) for *_, fence in group}


@pytest.mark.parametrize("chunk", [1, 3, 16, 1024])
def test_groups_in_rounds_equal_first_fit(spark, chunk):
    rng = random.Random(7)
    rows = []
    for fence in range(110 if chunk > 1 else 12):
        doc = 1 if rng.random() < 0.6 else rng.randint(2, 5)  # one document holds most
        body = "".join(rng.choices("xyz", k=rng.randint(0, 6))) * rng.randint(1, 8) + "\n"
        rows.append((doc, rng.choice(["bash", "sql"]), fence, f"n{rng.randrange(40)}", body,
                     "unlabeled" if rng.random() < 0.1 else None))
    found = spark.createDataFrame(rows, ROWS).repartition(5)
    got = {(r.doc_key, r.fence_no): r.revision_group for r in R.revision_groups(found, chunk=chunk).collect()}
    assert got == first_fit(rows)


def test_nulls_equal_bodies_and_empty_tables(spark):
    rows = [(1, "sql", 1, None, None, None), (1, "sql", 2, None, "", None), (1, "sql", 3, "a", "q" * 5000, None),
            (1, "sql", 4, "b", "q" * 5000, None), (2, None, 1, "a", "x", None)]
    got = {(r.doc_key, r.fence_no): r.revision_group for r in R.revision_groups(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 1}
    assert R.revision_groups(spark.createDataFrame([], ROWS)).collect() == []


@pytest.mark.parametrize("first, most", [(1, 1), (1, 4), (2, 5), (3, 16)])
def test_chunks_that_grow_equal_first_fit(spark, monkeypatch, first, most):
    monkeypatch.setattr(R, "CHUNK", most)  # several tiles of groups too
    rng = random.Random(11)
    rows = [(1, "sql", fence, f"n{rng.randrange(30)}", "".join(rng.choices("abcdefgh", k=rng.randint(3, 9))), None)
            for fence in range(11 if most == 1 else 45)]
    found = R.revision_groups(spark.createDataFrame(rows, ROWS).repartition(3), chunk=first)
    assert {(r.doc_key, r.fence_no): r.revision_group for r in found.collect()} == first_fit(rows)
    # Guessed sizes of joins would multiply from round to round, up to numbers that no driver holds.
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**100


def test_places_are_cut_into_doubling_chunks(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 12)
    sizes = {}
    for r in spark.range(60).select(R._chunk_of(F.col("id"), 3).alias("c")).collect():
        sizes[r.c] = sizes.get(r.c, 0) + 1
    assert [sizes[c] for c in sorted(sizes)] == [3, 6, 12, 12, 12, 12, 3]
