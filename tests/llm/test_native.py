"""Quality rules and mixing against brute force."""

from __future__ import annotations

import collections
import math

import pytest
from pyspark.sql import functions as F

from snipmill.llm import mixing, quality

LABELS = "doc_id long, quality int, toxic int"


def plain_measures(text):
    text = text or ""
    words = text.encode().split()
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in quality.SYMBOLS),
            len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \t\n", "a", "a b c", "a b c d", "a b c a b c", "x x x x x", "é\xa0ü ß\x0bz", "l1\nl1\n\nl1\n l1",
         "a<b|c># $%&*\n\n", "one two three " * 4000, "\x1f\x85 a", "a b c d a b c e b c d"]


def test_measures_equal_brute_force(documents):
    docs = documents(enumerate(TEXTS))
    for r in docs.select("doc_id", quality.measures(F.col("text")).alias("m")).collect():
        assert tuple(r.m) == plain_measures(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_tail_is_the_exact_binomial_sum(spark):
    cases = [(10, 0, .1), (500, 3, .02), (5000, 40, .01), (20_000, 140, .0075), (1, 0, .5)]
    for n, k, p in cases:
        found = spark.range(1).select(quality._tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        want = math.fsum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1)) if n < 1000 else math.fsum(
            math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p))
            for i in range(k + 1))
        assert found == pytest.approx(want, rel=1e-6)


def many(spark, good, bad):
    """Good documents without symbols, bad ones full of them; all with enough words."""
    text = F.when(F.col("id") < good, F.expr("array_join(transform(sequence(1, 60), i -> concat('w', i, 'x', id)), ' ')")
                  ).otherwise(F.expr("array_join(transform(sequence(1, 60), i -> concat('w', i, '###', id)), ' ')"))
    docs = spark.range(good + bad).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    return docs, docs.select("doc_id", (F.col("doc_id") < good).cast("int").alias("quality"))


def test_enough_labels_certify_a_cutoff(spark):
    docs, labels = many(spark, 1500, 40)
    out = quality.judged(docs, labels)
    counts = out.groupBy((F.col("doc_id") < 1500).alias("good"), "quality_verdict.kept").count().collect()
    assert {(r.good, r.kept): r["count"] for r in counts} == {(True, True): 1500, (False, False): 40}


def test_few_labels_reject_nothing(spark):
    docs, labels = many(spark, 100, 40)
    assert quality.judged(docs, labels).where("NOT quality_verdict.kept").count() == 0


def test_cutoffs_hold_for_their_stratum_alone(spark):
    docs, labels = many(spark, 1500, 40)
    other = docs.where("doc_id >= 1500").select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"))
    out = quality.judged(docs.unionByName(other), labels)
    assert out.where("lang IS NULL AND quality_verdict.kept").count() == 40


def test_quality_of_odd_rows(spark, documents):
    docs = documents([(None, "a " * 60), (1, None), (1, None), (2, "")]).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(5))
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 0, 1), (1, 1, 1)], LABELS)
    for labels in (none, odd):
        out = quality.judged(docs, labels)
        assert out.columns == [*docs.columns, "quality_verdict"]
        assert sorted(r.quality_verdict.base_failed for r in out.collect()) == [True] * 4
    assert quality.judged(documents([]).limit(0), none).collect() == []


# --- mixing -----------------------------------------------------------------------------

def plain_targets(sizes):
    """Shares by weight; what is above a cap goes to the others again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, target, open_ = mixing.BUDGET * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 3, None: 50}, {None: 7}, {"x": 0, "y": 5}, {"x": 0}])
def test_targets_fill_like_water(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = plain_targets(sizes)
    for r in mixing.targets(frame).collect():
        assert r.target == pytest.approx(want[r.source])


def test_mix_comes_near_its_targets(documents):
    rows = [(i, "w " * (1 + i * 7 % 23), "en", ["b", "a", "a", None][i % 4]) for i in range(1200)]
    docs = documents(rows).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "draw")
    first, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.mix.taken) for r in first) == sorted((r.doc_id, r.mix.taken) for r in again)
    by_source = collections.defaultdict(list)
    for r in first:
        by_source[r.source].append(r.mix)
        assert r.mix.size == 1 + r.doc_id * 7 % 23 and r.mix.taken <= 2 * r.mix.size
    want = plain_targets({s: sum(m.size for m in ms) for s, ms in by_source.items()})
    for source, mixes in by_source.items():
        assert mixes[0].target == pytest.approx(want[source])
        assert abs(sum(m.taken for m in mixes) - want[source]) <= 12
        assert {m.copies for m in mixes} <= {int(want[source] // mixes[0].source_size), int(want[source] // mixes[0].source_size) + 1}


def test_quality_scales_the_draw(documents):
    """Documents full of marks are taken less often than clean ones of their source."""
    rows = [(i, ("w " if i % 2 else "#### ") * 10, "en", "m" if i % 3 else "z") for i in range(3000)] + [
        (10_000 + i, "w " * 50, "en", "a") for i in range(300)]
    found = mixing.mix(documents(rows)).where("source = 'z'").selectExpr("doc_id % 2 AS clean", "mix.copies AS n").groupBy("clean").avg("n")
    share = {r.clean: r["avg(n)"] for r in found.collect()}
    assert share[1] > share[0]


def test_mix_of_odd_rows(documents):
    docs = documents([(None, None), (1, ""), (1, "a b"), (1, "a b"), (2, "a b")]).withColumnRenamed("lang", "mix")
    out = mixing.mix(docs)
    assert len(out.collect()) == 5 and out.columns.count("mix") == 1
    assert sorted(r.mix.size for r in out.collect()) == [0, 0, 2, 2, 2]
    assert mixing.mix(documents([]).limit(0)).collect() == []
    assert sum(r.mix.taken for r in mixing.mix(documents([(1, None), (2, "")])).collect()) == 0
