"""The sliced and ranged forms give what a plain window gives."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from snipmill.operators import extract as X
from snipmill.operators.running import Running, add_rank, add_running, add_total
from snipmill.plans.corpus import turns


def _hot(spark, n=400):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.choice([None, i]), i % 5) for i in range(n)]
    return spark.createDataFrame(rows, "key string, pos int, mark int, weight int")


def test_sliced_running_equals_window(spark):
    df = _hot(spark)
    specs = [
        Running("last_mark", "max", F.when(F.col("mark").isNotNull(), F.struct("pos", "mark"))),
        Running("before", "sum", F.col("weight"), current=False),
    ]
    plain = add_running(df, ["key"], "pos", ["pos"], specs, top=399)
    sliced = add_running(df, ["key"], "pos", ["pos"], specs, top=399, slice_size=16)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, sliced.select(plain.columns).collect()), key=str)


def test_sliced_total_equals_window(spark):
    df = _hot(spark)
    spec = Running("total", "sum", F.col("weight"))
    plain = add_total(df, ["key"], spec, top=399)
    joined = add_total(df, ["key"], spec, top=399, slice_size=16).select(plain.columns)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, joined.collect()), key=str)


def test_rank_over_ranges_equals_row_number(spark):
    df = _hot(spark)
    expected = df.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("weight", "pos")))
    ranked = add_rank(df, ["key"], ["weight", "pos"], "r", partitions=6)
    assert {tuple(r) for r in expected.collect()} == {tuple(r) for r in ranked.select(expected.columns).collect()}


def test_sliced_extraction_equals_plain(spark, sf_dir):
    rows = turns(spark, sf_dir)
    plain = X.extract_fences(X.turn_segments(rows))
    cut = X.extract_fences(X.turn_segments(rows, slice_size=2), slice_size=2)
    key = lambda r: (r.doc_key, r.fence_no)
    assert sorted(plain.collect(), key=key) == sorted(cut.select(plain.columns).collect(), key=key)


def test_sliced_revisions_equal_plain(spark, sf_dir):
    found = X.candidates(X.extract_fences(X.turn_segments(turns(spark, sf_dir))), X.fixed.LANGUAGES)
    for revise in (X.supersede_by_name, X.supersede_by_similarity):
        plain = revise(found, top=0)
        cut = revise(found, top=10, slice_size=2)
        key = lambda r: (r.doc_key, r.fence_no)
        assert sorted(plain.collect(), key=key) == sorted(cut.select(plain.columns).collect(), key=key)
