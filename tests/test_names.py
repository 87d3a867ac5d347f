"""Collision numbers against a plain sequential search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from snipmill.operators.names import resolve_collisions


def brute(rows, taken):
    used, out = {}, {}
    for ns, kind, name in taken:
        used.setdefault((ns, kind), set()).add(name)
    for ns, kind, ext, name, order in sorted(rows, key=lambda r: r[4]):
        held = used.setdefault((ns, kind), set())
        n = 1
        while True:
            full = name if n == 1 else f"{name}-{n}"
            file = (full.replace("-", "_") if ext == ".py" else full) + ext
            if file not in held:
                held.add(file)
                out[order] = n
                break
            n += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sequential_search(spark, seed):
    rng = random.Random(seed)
    names = ["foo", "foo", "foo", "foo-2", "foo-2-3", "foo-10", "bar", "bar", "block-01", "block-01", "x-1", "x-0"]
    rows = [
        (f"lib{rng.randrange(2)}", "scripts", rng.choice([".sh", ".py"]), rng.choice(names), i)
        for i in range(300)
    ]
    taken = [
        ("lib0", "scripts", f) for f in
        ("foo.sh", "foo-3.sh", "foo_4.py", "foo-5.py", "bar.sh", "bar-2.sh", "bar-7.sh", "block-01.sh", "block_01_2.py")
    ]
    drafts = spark.createDataFrame(rows, "namespace string, kind string, extension string, name string, at int")
    files = spark.createDataFrame(taken, "namespace string, kind string, filename string")
    got = {r["at"]: r["suffix"] for r in resolve_collisions(drafts, files, ["at"]).collect()}
    assert got == brute(rows, taken)


def test_names_never_run_out(spark):
    rows = [("lib", "scripts", ".sh", "hot", i) for i in range(1105)]
    files = spark.createDataFrame([("lib", "scripts", "hot-5.sh"), ("lib", "scripts", "hot-1050.sh")],
                                  "namespace string, kind string, filename string")
    taken = [("lib", "scripts", "hot-5.sh"), ("lib", "scripts", "hot-1050.sh")]
    for more in ([], [("lib", "scripts", ".sh", "hot-2", 2000 + i) for i in range(3)]):
        drafts = spark.createDataFrame(rows + more, "namespace string, kind string, extension string, name string, at int")
        got = {r["at"]: r["suffix"] for r in resolve_collisions(drafts, files, ["at"]).collect()}
        assert got == brute(rows + more, taken)
        assert max(got.values()) >= 1107


@pytest.mark.parametrize("seed", range(3))
def test_contested_names_at_every_depth(spark, seed):
    rng = random.Random(100 + seed)
    names = ["a", "a-2", "a-3", "a-4", "a-2-2", "a-2-3", "a-2-2-2", "a-3-2", "a-10", "a-2-10", "a-02", "a-1-2", "b-2", "b-2-2", "a-99999999999999999999"]
    rows = [("lib", "scripts", rng.choice([".sh", ".py"]), rng.choice(names[:rng.randint(3, len(names))]), i) for i in range(250)]
    taken = [("lib", "scripts", f) for f in rng.sample(
        ["a-2.sh", "a-5.sh", "a.py", "a_3.py", "a-2-2.sh", "a-3-2.sh", "a-2-4.sh", "a_2_2.py", "b.sh"], 4)]
    drafts = spark.createDataFrame(rows, "namespace string, kind string, extension string, name string, at int").repartition(5)
    files = spark.createDataFrame(taken, "namespace string, kind string, filename string")
    got = {r["at"]: r["suffix"] for r in resolve_collisions(drafts, files, ["at"]).collect()}
    assert got == brute(rows, taken)


def test_a_large_family_with_one_contested_name(spark):
    n, at = 200_000, 150_000
    rows = spark.range(n, numPartitions=8).select(
        F.lit("lib").alias("namespace"), F.lit("scripts").alias("kind"), F.lit(".sh").alias("extension"),
        F.when(F.col("id") == at, "x-150002").when(F.col("id") == 7, "x-3").otherwise("x").alias("name"), F.col("id").cast("int").alias("at"))
    files = spark.createDataFrame([], "namespace string, kind string, filename string")
    named = resolve_collisions(rows, files, ["at"])
    assert named.select("final_name").distinct().count() == n
    got = {r["at"]: r["final_name"] for r in named.where(F.col("at").isin(0, 1, 2, 3, 7, at - 1, at, at + 1, n - 1)).collect()}
    # x-3 is gone when its own draft comes; x-150002 is not, as x has got to 149999 by then.
    assert got == {0: "x", 1: "x-2", 2: "x-3", 3: "x-4", 7: "x-3-2", at - 1: "x-149999", at: "x-150002", at + 1: "x-150000",
                   n - 1: f"x-{n - 1}"}


def test_no_drafts(spark):
    drafts = spark.createDataFrame([], "namespace string, kind string, extension string, name string, at int")
    files = spark.createDataFrame([("lib", "scripts", "a.sh")], "namespace string, kind string, filename string")
    assert resolve_collisions(drafts, files, ["at"]).collect() == []
