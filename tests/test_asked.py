"""What a batch asks for, by a cut of the stores and by folding them where they lie."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from snipmill.operators import records as G

RECORD = "id string, revision_id string, content_hash string, {} string, created_at string"


def stores(spark):
    revisions = spark.range(30).select(
        F.concat(F.lit("rev"), "id").alias("id"), F.lit("art").alias("artifact_id"), F.lit("h").alias("content_hash"),
        F.lit(None).cast("string").alias("manifest"))
    contents = spark.createDataFrame([("rev1", "a", "x")], "revision_id string, path string, content string")

    def records(state):
        return spark.createDataFrame(
            [(f"r{k:03}", f"rev{k % 40}", "h" if k % 7 else "other", f"s{k % 3}", f"2026-01-{k % 9 + 1:02}") for k in range(200)],
            RECORD.format(state)).repartition(5)

    return revisions, contents, records("verification_state"), records("approval_state")


@pytest.mark.parametrize("few", [0, 20_000])
def test_a_batch_gets_what_it_asks_for_and_no_more(spark, monkeypatch, few):
    monkeypatch.setattr(G, "FEW", few)
    monkeypatch.setattr(G, "verify_manifest", lambda revisions, contents: revisions.select("id", F.lit("x").alias("failure")))
    requests = spark.createDataFrame([("rev1",), ("rev1",), ("rev22",), ("rev39",), (None,)], "revision_id string")
    some, integrity, governance = G.asked_records(requests, *stores(spark))
    assert sorted(r.id for r in some.collect()) == sorted(r.id for r in integrity.collect()) == ["rev1", "rev22"]
    revisions, _, verifications, approvals = stores(spark)
    whole = {r.id: r for r in G.governance_binding(revisions, verifications, approvals).collect()}
    assert {r.id: r for r in governance.collect()} == {i: whole[i] for i in ("rev1", "rev22")}


def test_many_ids_meet_folded_records_only(spark, monkeypatch):
    """A join ahead of the fold would send each record to the ids."""
    monkeypatch.setattr(G, "FEW", 0, raising=False)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, _, governance = G.asked_records(spark.createDataFrame([("rev1",)], "revision_id string"), *stores(spark))
        assert governance._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
