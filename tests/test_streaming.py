"""Streams over several batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipmill.operators import events as E
from snipmill.operators import idempotency
from snipmill.streaming.logs import dual_write, event_log_scan, event_log_stream
from snipmill.streaming.requests import read_store, run_requests

SCHEMA = "arrival long, idempotency_key string, request_fingerprint string"


def test_requests_over_batches(spark, tmp_path):
    batches = [
        [(1, "a", "f"), (2, "a", "f"), (3, "a", "g"), (4, "refuse", "f"), (5, "lose", "f")],
        [(6, "a", "f"), (7, "a", "g"), (8, "refuse", "f"), (9, "lose", "f"), (10, "b", "f")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))

    def run(new):
        status = F.when(F.col("idempotency_key") == "refuse", "refused").when(
            F.col("idempotency_key") == "lose", "lost").otherwise("completed")
        return new.select("idempotency_key", status.alias("status"), F.concat(F.lit("r"), "arrival").alias("result_json"))

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run_requests(stream, str(tmp_path), run, "op", "now", availableNow=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "decisions")).collect()
    first = {r["arrival"]: (r["decision"], r["result_json"]) for r in rows}
    order = sorted(first)
    assert order == list(range(1, 11))
    if rows and {r["batch"] for r in rows if r["arrival"] <= 5} == {0}:   # files are taken in order of age
        assert first == {
            1: ("new", None), 2: ("replay", "r1"), 3: ("conflict", None), 4: ("new", None), 5: ("new", None),
            6: ("replay", "r1"), 7: ("conflict", None), 8: ("new", None), 9: ("outcome_unknown", None), 10: ("new", None)}
    store = {r["idempotency_key"]: r["disposition"] for r in read_store(spark, str(tmp_path)).collect()}
    assert store == {"a": "completed", "b": "completed", "lose": "unknown"}


def test_repeats_follow_the_first_of_their_batch(spark):
    requests = spark.createDataFrame(
        [(1, "a", "f"), (2, "a", "f"), (3, "a", "g"), (4, "b", "f"), (5, "b", "f"), (6, "c", "f"), (7, "c", "f")], SCHEMA)
    store = spark.createDataFrame([], "idempotency_key string, request_fingerprint string, disposition string, result_json string")
    results = spark.createDataFrame([("a", "completed", "r"), ("b", "refused", None), ("c", "lost", None)],
                                    "idempotency_key string, status string, result_json string")
    found = idempotency.settle_repeats(idempotency.decide(requests, store), results).collect()
    assert {r["arrival"]: (r["decision"], r["result_json"]) for r in found} == {
        1: ("new", None), 2: ("replay", "r"), 3: ("conflict", None), 4: ("new", None), 5: ("released", None),
        6: ("new", None), 7: ("outcome_unknown", None)}


def test_two_logs(spark, tmp_path):
    headers = spark.createDataFrame([(1, "in/1", "v", "c", 2), (2, "in/2", "v", None, 0)],
                                    "doc_key int, source_path string, adapter string, conversation_id string, turns int")
    refused = spark.createDataFrame([(2, "bearer")], "doc_key int, label string")
    places = spark.createDataFrame([(1, "transcripts/x.md")], "doc_key int, destination string")
    ledger = E.import_events(headers, refused, places, F.lit("t"))
    assert E.import_events(headers, refused, places, F.lit("t"), dry_run=True).count() == 0
    ledger.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ledger.schema).parquet(str(tmp_path / "in"))
    dual_write(stream, str(tmp_path), availableNow=True).awaitTermination()
    shared = event_log_scan(spark, str(tmp_path / "shared"), "event_type string, payload string").collect()
    assert {r["event_type"] for r in shared} == {"transcript.import_completed", "transcript.import_refused"}
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "ledger")).collect())
    assert len(lines) == 2 and '"conversation_id":null' in lines[1] and '"detail":"secret:bearer"' in lines[1]


def test_blank_lines_are_no_events(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"n":1}\n\n  \n{"n":2}\n')
    stream = event_log_stream(spark, str(tmp_path / "log"), "n int")
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_sequences_continue(spark):
    rows = spark.createDataFrame([(i, f"2026-01-0{i % 3 + 1}", "p" if i % 4 else "q") for i in range(20)],
                                 "event_id int, ts string, producer string")
    written = spark.createDataFrame([("p", 7)], "producer string, lines int")
    got = E.producer_sequence(rows, written).collect()
    for producer, offset in (("p", 7), ("q", 0)):
        mine = sorted((r["ts"], r["event_id"], r["producer_sequence"]) for r in got if r["producer"] == producer)
        assert [m[2] for m in mine] == list(range(offset, offset + len(mine)))


def test_a_batch_that_breaks_off_is_not_sent_again(spark, tmp_path):
    """A run that fails after it was sent leaves its keys unknown; the next start does not call it again."""
    spark.createDataFrame([(1, "a", "f"), (2, "b", "f")], SCHEMA).write.parquet(str(tmp_path / "in"))
    calls = []

    def breaks(new):
        calls.append(new.count())
        raise RuntimeError("lost")

    def start(run):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        return run_requests(stream, str(tmp_path), run, "op", "now", availableNow=True)

    try:
        start(breaks).awaitTermination()
    except Exception:
        pass
    start(breaks).awaitTermination()
    assert calls == [2]
    rows = spark.read.parquet(str(tmp_path / "decisions")).collect()
    assert {r["arrival"]: r["decision"] for r in rows} == {1: "outcome_unknown", 2: "outcome_unknown"}
    assert {r["idempotency_key"]: r["disposition"] for r in read_store(spark, str(tmp_path)).collect()} == {"a": "unknown", "b": "unknown"}


def test_equal_imports_get_ids_of_their_own(spark):
    row = ("ok", "x.md", "in/1", "v", None, 2, False)
    ledger = spark.createDataFrame([("t", *row), ("t", *row), ("t", "ok", "y.md", "in/1", "v", None, 2, False)],
                                   "ts string, result string, detail string, source_path string, adapter string, conversation_id string, turns int, dry_run boolean")
    assert E.import_envelopes(ledger).select("seed").distinct().count() == 3


def test_times_of_the_shared_log_end_in_z(spark):
    row = ("2026-01-01T00:00:00.000+00:00", "ok", "x", "in/1", "v", "c", 2, False)
    ledger = spark.createDataFrame([row, ("t", *row[1:])], "ts string, result string, detail string, source_path string, adapter string, "
                                   "conversation_id string, turns int, dry_run boolean")
    assert sorted(r["occurred_at"] for r in E.import_envelopes(ledger).collect()) == ["2026-01-01T00:00:00.000Z", "t"]
