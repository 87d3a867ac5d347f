"""Idempotent requests: fingerprints, decisions and the state they leave.

The store is ``(idempotency_key, request_fingerprint, operation_type,
disposition, result_json, created_at)``. No key ever expires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipmill.functions import text as T
from snipmill.operators.running import join_status


def fingerprint(document: Column) -> Column:
    """``sha256:`` of JSON text in key order, with non-ASCII escaped.

    Unlike the hash of a record, which keeps non-ASCII as it is.
    """
    return F.concat(F.lit("sha256:"), F.sha2(T.ascii_json(document), 256))


def import_fingerprint(path: Column, adapter: Column, conversation_id: Column, title: Column) -> Column:
    """Fingerprint of an import request: its arguments, not the file's content."""
    return fingerprint(F.to_json(
        F.struct(adapter.alias("adapter"), conversation_id.alias("conversation_id"),
                 path.alias("path"), title.alias("title")),
        {"ignoreNullFields": "false"},
    ))


def operation_fingerprint(operation: Column, fields: dict[str, Column]) -> Column:
    """Fingerprint of a record request: its type and every field but the key.

    Request and operation ids count, so a retry under a new id conflicts.
    """
    payload = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return fingerprint(F.to_json(
        F.struct(operation.alias("operation_type"), payload.alias("payload")),
        {"ignoreNullFields": "false"},
    ))


def decide(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Decision per ``(arrival, idempotency_key, request_fingerprint)``.

    ``new``, ``replay`` (with the stored result), ``conflict`` or
    ``outcome_unknown``. Of requests that share a new key the first by arrival
    is new and the others are judged against it (``in_batch``). The first one is found by an
    aggregate that combines map-side, so a key with very many requests costs
    one small row per task.
    """
    stored = store.select(
        "idempotency_key", F.col("request_fingerprint").alias("_print"), "disposition", "result_json")
    opener = requests.where(F.col("idempotency_key").isNotNull()).groupBy("idempotency_key").agg(
        F.min(F.struct("arrival", "request_fingerprint")).alias("_first"))
    # One row for each key that is asked, then one join with the requests.
    rows = join_status(requests, opener.join(stored, "idempotency_key", "left"), ["idempotency_key"])
    own = F.col("request_fingerprint")
    unseen = F.col("_print").isNull()
    decision = (
        F.when(unseen & (F.col("_first.arrival") == F.col("arrival")), "new")
        .when(unseen & (F.col("_first.request_fingerprint") == own), "replay")
        .when(unseen, "conflict")
        .when(F.col("_print") != own, "conflict")
        .when(F.col("disposition") == "unknown", "outcome_unknown")
        .otherwise("replay")
    )
    return rows.withColumn("decision", decision).withColumn(
        "result_json", F.when(F.col("decision") == "replay", F.col("result_json"))
    ).withColumn("in_batch", unseen & (F.col("_first.arrival") != F.col("arrival"))).drop(
        "_print", "_first", "disposition")


def settle_repeats(decided: DataFrame, results: DataFrame) -> DataFrame:
    """``decided`` once the results of its new requests are known.

    A repeat within the batch has the result of the first one if that completed. After a refusal the key is
    free again: the repeat is ``released`` and may be sent anew. Otherwise its outcome is unknown.
    """
    found = results.select("idempotency_key", F.col("status").alias("_status"), F.col("result_json").alias("_result"))
    repeat = F.col("in_batch") & (F.col("decision") == "replay")
    done, refused = F.col("_status") == "completed", F.col("_status") == "refused"
    return decided.join(found, "idempotency_key", "left").withColumns({
        "result_json": F.when(repeat & done, F.col("_result")).otherwise(F.col("result_json")),
        "decision": F.when(~repeat | done, F.col("decision")).when(refused, "released").otherwise("outcome_unknown"),
    }).drop("_status", "_result", "in_batch")


def in_flight(decisions: DataFrame, operation_type: Column, created_at: Column) -> DataFrame:
    """Store rows to commit before new requests run."""
    return decisions.where(F.col("decision") == "new").select(
        "idempotency_key", "request_fingerprint", operation_type.alias("operation_type"),
        F.lit("unknown").alias("disposition"), F.lit("{}").alias("result_json"),
        created_at.alias("created_at"))


def settle(store: DataFrame, results: DataFrame) -> DataFrame:
    """The store after ``results(idempotency_key, status, result_json)``.

    A completed request keeps its result, a definite refusal is removed so the
    key is free again, anything else stays unknown.
    """
    found = results.select("idempotency_key", "status", F.col("result_json").alias("_result"))
    open_row = (F.col("disposition") == "unknown") & F.col("status").isNotNull()
    done = open_row & (F.col("status") == "completed")
    joined = store.join(found, "idempotency_key", "left")
    kept = joined.where(~F.coalesce(open_row & (F.col("status") == "refused"), F.lit(False)))
    return kept.withColumns({
        "result_json": F.when(done, F.col("_result")).otherwise(F.col("result_json")),
        "disposition": F.when(done, "completed").otherwise(F.col("disposition")),
    }).drop("status", "_result")
