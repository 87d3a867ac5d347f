"""Append-only events: the import ledger, envelopes and producer sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import text as T
from snipmill.operators.records import new_id
from snipmill.operators.running import add_rank

MODULE = "snipmill"
EVENT_SCHEMA = "event"


def import_events(headers: DataFrame, refused: DataFrame, destinations: DataFrame, ts: Column,
                  dry_run: bool = False) -> DataFrame:
    """One ledger row per import: ``ok`` with its path, or ``refused`` with the label.

    ``headers(doc_key, source_path, adapter, conversation_id, turns)``,
    ``refused(doc_key, label)``, ``destinations(doc_key, destination)``. A dry
    run leaves no event.
    """
    rows = headers.join(refused.select("doc_key", "label"), "doc_key", "left").join(
        destinations.select("doc_key", "destination"), "doc_key", "left")
    hit = F.col("label").isNotNull()
    events = rows.select(
        F.lit(fixed.LEDGER_SCHEMA).alias("schema"), F.lit(fixed.IMPORT_EVENT).alias("event"),
        ts.alias("ts"), F.when(hit, "refused").otherwise("ok").alias("result"),
        F.when(hit, F.concat(F.lit("secret:"), "label")).otherwise(F.col("destination")).alias("detail"),
        "source_path", "adapter", "conversation_id", "turns", F.lit(dry_run).alias("dry_run"),
    )
    return events.where(F.lit(not dry_run))


def import_envelopes(ledger: DataFrame) -> DataFrame:
    """The same imports for the shared log: type, payload and a seed for ids.

    Times in UTC are spelled with ``Z`` there. The seed is the whole row, with a number among rows that are equal in all, so that no two
    events share an id.
    """
    payload = F.struct("result", "detail", "source_path", "adapter", "conversation_id", "turns", "dry_run")
    rows = ledger.withColumn("_body", F.to_json(payload, {"ignoreNullFields": "false"}))
    place = F.row_number().over(Window.partitionBy("ts", "_body").orderBy(F.lit(0)))
    return rows.select(
        T.lookup(fixed.IMPORT_EVENT_TYPES, F.col("result")).alias("event_type"),
        F.regexp_replace("ts", r"\+00:00\z", "Z").alias("occurred_at"), F.col("_body").alias("payload"),
        F.sha2(F.concat_ws("|", F.coalesce("ts", F.lit("")), "_body", place.cast("string")), 256).alias("seed"),
    )


def event_envelope(events: DataFrame, producer_id: Column) -> DataFrame:
    """Envelope of ``(event_type, occurred_at, payload, seed, producer_sequence)``.

    Optional columns ``actor_id, operation_id, request_id, correlation_id,
    subject_kind, subject_id`` keep real causes; missing ones are made from the
    seed, and the subject falls back to the operation.
    """
    def given(name: str, prefix: str | None) -> Column:
        made = new_id(prefix, F.col("seed")) if prefix else F.lit(None).cast("string")
        return F.coalesce(name, made) if name in events.columns else made

    operation = given("operation_id", "op")
    return events.select(
        F.lit(EVENT_SCHEMA).alias("schema"), F.lit(1).alias("schema_version"),
        new_id("evt", F.col("seed")).alias("event_id"), "event_type", "occurred_at",
        F.col("occurred_at").alias("recorded_at"),
        F.struct(F.lit(MODULE).alias("module_id"), producer_id.alias("instance_id")).alias("producer"),
        F.struct(F.lit("human").alias("kind"), given("actor_id", "act").alias("id")).alias("actor"),
        F.struct(
            F.coalesce(given("subject_kind", None), F.lit("transcript_import_operation")).alias("kind"),
            F.coalesce(given("subject_id", None), operation).alias("id"),
        ).alias("subject"),
        operation.alias("operation_id"), given("request_id", "req").alias("request_id"),
        given("correlation_id", "corr").alias("correlation_id"), "producer_sequence", "payload",
    )


def producer_sequence(events: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """0-based sequence per producer over ``(producer, ts, event_id)``.

    ``written(producer, lines)`` is what each log already holds. Ranks are
    counted over ranges, so one busy producer does not fill one task.
    """
    ranked = add_rank(events, ["producer"], ["ts", "event_id"], "_rank")
    if written is None:
        return ranked.withColumn("producer_sequence", F.col("_rank") - 1).drop("_rank")
    joined = ranked.join(written.select("producer", "lines"), "producer", "left")
    return joined.withColumn(
        "producer_sequence", F.col("_rank") - 1 + F.coalesce("lines", F.lit(0))
    ).drop("_rank", "lines")


def mutation_events(mutations: DataFrame, replayed: DataFrame) -> DataFrame:
    """One event per successful mutation; replays and refusals emit none.

    ``mutations(request_id, operation_type, ok, created_by, occurred_at, …)``
    carry the value columns; ``replayed(request_id)`` were answered from store.
    """
    fresh = mutations.where("ok").join(replayed.select("request_id"), "request_id", "left_anti")
    operation = F.col("operation_type")
    chains: dict[str, Column | None] = {"event_type": None, "subject_kind": None, "subject_id": None, "payload": None}
    for name, (event_type, subject, fields) in fixed.MUTATION_EVENTS.items():
        subject_id = F.col("publication_id" if subject == "publication" else "revision_id")
        payload = F.to_json(F.struct(*fields))
        for key, value in (("event_type", F.lit(event_type)), ("subject_kind", F.lit(subject)),
                           ("subject_id", subject_id), ("payload", payload)):
            held = chains[key]
            chains[key] = (F if held is None else held).when(operation == name, value)
    return fresh.select(
        "request_id", F.col("created_by").alias("actor_id"), "occurred_at",
        *[chain.alias(key) for key, chain in chains.items()],
    ).where(F.col("event_type").isNotNull())
