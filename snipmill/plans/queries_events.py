"""Idempotent requests and event logs over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill.operators import events as E
from snipmill.operators import idempotency
from snipmill.plans.corpus import derived, table
from snipmill.session import new_folder
from snipmill.sources import sinks
from snipmill.streaming import logs
from snipmill.streaming.requests import read_store, run_requests

# A third of the requests share one key.
REQUESTS = """
SELECT event_id AS arrival, CASE WHEN event_id % 3 = 0 THEN 'k0' ELSE 'k' || user_id END AS idempotency_key,
  'sha256:' || sha256(event_type) AS request_fingerprint FROM events
"""
STORE = """
SELECT CASE WHEN c_custkey % 4 = 1 THEN 'k' ELSE 'other' END || c_custkey AS idempotency_key, 'sha256:' || sha256(CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'view' END)
    AS request_fingerprint, 'op' AS operation_type,
  CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE 'completed' END AS disposition,
  'r' || c_custkey AS result_json, 't' AS created_at
FROM customer
"""
RESULTS = """
SELECT CASE WHEN c_custkey % 7 = 6 THEN 'none' ELSE 'k' END || c_custkey AS idempotency_key, CASE c_custkey % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'lost' ELSE 'completed' END AS status,
  'done ' || c_custkey AS result_json FROM customer
"""
IMPORTS = """
SELECT conv_id AS doc_key, 'in/' || conv_id || '.json' AS source_path, 'chat-v1' AS adapter,
  CASE WHEN conv_id % 4 <> 0 THEN 'id-' || conv_id END AS conversation_id, CAST(count(*) AS INT) AS turns
FROM conversations GROUP BY conv_id
"""
PRODUCED = """
SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'p0' ELSE 'p' || user_id END AS producer, event_type, value FROM events
"""
WRITTEN = """SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'p' ELSE 'q' END || user_id AS producer,
  user_id % 10 * 100 AS lines FROM events"""
MUTATIONS = """
SELECT o_orderkey AS request_id, CASE o_orderkey % 5 WHEN 0 THEN 'artifact.create_script_revision'
    WHEN 1 THEN 'artifact.approve_revision' WHEN 2 THEN 'artifact.publish_revision'
    WHEN 3 THEN 'artifact.withdraw_publication' ELSE 'artifact.read' END AS operation_type,
  o_orderkey % 7 <> 6 AS ok, 'act_1' AS created_by, 'now' AS occurred_at, 'art_' || o_custkey AS artifact_id,
  'rev_' || o_orderkey AS revision_id, 'pub_' || o_orderkey AS publication_id, 'apr_' || o_orderkey AS approval_id,
  'approved' AS approval_state, 'sha256:' || o_custkey AS content_hash, 'execution' AS channel
FROM orders
"""
NOW = "2026-01-01T00:00:00.000+00:00"
LEDGER_SCHEMA = (
    "schema int, event string, ts string, result string, detail string, source_path string, "
    "adapter string, conversation_id string, turns int, dry_run boolean"
)


def request_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, """SELECT conv_id, turn, 'in/' || conv_id AS path, role,
        CASE WHEN turn % 2 = 0 THEN 'c-' || conv_id END AS cid, split_part(replace(text, chr(10), ' '), ' ', 1) AS title
        FROM conversations""", "conversations")
    return rows.select("conv_id", "turn", idempotency.import_fingerprint(
        F.col("path"), F.col("role"), F.col("cid"), F.col("title")).alias("request_fingerprint"))


def operation_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, MUTATIONS, "orders")
    fields = {name: F.col(name) for name in ("revision_id", "created_by", "channel")}
    return rows.select("request_id", idempotency.operation_fingerprint(
        F.col("operation_type"), fields).alias("request_fingerprint"))


def idempotency_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idempotency.decide(derived(spark, sf_dir, REQUESTS, "events"),
                              derived(spark, sf_dir, STORE, "customer")).drop("in_batch")


def idempotency_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idempotency.settle(derived(spark, sf_dir, STORE, "customer"),
                              derived(spark, sf_dir, RESULTS, "customer"))


def _requests_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    key = F.when(F.col("event_id") % 3 == 0, "k0").otherwise(F.concat(F.lit("k"), "user_id"))
    return rows.select(
        F.col("event_id").alias("arrival"), key.alias("idempotency_key"),
        F.concat(F.lit("sha256:"), F.sha2("event_type", 256)).alias("request_fingerprint"))


def idempotency_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store a stream of requests leaves; every fifth key is refused and freed."""
    folder = new_folder(spark, "requests")

    def run(new: DataFrame) -> DataFrame:
        number = F.substring("idempotency_key", 2, 20).cast("bigint")
        return new.select(
            "idempotency_key", F.when(number % 5 == 4, "refused").otherwise("completed").alias("status"),
            F.concat(F.lit("event "), F.col("arrival").cast("string")).alias("result_json"))

    query = run_requests(_requests_stream(spark, sf_dir), folder, run, "event", NOW, availableNow=True)
    query.awaitTermination()
    return read_store(spark, folder).select(
        "idempotency_key", "request_fingerprint", "disposition", "result_json")


def _ledger(spark: SparkSession, sf_dir: str, dry_run: bool = False) -> DataFrame:
    headers = derived(spark, sf_dir, IMPORTS, "conversations")
    refused = headers.where("doc_key % 7 = 6").select("doc_key", F.lit("bearer").alias("label"))
    placed = headers.select("doc_key", F.concat(F.lit("transcripts/2026/01/c-"), "doc_key", F.lit(".md")).alias("destination"))
    return E.import_events(headers, refused, placed, F.lit(NOW), dry_run)


def import_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)


def event_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = E.import_envelopes(_ledger(spark, sf_dir)).withColumn("producer_sequence", F.lit(0))
    rows = E.event_envelope(events, F.lit("act_0"))
    return rows.select("event_type", "event_id", "operation_id", F.col("subject.kind").alias("subject_kind"),
                       F.col("subject.id").alias("subject_id"), F.col("producer.module_id").alias("module_id"),
                       "occurred_at", "payload")


def producer_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.producer_sequence(derived(spark, sf_dir, PRODUCED, "events"), derived(spark, sf_dir, WRITTEN, "events"))
    return rows.select("event_id", "producer", "producer_sequence")


def mutation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, MUTATIONS, "orders")
    return E.mutation_events(rows, rows.where("request_id % 11 = 10").select("request_id"))


def event_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines and read back as a stream."""
    folder = new_folder(spark, "log")
    rows = derived(spark, sf_dir, PRODUCED, "events").select("event_id", "producer", "event_type")
    sinks.sink_events(rows, f"{folder}/log")
    stream = logs.event_log_stream(spark, f"{folder}/log", "event_id long, producer string, event_type string")
    query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress")
             .option("path", f"{folder}/events").trigger(availableNow=True).start())
    query.awaitTermination()
    read = spark.read.schema(stream.schema).parquet(f"{folder}/events")
    return read.groupBy("producer", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def dual_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows streamed into both logs; the two must agree."""
    folder = new_folder(spark, "dual")
    _ledger(spark, sf_dir).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(LEDGER_SCHEMA).parquet(f"{folder}/in")
    logs.dual_write(stream, folder, availableNow=True).awaitTermination()
    ledger = logs.event_log_scan(spark, f"{folder}/ledger", LEDGER_SCHEMA)
    shared = logs.event_log_scan(spark, f"{folder}/shared", "event_type string, payload string")
    return ledger.select(F.lit("ledger").alias("log"), F.col("result").alias("what")).unionByName(
        shared.select(F.lit("shared").alias("log"), F.col("event_type").alias("what"))
    ).groupBy("log", "what").agg(F.count("*").alias("n"))


QUERIES = {
    name: globals()[name] for name in (
        "request_fingerprint", "operation_fingerprint", "idempotency_decision", "idempotency_state",
        "idempotency_stream", "import_events", "event_envelope", "producer_sequence", "mutation_events",
        "event_log_scan", "dual_write",
    )
}

_ASCII = ("array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN ord(c) > 127 "
          "THEN chr(92) || 'u' || printf('%04x', ord(c)) ELSE c END), '')")
_LEDGER = f"""WITH h AS ({IMPORTS}),
ledger AS (SELECT CAST(1 AS INT) AS schema, 'transcript.import' AS event, '{NOW}' AS ts,
  CASE WHEN doc_key % 7 = 6 THEN 'refused' ELSE 'ok' END AS result,
  CASE WHEN doc_key % 7 = 6 THEN 'secret:bearer' ELSE 'transcripts/2026/01/c-' || doc_key || '.md' END AS detail,
  source_path, adapter, conversation_id, turns, FALSE AS dry_run FROM h)"""
ORACLES = {
    "request_fingerprint": f"""
        SELECT conv_id, turn, 'sha256:' || sha256('{{"adapter":"' || role || '","conversation_id":'
          || CASE WHEN turn % 2 = 0 THEN '"c-' || conv_id || '"' ELSE 'null' END || ',"path":"in/' || conv_id
          || '","title":"' || {_ASCII.format("split_part(replace(text, chr(10), ' '), ' ', 1)")} || '"}}')
          AS request_fingerprint FROM conversations""",
    "operation_fingerprint": f"""
        WITH m AS ({MUTATIONS}) SELECT request_id, 'sha256:' || sha256('{{"operation_type":"' || operation_type
          || '","payload":{{"channel":"execution","created_by":"act_1","revision_id":"' || revision_id || '"}}}}')
          AS request_fingerprint FROM m""",
    "idempotency_decision": f"""
        WITH q AS ({REQUESTS}), s AS ({STORE}),
        f AS (SELECT *, first_value(request_fingerprint) OVER w AS fp, row_number() OVER w AS n FROM q
          WINDOW w AS (PARTITION BY idempotency_key ORDER BY arrival)),
        d AS (SELECT f.*, s.result_json, CASE WHEN s.idempotency_key IS NULL THEN CASE WHEN n = 1 THEN 'new'
            WHEN fp = f.request_fingerprint THEN 'replay' ELSE 'conflict' END
          WHEN s.request_fingerprint <> f.request_fingerprint THEN 'conflict'
          WHEN s.disposition = 'unknown' THEN 'outcome_unknown' ELSE 'replay' END AS decision
          FROM f LEFT JOIN s USING (idempotency_key))
        SELECT arrival, idempotency_key, request_fingerprint, decision,
          CASE WHEN decision = 'replay' THEN result_json END AS result_json FROM d""",
    "idempotency_state": f"""
        WITH s AS ({STORE}), r AS ({RESULTS})
        SELECT s.* REPLACE (CASE WHEN s.disposition = 'unknown' AND status = 'completed' THEN 'completed' ELSE disposition END AS disposition,
          CASE WHEN s.disposition = 'unknown' AND status = 'completed' THEN r.result_json ELSE s.result_json END AS result_json)
        FROM s LEFT JOIN r USING (idempotency_key) WHERE NOT (s.disposition = 'unknown' AND coalesce(status, '') = 'refused')""",
    "idempotency_stream": f"""
        WITH q AS ({REQUESTS})
        SELECT idempotency_key, arg_min(request_fingerprint, arrival) AS request_fingerprint, 'completed' AS disposition,
          'event ' || min(arrival) AS result_json FROM q
        WHERE CAST(idempotency_key[2:] AS BIGINT) % 5 <> 4 GROUP BY idempotency_key""",
    "import_events": _LEDGER + "SELECT * FROM ledger",
    "event_envelope": _LEDGER + """,
        b AS (SELECT *, '{"result":"' || result || '","detail":"' || detail || '","source_path":"' || source_path
          || '","adapter":"chat-v1","conversation_id":' || coalesce('"' || conversation_id || '"', 'null') || ',"turns":'
          || turns || ',"dry_run":false}' AS payload FROM ledger),
        e AS (SELECT *, sha256(concat_ws('|', ts, payload, row_number() OVER (PARTITION BY ts, payload))) AS seed FROM b),
        i AS (SELECT *, 'evt_0' || upper(left(sha256('evt' || seed), 25)) AS event_id,
          'op_0' || upper(left(sha256('op' || seed), 25)) AS operation_id FROM e)
        SELECT CASE result WHEN 'ok' THEN 'transcript.import_completed' ELSE 'transcript.import_refused' END AS event_type,
          event_id, operation_id, 'transcript_import_operation' AS subject_kind, operation_id AS subject_id,
          'snipmill' AS module_id, replace(ts, '+00:00', 'Z') AS occurred_at, payload FROM i""",
    "producer_sequence": f"""
        WITH p AS ({PRODUCED}), w AS ({WRITTEN})
        SELECT event_id, p.producer, row_number() OVER (PARTITION BY p.producer ORDER BY ts, event_id) - 1
          + coalesce(lines, 0) AS producer_sequence FROM p LEFT JOIN w USING (producer)""",
    "mutation_events": f"""
        WITH m AS ({MUTATIONS})
        SELECT request_id, created_by AS actor_id, occurred_at,
          CASE request_id % 5 WHEN 0 THEN 'artifact.revision_created' WHEN 1 THEN 'artifact.revision_approval_recorded'
            WHEN 2 THEN 'artifact.revision_published' ELSE 'artifact.publication_withdrawn' END AS event_type,
          CASE WHEN request_id % 5 < 2 THEN 'artifact_revision' ELSE 'publication' END AS subject_kind,
          CASE WHEN request_id % 5 < 2 THEN revision_id ELSE publication_id END AS subject_id,
          CASE request_id % 5 WHEN 0 THEN '{{"artifact_id":"' || artifact_id || '","revision_id":"' || revision_id
              || '","content_hash":"' || content_hash || '"}}'
            WHEN 1 THEN '{{"revision_id":"' || revision_id || '","approval_id":"' || approval_id || '","approval_state":"approved"}}'
            ELSE '{{"publication_id":"' || publication_id || '","revision_id":"' || revision_id || '","content_hash":"'
              || content_hash || '","channel":"execution"}}' END AS payload
        FROM m WHERE ok AND request_id % 5 <> 4 AND request_id % 11 <> 10""",
    "event_log_scan": f"""
        WITH p AS ({PRODUCED}) SELECT producer, event_type, count(*) AS n, max(event_id) AS last_id FROM p GROUP BY ALL""",
    "dual_write": _LEDGER + """
        SELECT 'ledger' AS log, result AS what, count(*) AS n FROM ledger GROUP BY ALL
        UNION ALL SELECT 'shared', CASE result WHEN 'ok' THEN 'transcript.import_completed'
          ELSE 'transcript.import_refused' END, count(*) FROM ledger GROUP BY ALL""",
}
