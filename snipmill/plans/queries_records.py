"""Governed records derived from parts, line items, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill.operators import records as G
from snipmill.plans.corpus import derived


def _id(prefix: str, number: str) -> str:
    return f"'{prefix}_' || lpad(CAST({number} AS VARCHAR(30)), 26, '0')"


ACTOR = "'act_' || repeat('7', 26)"


def _entry(path: str, content: str, executable: str) -> str:
    return (
        f"""'{{"executable":{executable},"media_type":"text/x-shellscript","path":"{path}","sha256":"sha256:' """
        f"""|| sha256({content}) || '","size":' || length({content}) || '}}'"""
    )


_E1, _E2 = _entry("bin/run.sh", "c1", "true"), _entry("lib/x.sh", "c2", "false")
REVISIONS = f"""
SELECT p_partkey, id, artifact_id, artifact_type, manifest,
  'sha256:' || sha256(manifest || CASE WHEN p_partkey % 23 = 22 THEN ' ' ELSE '' END) AS content_hash FROM (
  SELECT *, '{{"artifact_id":"' || artifact_id || '","entries":[' || CASE WHEN p_partkey % 29 = 28
      THEN {_E2} || ',' || {_E1} ELSE {_E1} || ',' || {_E2} END || '],"revision_id":"' ||
      CASE WHEN p_partkey % 31 = 30 THEN artifact_id ELSE id END
      || '","schema":"record.content-manifest","schema_version":1}}' AS manifest FROM (
    SELECT p_partkey, {_id('rev', 'p_partkey')} AS id, {_id('art', 'p_partkey % 500')} AS artifact_id,
      CASE WHEN p_partkey % 11 = 10 THEN 'prompt' ELSE 'script' END AS artifact_type,
      'echo ' || p_name AS c1, 'x=' || p_size AS c2 FROM part) a) b
"""
CONTENTS = f"""
SELECT {_id('rev', 'p_partkey')} AS revision_id, 'bin/run.sh' AS path,
  'echo ' || p_name || CASE WHEN p_partkey % 19 = 18 THEN '!' ELSE '' END AS content FROM part
UNION ALL SELECT {_id('rev', 'p_partkey')}, CASE WHEN p_partkey % 17 = 16 THEN 'lib/y.sh' ELSE 'lib/x.sh' END, 'x=' || p_size
FROM part
"""
VERIFICATIONS = f"""
SELECT {_id('ver', 'l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey')} AS id, r.id AS revision_id,
  CASE WHEN l_orderkey % 41 = 40 THEN 'sha256:other' ELSE r.content_hash END AS content_hash,
  CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'N' THEN 'not_required' ELSE 'failed' END AS verification_state,
  CAST(l_shipdate AS VARCHAR(30)) AS created_at
FROM lineitem JOIN ({REVISIONS}) r ON r.p_partkey = l_partkey
"""
APPROVALS = f"""
SELECT {_id('apr', 'o_orderkey')} AS id, r.id AS revision_id, r.content_hash,
  CASE WHEN o_orderkey % 3 < 2 THEN 'approved' WHEN o_orderstatus = 'F' THEN 'revoked' ELSE 'unapproved' END AS approval_state,
  CAST(o_orderdate AS VARCHAR(30)) AS created_at
FROM orders JOIN ({REVISIONS}) r ON r.p_partkey = o_custkey
"""
PUBLICATIONS = f"""
SELECT {_id('pub', 'o_orderkey')} AS id, r.id AS revision_id,
  CASE WHEN o_orderkey % 53 = 52 THEN 'sha256:other' ELSE r.content_hash END AS content_hash,
  CASE WHEN o_orderkey % 5 = 4 THEN 'preview' ELSE 'execution' END AS channel,
  CASE WHEN o_orderkey % 7 = 6 THEN 'withdrawn' ELSE 'published' END AS publication_state,
  CAST(o_orderkey % 3 + 1 AS INT) AS record_version
FROM orders JOIN ({REVISIONS}) r ON r.p_partkey = o_custkey + CASE WHEN o_custkey % 3 = 2 THEN 1 ELSE 0 END
"""
PUBLISH = f"""
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 61 = 60 THEN 'rev_bad' ELSE {_id('rev', 'o_custkey + 7')} END AS revision_id,
  CASE WHEN o_orderkey % 37 = 36 THEN 'preview' ELSE 'execution' END AS channel,
  CASE WHEN o_orderkey % 43 = 42 THEN 'bob' ELSE {ACTOR} END AS created_by FROM orders
"""
WITHDRAW = f"""
SELECT o_orderkey AS request_id, {_id('pub', 'o_custkey')} AS publication_id, {ACTOR} AS created_by,
  CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE 'old ' || o_orderkey END AS reason FROM orders
"""
RESOLVE = f"""
SELECT l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey AS request_id,
  CASE WHEN l_orderkey % 71 = 70 THEN 'nope' ELSE {_id('pub', 'l_orderkey')} END AS publication_id
FROM lineitem
"""
ELIGIBLE = f"""
SELECT l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey AS request_id, {_id('rev', 'l_partkey')} AS revision_id,
  CASE WHEN l_orderkey % 47 = 46 THEN 'sha256:else' ELSE coalesce(r.content_hash, 'none') END AS content_hash,
  CASE WHEN l_orderkey % 59 = 58 THEN 'preview' ELSE 'execution' END AS channel,
  CASE WHEN l_linenumber % 4 = 3 THEN 'lib/x.sh' ELSE 'bin/run.sh' END AS entrypoint
FROM lineitem LEFT JOIN ({REVISIONS}) r ON r.p_partkey = l_partkey
"""
CREATE = f"""
SELECT o_orderkey AS request_id,
  CASE WHEN o_orderkey % 4 = 3 THEN {_id('art', 'o_custkey % 60')} WHEN o_orderkey % 61 = 60 THEN 'art_x' END AS artifact_id,
  CASE WHEN o_orderkey % 13 = 12 THEN '' ELSE 'T ' || o_orderkey END AS title,
  CASE WHEN o_orderkey % 17 = 16 THEN '' ELSE 'echo ' || o_orderpriority END AS content,
  CASE o_orderkey % 9 WHEN 0 THEN '../x' WHEN 1 THEN 'bin/a.sh' END AS content_path,
  CASE o_orderkey % 19 WHEN 0 THEN 'sha256:' || sha256('other') WHEN 1 THEN 'md5' END AS source_hash,
  CASE WHEN o_orderkey % 23 = 22 THEN 'rumour' END AS source_kind,
  CASE o_orderkey % 5 WHEN 0 THEN 'passed' WHEN 1 THEN CASE WHEN o_orderkey % 29 = 28 THEN 'maybe' END END AS verification_state,
  CAST(NULL AS VARCHAR(10)) AS media_type, CASE WHEN o_orderkey % 31 = 30 THEN 'me' ELSE {ACTOR} END AS created_by
FROM orders
"""
ARTIFACTS = f"""
SELECT DISTINCT CASE WHEN o_custkey % 60 % 10 = 9 THEN {_id('art', 'o_custkey % 60 + 100')}
    ELSE {_id('art', 'o_custkey % 60')} END AS id,
  CASE WHEN o_custkey % 60 % 6 = 5 THEN 'archived' ELSE 'active' END AS lifecycle
FROM orders
"""
BOUND = f"""
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 53 = 52 THEN 'rev_1' ELSE {_id('rev', 'o_custkey * 2')} END AS revision_id,
  CASE WHEN o_orderkey % 47 = 46 THEN 'act_' ELSE {ACTOR} END AS created_by,
  CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'why' END AS reason,
  CASE o_orderkey % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'unsure' END AS verification_state,
  CASE o_orderkey % 3 WHEN 0 THEN 'revoked' WHEN 1 THEN 'gone' END AS approval_state FROM orders
"""
IDS = f"""
SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 5 = 4 THEN 'rev' ELSE 'art' END AS prefix,
  CASE o_orderkey % 4 WHEN 0 THEN 'art_' || repeat('U', 26) WHEN 1 THEN 'art_123' ELSE {_id('art', 'o_orderkey')} END AS record_id,
  CASE o_orderkey % 3 WHEN 0 THEN upper('sha256:' || sha256(o_orderpriority)) ELSE 'sha256:' || sha256(o_orderpriority) END AS content_hash,
  CASE o_orderkey % 9 WHEN 0 THEN '../x' WHEN 1 THEN 'a/../b' WHEN 2 THEN '/etc/passwd' WHEN 3 THEN 'a' || chr(92) || 'b'
    WHEN 4 THEN 'a//b' WHEN 5 THEN './a' WHEN 6 THEN ' a' WHEN 7 THEN '' ELSE 'bin/inventory.sh' END AS path,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS title FROM orders
"""
HISTORY = f"""
SELECT {_id('pub', 'event_id / 4')} AS id, CAST(event_id % 4 + 1 AS INT) AS record_version,
  CASE WHEN (event_id * 7 + user_id) % 5 < 3 THEN 'published' ELSE 'withdrawn' END AS publication_state FROM events
""".replace("event_id / 4", "floor(event_id / 4)").replace(
    "CAST(floor(event_id / 4) AS VARCHAR(30))", "CAST(CAST(floor(event_id / 4) AS BIGINT) AS VARCHAR(30))")
DOCS = f"""
SELECT 'store/publications/' || id || '.json' AS path, CASE WHEN o_orderkey % 11 = 10 THEN '[1]'
  WHEN o_orderkey % 13 = 12 THEN 'no json' ELSE '{{"id":"' || CASE WHEN o_orderkey % 7 = 6 THEN 'pub_x' ELSE id END
  || '","publication_state":"' || o_orderstatus || '","extra":1}}' END AS text
FROM (SELECT o_orderkey, o_orderstatus, {_id('pub', 'o_orderkey')} AS id FROM orders) o
"""
NOW = "2026-01-01T00:00:00.000000Z"


def _of(sql: str, *tables: str):
    return lambda spark, sf_dir: derived(spark, sf_dir, sql, *tables)


revisions, contents = _of(REVISIONS, "part"), _of(CONTENTS, "part")
verifications, approvals = _of(VERIFICATIONS, "lineitem", "part"), _of(APPROVALS, "orders", "part")
publications = _of(PUBLICATIONS, "orders", "part")


def verify_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.verify_manifest(revisions(spark, sf_dir), contents(spark, sf_dir))


def _governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.governance_binding(revisions(spark, sf_dir), verifications(spark, sf_dir), approvals(spark, sf_dir))


def _asked(requests: DataFrame, revs: DataFrame, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return G.asked_records(requests, revs, contents(spark, sf_dir), verifications(spark, sf_dir), approvals(spark, sf_dir))


def validate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.validate_ids(derived(spark, sf_dir, IDS, "orders"))
    return rows.select("row_id", F.array_join("violations", ",").alias("violations"))


def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "SELECT conv_id, turn, role, text FROM conversations", "conversations")
    doc = F.to_json(F.struct("conv_id", "role", "text", "turn"))
    return rows.select("conv_id", "turn", G.canonical_hash(doc).alias("content_hash"))


def _created(spark: SparkSession, sf_dir: str):
    return G.create_revisions(derived(spark, sf_dir, CREATE, "orders"), derived(spark, sf_dir, ARTIFACTS, "orders"),
                              F.lit(NOW))


def create_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _created(spark, sf_dir)[0].select(
        "request_id", "artifact_id", F.col("id").alias("revision_id"), "content_hash", "source_kind",
        F.col("entries")[0]["path"].alias("path"), F.col("entries")[0]["size"].alias("size"))


def create_revisions_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _created(spark, sf_dir)[3]


def record_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = derived(spark, sf_dir, BOUND, "orders")
    some, integrity, _ = _asked(requests, revisions(spark, sf_dir), spark, sf_dir)
    rows, refused = G.record_verification(requests, some, integrity, F.lit(NOW))
    return _bound_counts(rows, refused, "verification_state")


def record_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = derived(spark, sf_dir, BOUND, "orders")
    some, integrity, _ = _asked(requests, revisions(spark, sf_dir), spark, sf_dir)
    rows, refused = G.record_approval(requests, some, integrity, F.lit(NOW))
    return _bound_counts(rows, refused, "approval_state")


def _bound_counts(rows: DataFrame, refused: DataFrame, state: str) -> DataFrame:
    kept = rows.groupBy("revision_id", F.col(state).alias("what")).agg(F.count("*").alias("n"))
    return kept.unionByName(refused.groupBy(F.lit("refused").alias("revision_id"), F.col("code").alias("what"))
                            .agg(F.count("*").alias("n")))


def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.latest_record(verifications(spark, sf_dir)).select("revision_id", "id", "verification_state")


def governance_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governance(spark, sf_dir)


def publication_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.publication_lookup(publications(spark, sf_dir)).select("revision_id", "channel", "id", "publication_state")


def publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = derived(spark, sf_dir, PUBLISH, "orders")
    some, integrity, governance = _asked(requests, revisions(spark, sf_dir), spark, sf_dir)
    outcomes, _ = G.publish(requests, some, integrity, governance, publications(spark, sf_dir), F.lit(NOW))
    return outcomes.select("request_id", "outcome", F.col("publication_id").isNotNull().alias("has_publication"))


def _withdrawn(spark: SparkSession, sf_dir: str):
    return G.withdraw(derived(spark, sf_dir, WITHDRAW, "orders"), publications(spark, sf_dir), F.lit(NOW))


def withdraw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _withdrawn(spark, sf_dir)[0]


def withdraw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _withdrawn(spark, sf_dir)[1].select("id", "publication_state", "record_version", "withdrawal_reason")


def resolve_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = derived(spark, sf_dir, RESOLVE, "lineitem")
    pubs, some, integrity = G.asked_by_publication(
        requests, publications(spark, sf_dir), revisions(spark, sf_dir), contents(spark, sf_dir))
    rows = G.resolve_publication(requests, pubs, some, integrity)
    return rows.select("request_id", "code", "revision_id", F.length("manifest").isNotNull().alias("resolved"))


def execution_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    revs = revisions(spark, sf_dir).withColumn("entries", F.from_json(
        "manifest", "entries array<struct<path string, executable boolean>>")["entries"])
    requests = derived(spark, sf_dir, ELIGIBLE, "lineitem", "part")
    some, integrity, governance = _asked(requests, revs, spark, sf_dir)
    return G.execution_eligibility(requests, some, integrity, governance, publications(spark, sf_dir))


def lifecycle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lifecycle_audit(derived(spark, sf_dir, HISTORY, "events"))


def scan_record_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.scan_records(derived(spark, sf_dir, DOCS, "orders"), "id string, publication_state string")
    return rows.select("path", "id", "publication_state", "code")


QUERIES = {
    name: globals()[name] for name in (
        "validate_ids", "canonical_hash", "create_revisions", "create_revisions_refused", "verify_manifest",
        "record_verification", "record_approval", "latest_record", "governance_binding", "publication_lookup",
        "publish", "withdraw", "withdraw_table", "resolve_publication", "execution_eligibility",
        "lifecycle_audit", "scan_record_store",
    )
}

_FAILURE = """CASE WHEN p_partkey % 23 = 22 THEN 'manifest hash does not match'
  WHEN p_partkey % 31 = 30 THEN 'manifest identity does not match'
  WHEN p_partkey % 29 = 28 THEN 'manifest paths are not unique and sorted'
  WHEN p_partkey % 19 = 18 THEN 'content hash does not match: bin/run.sh'
  WHEN p_partkey % 17 = 16 THEN 'content is missing: lib/x.sh' END"""
_BASE = f"""WITH revisions AS (SELECT *, {_FAILURE} AS failure FROM ({REVISIONS})),
verifications AS ({VERIFICATIONS}), approvals AS ({APPROVALS}), publications AS ({PUBLICATIONS}),
v AS (SELECT * FROM verifications QUALIFY row_number() OVER (PARTITION BY revision_id ORDER BY created_at DESC, id DESC) = 1),
a AS (SELECT * FROM approvals QUALIFY row_number() OVER (PARTITION BY revision_id ORDER BY created_at DESC, id DESC) = 1),
governance AS (SELECT r.id, verification_state, approval_state,
    CASE WHEN v.content_hash <> r.content_hash THEN 'verification record is not bound to the revision'
      WHEN a.content_hash <> r.content_hash THEN 'approval record is not bound to the revision' END AS violation
  FROM revisions r LEFT JOIN v ON v.revision_id = r.id LEFT JOIN a ON a.revision_id = r.id),
current AS (SELECT * FROM publications QUALIFY row_number() OVER (PARTITION BY revision_id, channel ORDER BY id DESC) = 1)"""


def _ulid(value: str, prefix: str) -> str:
    return f"regexp_matches({value}, '^{prefix}_[0-9A-HJKMNP-TV-Z]{{26}}$')"


def _new_id(prefix: str, seed: str) -> str:
    return f"'{prefix}_0' || upper(left(sha256('{prefix}' || {seed}), 25))"


_MADE = f"""WITH q AS ({CREATE}), known AS ({ARTIFACTS}),
j AS (SELECT q.* REPLACE (coalesce(content_path, 'bin/script.sh') AS content_path,
    coalesce(source_kind, 'operator_input') AS source_kind), k.lifecycle, 'sha256:' || sha256(content) AS actual
  FROM q LEFT JOIN known k ON k.id = q.artifact_id),
c AS (SELECT *, CASE WHEN content = '' THEN 'validation_error' WHEN NOT {_ulid('created_by', 'act')} THEN 'validation_error'
    WHEN content_path = '../x' THEN 'validation_error' WHEN source_hash = 'md5' THEN 'validation_error'
    WHEN source_hash <> actual THEN 'content_hash_mismatch' WHEN source_kind = 'rumour' THEN 'validation_error'
    WHEN verification_state = 'maybe' THEN 'validation_error'
    WHEN artifact_id IS NULL AND title = '' THEN 'validation_error'
    WHEN artifact_id IS NOT NULL AND NOT {_ulid('artifact_id', 'art')} THEN 'validation_error'
    WHEN artifact_id IS NOT NULL AND lifecycle IS NULL THEN 'artifact_not_found'
    WHEN lifecycle = 'archived' THEN 'validation_error' END AS code FROM j)"""


def _bound_sql(state: str, legal: str) -> str:
    return _BASE + f""", q AS (SELECT * FROM ({BOUND})),
        j AS (SELECT q.*, {state} AS s, r.id AS rid, r.failure FROM q LEFT JOIN revisions r ON r.id = q.revision_id),
        c AS (SELECT *, CASE WHEN NOT {_ulid('revision_id', 'rev')} OR NOT {_ulid('created_by', 'act')} THEN 'validation_error'
          WHEN rid IS NULL THEN 'revision_not_found' WHEN failure IS NOT NULL THEN 'content_hash_mismatch'
          WHEN reason = '' OR s IS NULL OR s NOT IN ({legal}) THEN 'validation_error' END AS code FROM j)
        SELECT CASE WHEN code IS NULL THEN revision_id ELSE 'refused' END AS revision_id,
          coalesce(code, s) AS what, count(*) AS n FROM c GROUP BY ALL"""


ORACLES = {
    "validate_ids": f"""
        WITH q AS ({IDS}) SELECT row_id, concat_ws(',',
          CASE WHEN NOT regexp_matches(record_id, '^[a-z]+_[0-9A-HJKMNP-TV-Z]{{26}}$')
            OR string_split(record_id, '_')[1] <> prefix THEN 'id' END,
          CASE WHEN NOT regexp_matches(content_hash, '^sha256:[0-9a-f]{{64}}$') THEN 'hash' END,
          CASE WHEN path <> 'bin/inventory.sh' THEN 'path' END, CASE WHEN title = '' THEN 'title' END) AS violations
        FROM q""",
    "canonical_hash": """
        SELECT conv_id, turn, 'sha256:' || sha256('{"conv_id":' || conv_id || ',"role":"' || role || '","text":'
          || to_json(text) || ',"turn":' || turn || '}') AS content_hash
        FROM conversations""",
    "create_revisions": _MADE + f""",
        m AS (SELECT *, coalesce(artifact_id, {_new_id('art', 'request_id')}) AS art, {_new_id('rev', 'request_id')} AS rev
          FROM c WHERE code IS NULL)
        SELECT request_id, art AS artifact_id, rev AS revision_id, 'sha256:' || sha256('{{"artifact_id":"' || art
          || '","entries":[{{"executable":true,"media_type":"text/x-shellscript","path":"' || content_path
          || '","sha256":"' || actual || '","size":' || length(content) || '}}],"revision_id":"' || rev
          || '","schema":"record.content-manifest","schema_version":1}}') AS content_hash, source_kind,
          content_path AS path, CAST(length(content) AS INT) AS size FROM m""",
    "create_revisions_refused": _MADE + "SELECT request_id, code FROM c WHERE code IS NOT NULL",
    "verify_manifest": _BASE + "SELECT id, failure FROM revisions",
    "record_verification": _bound_sql(
        "verification_state", "'not_required', 'pending', 'passed', 'failed', 'expired'"),
    "record_approval": _bound_sql(
        "coalesce(approval_state, 'approved')", "'unapproved', 'approved', 'revoked'"),
    "latest_record": _BASE + "SELECT revision_id, id, verification_state FROM v",
    "governance_binding": _BASE + "SELECT * FROM governance",
    "publication_lookup": _BASE + "SELECT revision_id, channel, id, publication_state FROM current",
    "publish": _BASE + f""", q AS ({PUBLISH}),
        j AS (SELECT q.*, r.id AS rid, r.failure, g.violation, g.verification_state, g.approval_state,
            p.id AS pub, p.publication_state AS ps
          FROM q LEFT JOIN revisions r ON r.id = q.revision_id LEFT JOIN governance g ON g.id = q.revision_id
          LEFT JOIN current p ON p.revision_id = q.revision_id AND p.channel = q.channel),
        c AS (SELECT *, CASE WHEN NOT {_ulid('revision_id', 'rev')} OR NOT {_ulid('created_by', 'act')}
            OR channel <> 'execution' THEN 'validation_error' WHEN rid IS NULL THEN 'revision_not_found'
            WHEN failure IS NOT NULL THEN 'content_hash_mismatch' WHEN ps = 'published' THEN 'existing'
            WHEN ps = 'withdrawn' THEN 'publication_withdrawn' WHEN violation IS NOT NULL THEN 'security_violation'
            WHEN coalesce(verification_state, '') NOT IN ('passed', 'not_required') THEN 'verification_failed'
            WHEN coalesce(approval_state, '') <> 'approved' THEN 'approval_revoked' END AS code FROM j),
        o AS (SELECT *, row_number() OVER (PARTITION BY revision_id, code IS NULL ORDER BY request_id) AS n FROM c)
        SELECT request_id, CASE WHEN code IS NOT NULL THEN code WHEN n = 1 THEN 'published' ELSE 'existing' END AS outcome,
          code IS NULL OR code = 'existing' AS has_publication FROM o""",
    "withdraw": _BASE + f""", q AS ({WITHDRAW}),
        j AS (SELECT q.*, p.publication_state AS ps FROM q LEFT JOIN publications p ON p.id = q.publication_id),
        w AS (SELECT *, min(CASE WHEN ps = 'published' AND reason <> '' THEN request_id END)
            OVER (PARTITION BY publication_id) AS first FROM j)
        SELECT request_id, CASE WHEN ps IS NULL THEN 'artifact_not_published' WHEN ps = 'withdrawn' OR request_id > first
          THEN 'unchanged' WHEN reason = '' THEN 'validation_error' ELSE 'withdrawn' END AS outcome FROM w""",
    "withdraw_table": _BASE + f""", q AS ({WITHDRAW}),
        f AS (SELECT publication_id, arg_min(reason, request_id) AS why FROM q WHERE reason <> '' GROUP BY 1)
        SELECT p.id, CASE WHEN why IS NOT NULL THEN 'withdrawn' ELSE publication_state END AS publication_state,
          CAST(CASE WHEN publication_state = 'published' AND why IS NOT NULL THEN record_version + 1
            ELSE record_version END AS INT) AS record_version,
          CASE WHEN publication_state = 'published' THEN why END AS withdrawal_reason
        FROM publications p LEFT JOIN f ON f.publication_id = p.id""",
    "resolve_publication": _BASE + f""", q AS ({RESOLVE}),
        c AS (SELECT request_id, p.revision_id, CASE WHEN NOT {_ulid('publication_id', 'pub')} THEN 'validation_error'
            WHEN p.id IS NULL THEN 'artifact_not_published' WHEN publication_state = 'withdrawn' THEN 'publication_withdrawn'
            WHEN failure IS NOT NULL OR p.content_hash <> r.content_hash THEN 'content_hash_mismatch' END AS code
          FROM q LEFT JOIN publications p ON p.id = q.publication_id LEFT JOIN revisions r ON r.id = p.revision_id)
        SELECT request_id, code, CASE WHEN code IS NULL THEN revision_id END AS revision_id, code IS NULL AS resolved FROM c""",
    "execution_eligibility": _BASE + f""", q AS ({ELIGIBLE}),
        c AS (SELECT q.request_id, CASE WHEN r.id IS NULL THEN 'revision_not_found'
            WHEN failure IS NOT NULL OR q.content_hash <> r.content_hash THEN 'content_hash_mismatch'
            WHEN p.id IS NULL THEN 'artifact_not_published' WHEN p.publication_state = 'withdrawn' THEN 'publication_withdrawn'
            WHEN p.content_hash <> r.content_hash THEN 'content_hash_mismatch'
            WHEN violation IS NOT NULL THEN 'security_violation'
            WHEN coalesce(verification_state, '') NOT IN ('passed', 'not_required') THEN 'verification_failed'
            WHEN coalesce(approval_state, '') <> 'approved' THEN 'approval_revoked'
            WHEN artifact_type <> 'script' THEN 'unsupported_artifact_type'
            WHEN entrypoint <> 'bin/run.sh' THEN 'entrypoint_not_in_manifest' END AS code
          FROM q LEFT JOIN revisions r ON r.id = q.revision_id LEFT JOIN governance g ON g.id = q.revision_id
          LEFT JOIN current p ON p.revision_id = q.revision_id AND p.channel = q.channel)
        SELECT request_id, code IS NULL AS eligible, code FROM c""",
    "lifecycle_audit": f"""
        WITH h AS ({HISTORY}), l AS (SELECT *, lag(publication_state) OVER (PARTITION BY id ORDER BY record_version) AS prev FROM h)
        SELECT id, record_version, prev AS from_state, publication_state AS to_state FROM l
        WHERE prev = 'withdrawn' AND publication_state = 'published'""",
    "scan_record_store": f"""
        WITH d AS ({DOCS}), j AS (SELECT *, CASE WHEN text NOT LIKE '{{%' THEN NULL ELSE text END AS doc FROM d)
        SELECT path, json_extract_string(doc, '$.id') AS id, json_extract_string(doc, '$.publication_state') AS publication_state,
          CASE WHEN doc IS NULL THEN 'dependency_unavailable'
            WHEN path NOT LIKE '%/' || json_extract_string(doc, '$.id') || '.json' THEN 'security_violation' END AS code
        FROM j""",
}
