"""Queries over planted secrets in ``documents``, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.operators import refuse
from snipmill.operators.extract import turn_segments
from snipmill.plans.corpus import table
from snipmill.sources.files import scan_pattern_table as read_patterns

KV = r"(?i)\b(password|passwd|pwd|token|secret|api[_-]?key)\b(\s*[=:]\s*)(\S+)"
LITERAL = """(bare <> '' AND NOT regexp_matches(bare, '^[$({<`]') AND bare NOT LIKE '"$%'
  AND bare NOT LIKE '''$%' AND NOT regexp_matches(lower(bare),
  'xxx|your|changeme|change_me|example|placeholder|redacted|dummy|todo|\\.\\.\\.')
  AND regexp_full_match(bare, '[A-Za-z0-9+/_.=-]{12,}'))"""
MATCHES = f"""
matches AS (
  SELECT doc_id, i - 1 AS match_no, found[i] AS value, whole[i] AS whole, text,
    trim(trim(trim(found[i]), '"'), '''') AS bare, {{extra}}
  FROM (SELECT doc_id, text, source, regexp_extract_all(text, '{KV}', 3) AS found,
          regexp_extract_all(text, '{KV}', 0) AS whole FROM documents) d,
       LATERAL (SELECT unnest(generate_series(1, len(found))) AS i) n)
"""
HITS = "WITH " + MATCHES.format(extra="source") + f""",
hits AS (
  SELECT doc_id, arg_min(whole, match_no) AS first, any_value(text) AS text
  FROM matches WHERE {LITERAL} GROUP BY doc_id)
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc_key")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refuse.secret_scan(_docs(spark, sf_dir))


def kv_literal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refuse.kv_literals(_docs(spark, sf_dir))


def refuse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = refuse.refuse_documents(_docs(spark, sf_dir))
    return accepted.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars")
    )


def _document_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven documents in a row read as the turns of one conversation."""
    return _docs(spark, sf_dir).select(
        F.floor(F.col("doc_key") / 7).alias("doc_key"), (F.col("doc_key") % 7 + 1).alias("idx"),
        F.lit("assistant").alias("role"), F.col("text").alias("content_md"),
        F.lit(None).cast("string").alias("ts"),
    )


def refuse_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = turn_segments(_document_turns(spark, sf_dir))
    return refuse.segment_secrets(segments)


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    redacted = refuse.redact_text(_docs(spark, sf_dir))
    return redacted.select("doc_key", F.md5("text").alias("digest"),
                           F.length("text").alias("n_chars"))


def redact_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _docs(spark, sf_dir).select(
        "doc_key",
        F.struct(
            "lang", F.array("text", "source").alias("parts"),
            F.create_map(F.lit("token"), F.col("text")).alias("fields"), "n_chars",
        ).alias("payload"),
    )
    clean = refuse.redact_nested(nested, "payload")
    return clean.select(
        "doc_key", F.col("payload.lang").alias("lang"),
        F.md5(F.col("payload.parts")[0]).alias("part_digest"),
        F.col("payload.parts")[1].alias("source"),
        F.md5(F.element_at("payload.fields", "token")).alias("field_digest"),
        F.col("payload.n_chars").alias("n_chars"),
    )


PATTERN_FILE = """
[patterns]
broken = "("
marked = "MODULE|\\\\bheron"
long-run = "[a-z]{14,}"
"""


def scan_pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scanned with a pattern file instead of the built-in table."""
    patterns = read_patterns(PATTERN_FILE, fixed.SECRET_PATTERNS, "(?is)")
    return refuse.secret_scan(_docs(spark, sf_dir), patterns)


QUERIES = {
    "scan_pattern_table": scan_pattern_table,
    "secret_scan": secret_scan,
    "kv_literal_filter": kv_literal_filter,
    "refuse_documents": refuse_documents,
    "refuse_conversations": refuse_conversations,
    "redact_text": redact_text,
    "redact_nested": redact_nested,
}

_LINE = "len(string_split(text[:strpos(text, first)], chr(10)))"
_REDACTED = (
    r"regexp_replace(text, '(?i)\b(password|passwd|pwd|token|secret|api[_-]?key)\b"
    r"(\s*[=:]\s*)\S*(\S{4})', '\1\2[REDACTED:kv-secret:\3]', 'g')"
)
ORACLES = {
    "scan_pattern_table": """
        WITH m AS (SELECT doc_id, text, regexp_extract(text, '(?is)^(.*?)(?:MODULE|\\bheron)', 1) AS a,
            regexp_matches(text, '(?is)MODULE|\\bheron') AS ha, regexp_extract(text, '(?is)^(.*?)[a-z]{14,}', 1) AS b,
            regexp_matches(text, '(?is)[a-z]{14,}') AS hb FROM documents)
        SELECT doc_id AS doc_key, CASE WHEN ha THEN 'marked' ELSE 'long-run' END AS label,
          CAST(len(string_split(CASE WHEN ha THEN a ELSE b END, chr(10))) AS INT) AS line FROM m WHERE ha OR hb""",
    "secret_scan": HITS + f"""
        SELECT doc_id AS doc_key, 'kv-secret' AS label, CAST({_LINE} AS INT) AS line FROM hits""",
    "kv_literal_filter": "WITH " + MATCHES.format(extra="source") + f"""
        SELECT doc_id AS doc_key, CAST(match_no AS INT) AS match_no, value,
          {LITERAL} AS is_literal FROM matches""",
    "refuse_documents": HITS + """
        SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars
        FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits) GROUP BY source""",
    "refuse_conversations": HITS + f""",
        based AS (
          SELECT doc_id, 11 + coalesce(sum(len(string_split(trim(text, chr(10)), chr(10))) + 2) OVER (
            PARTITION BY doc_id // 7 ORDER BY doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM documents)
        SELECT doc_id // 7 AS doc_key, 'kv-secret' AS label,
          CAST(min(base + 1 + {_LINE}) AS INT) AS line
        FROM hits JOIN based USING (doc_id) GROUP BY 1""",
    "redact_text": f"""
        SELECT doc_id AS doc_key, md5(r) AS digest, CAST(length(r) AS INT) AS n_chars
        FROM (SELECT doc_id, {_REDACTED} AS r FROM documents)""",
    "redact_nested": f"""
        SELECT doc_id AS doc_key, lang, md5(r) AS part_digest, source, md5(r) AS field_digest,
          n_chars FROM (SELECT *, {_REDACTED} AS r FROM documents)""",
}
