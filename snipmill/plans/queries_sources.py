"""Readers and writers over file rows that are derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill.operators import imports as I
from snipmill.operators.extract import fence_accounting
from snipmill.plans.corpus import derived, turns
from snipmill.plans.queries_emit import drafts, CONTEXT
from snipmill.plans.queries_imports import CANONICAL, TAKEN, _headers
from snipmill.operators import emit
from snipmill.session import new_folder
from snipmill.sources import files, sinks

# One export file per turn: tree-shaped, flat, broken or not an export at all.
INPUTS = """
SELECT conv_id * 8 + turn AS id, CASE (conv_id * 8 + turn) % 9 WHEN 6 THEN 'in/n' || (conv_id * 8 + turn) || '.md'
    WHEN 7 THEN 'in/n' || (conv_id * 8 + turn) || '.txt' ELSE 'in/n' || (conv_id * 8 + turn) || '.json' END AS path,
  CASE (conv_id * 8 + turn) % 9
    WHEN 0 THEN '[{"id":"a","title":"' || role || '","mapping":{"n":{"parent":null}},"current_node":"n"},{"id":"b"}]'
    WHEN 1 THEN ' [{"uuid":"a","name":"' || role || '","chat_messages":[]}]'
    WHEN 2 THEN '[{"uuid":"a"},{"chat_messages":[]},{"mapping":{}}]'
    WHEN 3 THEN '{"chat_messages":[]}' WHEN 4 THEN '[' WHEN 5 THEN '[]'
    WHEN 8 THEN '[{"mapping":{},"current_node":null,"chat_messages":[]}]'
    ELSE '# ' || role END AS text
FROM conversations
"""
LIBRARY = """
SELECT 'lib/artifacts/' || CASE p_partkey % 3 WHEN 0 THEN 'drafts' WHEN 1 THEN 'approved' ELSE 'revoked' END
  || '/' || CASE WHEN p_partkey % 4 = 3 THEN 'prompts/p' || p_partkey || '.md' ELSE 'scripts/s' || p_partkey || '.sh' END AS path,
  CASE WHEN p_partkey % 4 = 3 THEN '---' || chr(10) || 'kind: "prompt"' || chr(10)
      || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'compiled: "gen ' || p_size || '"' || chr(10) END || '---' || chr(10)
      || 'compiled: body' || chr(10)
    ELSE '#!/bin/sh' || chr(10) || CASE WHEN p_partkey % 5 = 0 THEN 'echo' || chr(10) ELSE '' END
      || '# compiled:    gen ' || p_size || '  ' || chr(10) || 'echo ' || p_name END AS text
FROM part
"""
TAG_DOCS = """
SELECT 'lib/tags-' || p_partkey || '.json' AS path, '{"schema":"tags/1","artifacts":{"scripts/s' || p_partkey
  || '.sh":{"compiled":"gen","tags":["' || lower(p_type) || '","size-' || p_size || '","' || lower(p_type) || '"]}}}' AS text
FROM part
"""
COLLECTION_DOCS = """
SELECT 'lib/collections/' || CASE WHEN p_partkey % 10 = 9 THEN 'Tmp' ELSE 'c' END || p_partkey || '.json' AS path,
  '{"schema":"collection/1","name":"c' || p_partkey || '","title":"' || p_name || '","description":"","members":['
  || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '{"ref":"scripts/a.sh","compiled":"g"},{"ref":"prompts/b.md","compiled":"'
    || p_size || '"}' END || ']}' AS text
FROM part
"""


def _bytes(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.encode("text", "UTF-8").alias("content"))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.input_rows(_bytes(derived(spark, sf_dir, INPUTS, "conversations")))


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.detect_format(_inputs(spark, sf_dir))


def scan_chat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    json_files = _inputs(spark, sf_dir).where(F.col("path").endswith(".json"))
    entries, errors = files.scan_chat_export(json_files)
    good = entries.select(F.col("export_key").alias("path"), F.col("position").cast("string").alias("what"))
    return good.unionByName(errors.select("path", F.col("error").alias("what")))


def scan_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; every seventh one has a byte that is no UTF-8."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("in/doc-"), "doc_id", F.lit(".md")).alias("path"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))))
        .otherwise(F.encode("text", "UTF-8")).alias("content"))
    docs, errors = files.markdown_rows(rows)
    good = docs.select(F.col("doc_key").alias("path"), "stem", F.md5("text").alias("digest"))
    return good.unionByName(errors.select("path", F.lit("").alias("stem"), F.col("error").alias("digest")))


def scan_canonical_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, rows, _ = I.scan_canonical(derived(spark, sf_dir, CANONICAL, "conversations"))
    return headers.join(rows, "doc_key").select("doc_key", "title", "turn_count", "idx", "role", "content_md")


def scan_library_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.library_rows(_bytes(derived(spark, sf_dir, LIBRARY, "part"))).drop("text")


def scan_registry_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = files.tag_rows(_bytes(derived(spark, sf_dir, TAG_DOCS, "part")))
    _, members = files.collection_rows(_bytes(derived(spark, sf_dir, COLLECTION_DOCS, "part")))
    return tags.select(F.lit("tag").alias("kind"), F.col("tag").alias("name"), "ref", "compiled").unionByName(
        members.select(F.lit("member").alias("kind"), "name", "ref", "compiled"))


def sink_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "transcripts")
    headers = _headers(spark, sf_dir)
    places = I.transcript_destinations(headers, derived(spark, sf_dir, TAKEN, "part"), "2026", "01")
    sinks.sink_transcripts(I.render_parts(headers, turns(spark, sf_dir)), places, folder)
    read = spark.read.schema("file string, part_no int, text string, year string, month string").parquet(folder)
    return read.groupBy("file", "year", "month").agg(
        F.count("*").alias("n_parts"), F.sum(F.length("text")).alias("chars"))


def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transcript as a Markdown file, read back whole."""
    folder = new_folder(spark, "transcript-files")
    headers = _headers(spark, sf_dir)
    places = I.transcript_destinations(headers, derived(spark, sf_dir, TAKEN, "part"), "2026", "01")
    written = sinks.sink_transcript_files(I.transcript_pieces(I.render_parts(headers, turns(spark, sf_dir))), places, folder)
    docs, _ = files.scan_markdown(spark, folder)
    read = docs.select(F.regexp_extract("doc_key", "(transcripts/.*)$", 1).alias("destination"), F.md5("text").alias("digest"),
                       F.sha2("text", 256).alias("read"))
    return read.join(written, "destination").select("destination", "n_parts", "n_bytes", "digest", (F.col("read") == F.col("sha256")).alias("whole"))


def sink_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "drafts")
    found = drafts(spark, sf_dir)
    rows = emit.render_drafts(found, CONTEXT).withColumns({
        "namespace": F.lit("library"), "renamed": F.lit(False)})
    sinks.sink_drafts(rows, folder, fence_accounting(found, rows.select("doc_key", F.lit("draft").alias("outcome"))))
    read = spark.read.schema("filename string, emitter string, content string, kind string").parquet(folder)
    return read.groupBy("kind", "emitter").agg(
        F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def sink_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as JSON lines, read back as the text they are."""
    folder = new_folder(spark, "lines")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "event_type", F.lit("é").alias("note"), F.lit(None).cast("string").alias("gone"))
    sinks.sink_events(rows, folder)
    return spark.read.text(folder).select("value")


QUERIES = {
    name: globals()[name] for name in (
        "detect_format", "scan_chat_export", "scan_markdown", "scan_canonical_transcript",
        "scan_library_artifacts", "scan_registry_tables", "sink_transcripts", "transcript_files", "sink_drafts", "sink_events",
    )
}

from snipmill.plans import queries_emit, queries_imports  # noqa: E402

ORACLES = {
    "detect_format": f"""
        WITH i AS ({INPUTS}) SELECT path, CASE id % 9 WHEN 0 THEN 'chatgpt-v1' WHEN 1 THEN 'claude-v1'
            WHEN 6 THEN 'markdown-v1' END AS adapter,
          CASE WHEN id % 9 IN (0, 1, 6) THEN NULL WHEN id % 9 = 8 THEN 'ambiguous' ELSE 'unsupported' END AS error FROM i""",
    "scan_chat_export": f"""
        WITH i AS ({INPUTS})
        SELECT path, CAST(k AS VARCHAR) AS what FROM i, (VALUES (0), (1), (2)) AS ks(k)
        WHERE (id % 9 = 0 AND k < 2) OR (id % 9 IN (1, 8) AND k = 0) OR id % 9 = 2
        UNION ALL SELECT path, CASE id % 9 WHEN 3 THEN 'top level is not an array' ELSE 'not valid JSON' END
        FROM i WHERE id % 9 IN (3, 4)""",
    "scan_markdown": """
        SELECT 'in/doc-' || doc_id || '.md' AS path, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'doc-' || doc_id END AS stem,
          CASE WHEN doc_id % 7 = 0 THEN 'not valid UTF-8' ELSE md5(text) END AS digest FROM documents""",
    "scan_canonical_transcript": f"""
        WITH c AS ({CANONICAL}) SELECT doc_key, 'ok' AS title, CAST(1 AS INT) AS turn_count, CAST(1 AS INT) AS idx,
          role, conversations.text AS content_md
        FROM c JOIN conversations ON doc_key = conv_id * 8 + turn WHERE k IN (0, 10, 11)""",
    "scan_library_artifacts": f"""
        WITH l AS ({LIBRARY}) SELECT regexp_replace(path, '^lib/artifacts/[a-z]+/', '') AS ref,
          CASE WHEN path LIKE '%/drafts/%' THEN 'draft' ELSE 'approved' END AS state, sha256(text) AS sha256,
          CASE WHEN text LIKE '---%' THEN nullif(regexp_extract(text, 'compiled: "(.*)"', 1), '')
            WHEN text NOT LIKE '%echo' || chr(10) || '#%' THEN nullif(regexp_extract(text, 'compiled: +(gen [0-9]+)', 1), '')
            END AS compiled
        FROM l WHERE path NOT LIKE '%/revoked/%'""",
    "scan_registry_tables": f"""
        SELECT DISTINCT 'tag' AS kind, unnest([lower(p_type), 'size-' || p_size]) AS name,
          'scripts/s' || p_partkey || '.sh' AS ref, 'gen' AS compiled FROM part
        UNION ALL SELECT 'member', 'c' || p_partkey, unnest(['scripts/a.sh', 'prompts/b.md']),
          unnest(['g', CAST(p_size AS VARCHAR)]) FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 10 <> 9""",
    "sink_transcripts": f"""
        WITH texts AS ({queries_imports.WHOLE_TEXTS}),
        names AS ({queries_imports.ORACLES["transcript_slug"]}),
        counts AS (SELECT conv_id AS doc_key, count(*) AS n FROM conversations GROUP BY 1)
        SELECT string_split(destination, '/')[4] AS file, '2026' AS year, '01' AS month,
          coalesce(n, 0) + 1 AS n_parts, CAST(length(text) - 1 - 2 * coalesce(n, 0) AS BIGINT) AS chars
        FROM texts JOIN names USING (doc_key) LEFT JOIN counts USING (doc_key)""",
    "transcript_files": f"""
        WITH texts AS ({queries_imports.WHOLE_TEXTS}),
        names AS ({queries_imports.ORACLES["transcript_slug"]}),
        counts AS (SELECT conv_id AS doc_key, count(*) AS n FROM conversations GROUP BY 1)
        SELECT destination, coalesce(n, 0) + 1 AS n_parts, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS digest, TRUE AS whole
        FROM texts JOIN names USING (doc_key) LEFT JOIN counts USING (doc_key)""",
    "sink_drafts": f"""
        WITH d AS ({queries_emit.ORACLES["render_drafts"]})
        SELECT CASE emitter WHEN 'prompt' THEN 'prompts' WHEN 'runbook' THEN 'runbooks' ELSE 'scripts' END AS kind,
          emitter, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM d GROUP BY ALL""",
    "sink_events": """
        SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","note":"é","gone":null}' AS value
        FROM events""",
}
