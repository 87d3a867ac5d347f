"""Corpora that Spark derives from the driver tables.

The tables hold no fences, headings or secrets of every kind, so a recipe adds
a heading, a paragraph and one fence to each user and assistant turn. The same
SQL text runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = """
SELECT conv_id, idx, role, label, heading, level, body, text,
  CASE WHEN role = 'system' THEN text ELSE
    text || chr(10) || chr(10) || repeat('#', level) || ' ' || heading || chr(10) || chr(10)
    || 'Runs step ' || idx || '.' || chr(10) || chr(10)
    || repeat(chr(96), 3) || label || chr(10) || body
    || CASE WHEN body = '' THEN '' ELSE chr(10) END || repeat(chr(96), 3)
  END AS content_md
FROM (
  SELECT *, CASE
      WHEN k = 23 THEN ''
      WHEN k < 4 THEN '#!/usr/bin/env bash' || chr(10) || '# restart service ' || (conv_id % 5)
        || chr(10) || 'sudo systemctl restart svc' || (conv_id % 5)
      WHEN k < 6 THEN 'import os' || chr(10) || 'os.system("ls ' || (conv_id % 5) || '")'
      WHEN k < 9 THEN '#Requires -RunAsAdministrator' || chr(10) || 'Remove-Item C:/t'
        || (conv_id % 5) || ' -Recurse -Force'
      WHEN k < 15 THEN CASE WHEN conv_id % 2 = 0 THEN 'DELETE FROM sessions'
        ELSE 'SELECT (1) FROM t WHERE a = ' || conv_id END || ';'
      WHEN k = 15 THEN 'Summarize {ticket} for {{ team }} and ' || chr(36) || '{HOME}.'
      WHEN k < 19 THEN '# Runbook ' || (conv_id % 5) || chr(10) || chr(10) || '1. Check.'
      ELSE 'x: ' || conv_id END AS body
  FROM (
    SELECT conv_id, turn + 1 AS idx, role, text, (conv_id * 7 + turn) % 24 AS k,
      CAST(2 + (turn + 1) % 2 AS INT) AS level,
      CASE WHEN (conv_id + turn) % 3 = 0 THEN 'Shared tool'
           ELSE split_part(replace(text, chr(10), ' '), ' ', 1) || ' '
             || split_part(replace(text, chr(10), ' '), ' ', 2) END AS heading,
      CASE (conv_id * 7 + turn) % 24
        WHEN 0 THEN 'bash' WHEN 1 THEN 'sh' WHEN 2 THEN 'shell' WHEN 3 THEN 'zsh'
        WHEN 4 THEN 'python' WHEN 5 THEN 'py' WHEN 6 THEN 'powershell' WHEN 7 THEN 'pwsh'
        WHEN 8 THEN 'ps1' WHEN 9 THEN 'sql' WHEN 10 THEN 'postgres' WHEN 11 THEN 'postgresql'
        WHEN 12 THEN 'mysql' WHEN 13 THEN 'sqlite' WHEN 14 THEN 'tsql' WHEN 15 THEN 'prompt'
        WHEN 16 THEN 'markdown' WHEN 17 THEN 'md' WHEN 18 THEN 'runbook' WHEN 19 THEN 'console'
        WHEN 20 THEN 'terminal' WHEN 21 THEN 'yaml' WHEN 22 THEN '' ELSE 'bash' END AS label
    FROM conversations
  ) t
) b
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run a recipe over the parquet tables it names; ``sha256`` as DuckDB has it."""
    if "sha256(" in sql:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sha256(x STRING) RETURNS STRING "
                  "RETURN sha2(x, 256)")
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet` {name}")
        sql = sql.replace(f"JOIN {name}", f"JOIN parquet.`{sf_dir}/{name}.parquet` {name}")
    return spark.sql(sql)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn rows of the derived conversations, as an importer hands them over."""
    return derived(spark, sf_dir, TURNS, "conversations").select(
        F.col("conv_id").alias("doc_key"), "idx", "role", "content_md",
        F.lit(None).cast("string").alias("ts"),
    )
