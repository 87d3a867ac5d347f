"""Extraction from quotes, lists and HTML over whole turns of the conversations.

Every turn becomes a Markdown document whose fence holds the whole text of the turn, in one
of eight shapes. The recipe writes the shapes line by line, so its twins know what a reader of the
format must find: the body without the prefixes of its containers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill.operators import extract as X
from snipmill.operators import verify as V
from snipmill.plans.corpus import derived

# Shapes: 0 quote, 1 nested item, 2 wide item, 3 HTML in front, 4 quote in an item, 5 ordered list in front,
# 6 link definition in front, 7 quote that ends before its fence. ``lines`` is the whole turn.
_SHAPES = """
SELECT conv_id * 1000 + turn AS doc_key, (conv_id + turn) % 8 AS shape, conv_id, turn, lines, repeat(chr(96), 4) AS mark, chr(10) AS nl
FROM (SELECT conv_id, turn, replace(coalesce(text, ''), chr(13), '') AS lines FROM conversations) t
"""
NESTED = f"""
SELECT doc_key, shape, turn, lines, CASE shape
  WHEN 0 THEN '> ## Quoted ' || turn || nl || '>' || nl || '> Says it.' || nl || '>' || nl || '> ' || mark || 'sql' || nl
    || '> ' || replace(lines, nl, nl || '> ') || nl || '> ' || mark
  WHEN 1 THEN '# Top' || nl || '- outer' || nl || nl || '  1. inner ' || turn || nl || nl || '     ' || mark || 'python' || nl
    || '     ' || replace(lines, nl, nl || '     ') || nl || '     ' || mark || nl
  WHEN 2 THEN '10.   ### Wide' || nl || nl || '      ' || mark || 'bash' || nl
    || '      ' || replace(lines, nl, nl || '      ') || nl || '      ' || mark
  WHEN 3 THEN '<div>' || nl || '# Hidden' || nl || mark || 'sh' || nl || 'hidden' || nl || mark || nl || '</div>' || nl || nl
    || 'After html.' || nl || nl || mark || 'sh' || nl || lines || nl || mark
  WHEN 4 THEN '- > ## Inside' || nl || '  >' || nl || '  > ~~~~yaml' || nl || '  > ' || replace(lines, nl, nl || '  > ') || nl || '  > ~~~~'
  WHEN 5 THEN '1. First step' || nl || '2. Second step.' || nl || '3. Third step' || nl || nl || mark || 'bash' || nl || lines || nl || mark
  WHEN 6 THEN 'Runs it.' || nl || nl || '[x]: http://e/x ' || chr(34) || 'T' || chr(34) || nl || nl || mark || 'sql' || nl || lines || nl || mark
  ELSE '> ' || mark || 'sh' || nl || '> ' || replace(lines, nl, nl || '> ') || nl || 'plain after' || nl || nl || mark || nl || 'second' || nl || mark
  END AS text
FROM ({_SHAPES}) s
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, NESTED, "conversations").select("doc_key", "text")


def _fences(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return X.document_fences(_documents(spark, sf_dir), **options)


def nested_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fences(spark, sf_dir).select("doc_key", "fence_no", "lang_raw", "body", "line_start", "line_end", "closed")


def nested_heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fences(spark, sf_dir).select("doc_key", "fence_no", F.array_join("heading_path", " / ").alias("heading_path"))


def nested_paragraph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fences(spark, sf_dir, whole_paragraphs=True).select("doc_key", "fence_no", "para")


def nested_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.candidate_description(_fences(spark, sf_dir)).select("doc_key", "fence_no", "description")


def nested_unlabeled_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lint over runbooks whose body is such a document."""
    docs = _documents(spark, sf_dir).select(
        F.col("doc_key").alias("ref"), F.concat(F.lit("---\nkind: runbook\n---\n"), "text").alias("text"))
    return V.lint_unlabeled_fences(docs).select("ref", "status", "detail")


QUERIES = {
    "nested_fences": nested_fences,
    "nested_heading_path": nested_heading_path,
    "nested_paragraph_context": nested_paragraph_context,
    "nested_description": nested_description,
    "nested_unlabeled_fences": nested_unlabeled_fences,
}

_FOUND = f"""
WITH shaped AS (SELECT *, len(string_split(lines, nl)) AS n FROM ({_SHAPES})),
fences AS (
  SELECT doc_key, 1 AS fence_no, ['sql', 'python', 'bash', 'sh', 'yaml', 'bash', 'sql', 'sh'][shape + 1] AS lang_raw,
    lines || nl AS body, [5, 6, 3, 10, 3, 5, 5, 1][shape + 1] AS line_start, n + CASE shape WHEN 7 THEN 1 ELSE 2 END AS height,
    shape <> 7 AS closed, ['Quoted ' || turn, 'Top', 'Wide', '', 'Inside', '', '', ''][shape + 1] AS heading_path,
    ['Says it.', 'inner ' || turn, NULL, 'After html.', NULL, 'Third step', 'Runs it.', NULL][shape + 1] AS para
  FROM shaped
  UNION ALL
  SELECT doc_key, 2, NULL, 'second' || nl, n + 4, 3, TRUE, '', 'plain after' FROM shaped WHERE shape = 7)
"""
ORACLES = {
    "nested_fences": _FOUND + """
        SELECT doc_key, CAST(fence_no AS INT) AS fence_no, lang_raw, body, CAST(line_start AS INT) AS line_start,
          CAST(line_start + height - 1 AS INT) AS line_end, closed FROM fences""",
    "nested_heading_path": _FOUND + "SELECT doc_key, CAST(fence_no AS INT) AS fence_no, heading_path FROM fences",
    "nested_paragraph_context": _FOUND + "SELECT doc_key, CAST(fence_no AS INT) AS fence_no, para FROM fences",
    "nested_description": _FOUND + """
        SELECT doc_key, CAST(fence_no AS INT) AS fence_no,
          coalesce(upper(left(para, 1)) || para[2:], heading_path) AS description FROM fences""",
    "nested_unlabeled_fences": _FOUND + """
        SELECT doc_key AS ref, CASE WHEN bool_or(lang_raw IS NULL) THEN 'failed' ELSE 'passed' END AS status,
          coalesce('code fences without a language label at lines '
            || string_agg(CASE WHEN lang_raw IS NULL THEN CAST(line_start + 3 AS VARCHAR) END, ', ' ORDER BY fence_no), '') AS detail
        FROM fences GROUP BY doc_key""",
}
