"""Verification queries over artifacts derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill.operators import emit, verify
from snipmill.plans import compile as C
from snipmill.plans.corpus import derived
from snipmill.plans.queries_emit import CHECK_ROWS, CONTEXT, DRAFTS, drafts
from snipmill.session import cut_lineage

# Prompts from conversation turns: the remainders plant one fault each.
PROMPTS = """
SELECT 'prompts/p' || id || '.md' AS ref, id,
  CASE WHEN id % 11 = 10 THEN '' ELSE '---' || chr(10) END
  || 'kind: "' || CASE WHEN id % 4 = 3 THEN 'runbook' ELSE 'prompt' END || '"' || chr(10)
  || 'name: "p.md"' || chr(10) || 'source: "-"' || chr(10) || 'compiled: "c"' || chr(10)
  || CASE WHEN id % 6 = 5 THEN 'name: "again"' || chr(10) ELSE '' END
  || CASE WHEN id % 9 = 8 THEN 'tags: foo' || chr(10) ELSE '' END
  || 'description: "d"' || chr(10) || 'review: "r"' || chr(10) || 'risk-flags: []' || chr(10)
  || CASE id % 5 WHEN 4 THEN '' WHEN 3 THEN 'placeholders: ["a", 1]' || chr(10)
       ELSE 'placeholders: ["a", "b"]' || chr(10) END
  || 'verify-with: "v"' || chr(10)
  || CASE WHEN id % 8 = 7 THEN '' ELSE '---' || chr(10) END || chr(10)
  || CASE id % 3 WHEN 0 THEN text || ' {a} {{ b }}' WHEN 1 THEN '  ' || chr(10)
       ELSE text || ' {a} {c}' || chr(10) || 'TODO <insert ' || role || '>' END AS text
FROM (SELECT conv_id * 8 + turn AS id, text, role FROM conversations) c
"""
RUNBOOKS = """
SELECT 'runbooks/r' || id || '.md' AS ref, id,
  '---' || chr(10) || 'kind: "runbook"' || chr(10)
  || CASE WHEN id % 6 = 5 THEN '' ELSE '---' || chr(10) END || chr(10)
  || CASE id % 4 WHEN 0 THEN '# ' || role || chr(10) || chr(10) || text
       WHEN 1 THEN text
       WHEN 2 THEN role || chr(10) || '===' || chr(10) || chr(10) || text || chr(10) || chr(10)
         || repeat(chr(96), 3) || chr(10) || 'code' || chr(10) || repeat(chr(96), 3) || chr(10)
         || repeat(chr(96), 3) || 'sh' || chr(10) || 'code' || chr(10) || repeat(chr(96), 3)
       ELSE '' END AS text
FROM (SELECT conv_id * 8 + turn AS id, text, role FROM conversations) c
"""
SQL_FILES = """
SELECT 'scripts/q' || p_partkey || '.sql' AS ref,
  '-- name:        q.sql' || chr(10) || '-- dialect:     unspecified' || chr(10) || chr(10)
  || CASE p_partkey % 8
    WHEN 0 THEN 'SELECT ''' || p_name || '; it''''s (' || ''' FROM t WHERE (a = ' || p_size || ');'
    WHEN 1 THEN 'SELECT 1;' || chr(10) || '-- note ( ' || p_name || chr(10) || 'SELECT ' || p_size
    WHEN 2 THEN 'SELECT (1 FROM t;' WHEN 3 THEN 'SELECT 1' || chr(10) || '); SELECT 2;'
    WHEN 4 THEN 'SELECT ''' || p_name || ';' WHEN 5 THEN '/* ' || p_name || ' ; */'
    WHEN 6 THEN 'SELECT "a;b" /* ; */; DELETE FROM t; ' ELSE 'SELECT /* ' || p_name END AS text
FROM part
"""
RESULTS = """
SELECT 'scripts/a' || CAST(floor(event_id / 4) AS BIGINT) || '.sh' AS ref,
  CAST(event_id % 4 AS INT) AS seq, 'check' || (event_id % 4) AS check_name,
  event_id % 3 <> 0 AS required,
  CASE WHEN event_id % 7 = 6 THEN 'failed' WHEN event_id % 11 = 10 THEN 'not-run'
       WHEN event_id % 13 = 12 THEN 'error' ELSE 'passed' END AS status, event_type AS detail
FROM events
"""
PLANNED = """
SELECT DISTINCT 'scripts/a' || k || '.sh' AS ref, k % 5 <> 4 AS complete, k % 10 = 9 AS noted
FROM (SELECT CAST(floor(event_id / 4) AS BIGINT) AS k FROM events) e
"""
RUNS = """
SELECT 'scripts/u' || user_id || '.sh' AS ref, CAST(ts AS STRING) AS verified_at,
  'gen-' || (event_id % 3) AS compiled, sha256(event_type) AS sha256, event_type AS verdict
FROM events
"""
FILES = """
SELECT DISTINCT CASE WHEN user_id % 6 = 5 THEN 'scripts/v' ELSE 'scripts/u' END || user_id || '.sh' AS ref, 'gen-' || (user_id % 3) AS compiled,
  sha256(CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END) AS sha256
FROM events
"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PROMPTS, "conversations").drop("id")


def runbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RUNBOOKS, "conversations").drop("id")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered drafts as library files; one file per fence."""
    rows = emit.render_drafts(drafts(spark, sf_dir), CONTEXT)
    ref = F.concat("kind", F.lit("/"), F.lit("f"), F.col("doc_key"), F.lit("-"), F.col("fence_no"),
                   F.col("extension"))
    return rows.select(ref.alias("ref"), F.col("content").alias("text"), F.lit("draft").alias("state"),
                       F.lit(CONTEXT.compiled_at).alias("compiled"))


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verify.header_fields(rendered(spark, sf_dir))
    return rows.select("ref", "emitter", "dialect", F.array_join("flags", ",").alias("flags"))


def rebuild_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verify.rebuild_plan(rendered(spark, sf_dir))
    return rows.select("ref", "emitter", "seq", "check_name", "required", "complete",
                       F.size("notes").alias("n_notes"))


def lint_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.lint_front_matter(prompts(spark, sf_dir), "prompt").select("ref", "status")


def lint_prompt_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.lint_prompt_body(prompts(spark, sf_dir)).select("ref", "status")


def lint_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.lint_placeholders(prompts(spark, sf_dir)).select("ref", "status", "detail")


def lint_editorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.lint_editorial(prompts(spark, sf_dir))


def lint_runbook_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.lint_runbook_title(runbooks(spark, sf_dir)).select("ref", "status")


def lint_unlabeled_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.lint_unlabeled_fences(runbooks(spark, sf_dir)).select("ref", "status", "detail")


def sql_lexical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verify.sql_lexical_profile(derived(spark, sf_dir, SQL_FILES, "part"))
    return rows.select("ref", "status", "statements")


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, PLANNED, "events")
    return rows.withColumn("notes", F.when(F.col("noted"), F.array(F.lit("needs a tool"))).otherwise(
        F.array().cast("array<string>")))


def decide_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verify.decide_verdict(derived(spark, sf_dir, RESULTS, "events"), _planned(spark, sf_dir))
    return rows.select("ref", "verdict", F.array_join("reasons", " | ").alias("reasons"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RUNS, "events")


def record_verification_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.record_verification_run(_runs(spark, sf_dir)).select("ref", "compiled", "verdict")


def verification_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verify.verification_freshness(
        verify.record_verification_run(_runs(spark, sf_dir)), derived(spark, sf_dir, FILES, "events")
    )
    return rows.select("ref", "verdict", "fresh")


def verify_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cut_lineage(rendered(spark, sf_dir))  # every check reads the files
    rows = C.verify_corpus(files, "2026-01-02T00:00:00.000+00:00")
    return rows.select("ref", "emitter", "verdict", F.array_join("reasons", " | ").alias("reasons"))


QUERIES = {
    "header_fields": header_fields,
    "rebuild_plan": rebuild_plan,
    "lint_front_matter": lint_front_matter,
    "lint_prompt_body": lint_prompt_body,
    "lint_placeholders": lint_placeholders,
    "lint_editorial": lint_editorial,
    "lint_runbook_title": lint_runbook_title,
    "lint_unlabeled_fences": lint_unlabeled_fences,
    "sql_lexical_profile": sql_lexical_profile,
    "decide_verdict": decide_verdict,
    "record_verification_run": record_verification_run,
    "verification_freshness": verification_freshness,
    "verify_corpus": verify_corpus,
}

_REF = "kind || '/f' || doc_key || '-' || fence_no || extension"
_PROMPT = f"WITH p AS ({PROMPTS}), q AS (SELECT *, id % 11 = 10 AS bare, id % 8 = 7 AND id % 11 <> 10 AS open FROM p)"
_BOOK = f"WITH r AS ({RUNBOOKS}), q AS (SELECT *, id % 6 = 5 AS open FROM r)"
_OPEN = "'front matter opened on line 1 is never closed with a ''---'' line'"
_PLAIN = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '''[^'']*''', 'x', 'g'), '\"[^\"]*\"', 'x', 'g'),"
          " '--[^\\n]*', '', 'g'), '/\\*.*?\\*/', '', 'g')")
ORACLES = {
    "header_fields": DRAFTS + f"SELECT {_REF} AS ref, emitter, dialect, flags FROM drafts",
    "rebuild_plan": DRAFTS + f"""
        SELECT {_REF} AS ref, d.emitter, CAST(c.seq AS INT) AS seq, c.check_name, c.required,
          d.emitter <> 'powershell' AS complete,
          CAST(CASE d.emitter WHEN 'powershell' THEN 2 WHEN 'sql' THEN CASE WHEN dialect IS NULL THEN 1 ELSE 0 END
            ELSE 0 END + CASE WHEN flags <> '' THEN 1 ELSE 0 END AS INT) AS n_notes
        FROM drafts d JOIN {CHECK_ROWS} ON d.emitter = c.emitter""",
    "lint_front_matter": _PROMPT + """
        SELECT ref, CASE WHEN bare OR open OR id % 4 = 3 OR id % 6 = 5 OR id % 9 = 8 OR id % 5 >= 3
          THEN 'failed' ELSE 'passed' END AS status FROM q""",
    "lint_prompt_body": _PROMPT + """
        SELECT ref, CASE WHEN open OR (id % 3 = 1 AND NOT bare) THEN 'failed' ELSE 'passed' END AS status
        FROM q""",
    "lint_placeholders": _PROMPT + f"""
        SELECT ref, CASE WHEN detail = '' THEN 'passed' ELSE 'failed' END AS status, detail FROM (
          SELECT ref, CASE WHEN open THEN {_OPEN}
            WHEN bare OR id % 5 >= 3 THEN 'no `placeholders` list of strings'
            WHEN id % 3 = 0 THEN ''
            WHEN id % 3 = 1 THEN 'declared but unused placeholders: a, b'
            ELSE 'undeclared placeholders: c; declared but unused placeholders: b; editorial fill-ins remain: '
              || '''TODO'' (line ' || n || '), ''<insert ' || role || '>'' (line ' || n || ')' END AS detail
          FROM (SELECT q.*, role, len(string_split(q.text, chr(10))) AS n
                FROM q JOIN conversations ON q.id = conv_id * 8 + turn))""",
    "lint_editorial": _PROMPT + """
        SELECT ref, CAST(k AS INT) AS fill_no, CASE k WHEN 0 THEN '''TODO''' ELSE '''<insert ' || role || '>''' END
          || ' (line ' || len(string_split(q.text, chr(10))) || ')' AS fill
        FROM q JOIN conversations ON q.id = conv_id * 8 + turn, (VALUES (0), (1)) AS ks(k)
        WHERE q.id % 3 = 2 AND NOT open""",
    "lint_runbook_title": _BOOK + """
        SELECT ref, CASE WHEN open OR id % 4 IN (1, 3) THEN 'failed' ELSE 'passed' END AS status FROM q""",
    "lint_unlabeled_fences": _BOOK + f"""
        SELECT ref, CASE WHEN detail = '' THEN 'passed' ELSE 'failed' END AS status, detail FROM (
          SELECT ref, CASE WHEN open THEN {_OPEN} WHEN id % 4 <> 2 THEN ''
            ELSE 'code fences without a language label at lines ' || (len(string_split(text, chr(10))) - 5)
            END AS detail FROM q)""",
    "sql_lexical_profile": f"""
        WITH s AS ({SQL_FILES}), plain AS (SELECT ref, text, {_PLAIN} AS body FROM s),
        m AS (SELECT *, length(body) - length(replace(body, '(', '')) AS n_open,
          length(body) - length(replace(body, ')', '')) AS n_close,
          regexp_matches(body, '''') OR body LIKE '%/*%' AS unclosed FROM plain)
        SELECT ref, CASE WHEN unclosed OR n_open <> n_close OR NOT regexp_matches(body, ';\\s*$')
            THEN 'failed' ELSE 'passed' END AS status,
          CAST(CASE WHEN n_close > n_open OR unclosed THEN 0
            ELSE len(list_filter(string_split(regexp_replace(body, '[^;]*$', ''), ';'), lambda x: trim(x, chr(10) || ' ') <> ''))
            END AS INT) AS statements FROM m""",
    "decide_verdict": f"""
        WITH r AS ({RESULTS}), p AS ({PLANNED}),
        a AS (SELECT ref, count(*) FILTER (WHERE required) AS n,
            string_agg('required check ' || check_name || ' failed', ' | ' ORDER BY seq)
              FILTER (WHERE required AND status = 'failed') AS failed,
            string_agg('required check ' || check_name || CASE status WHEN 'not-run' THEN ' did not run: '
              ELSE ' errored: ' END || detail, ' | ' ORDER BY seq)
              FILTER (WHERE required AND status IN ('not-run', 'error')) AS unclear
          FROM r GROUP BY ref),
        d AS (SELECT p.ref, n, failed, nullif(concat_ws(' | ',
            CASE WHEN NOT complete THEN 'plan is incomplete: cannot auto-verify'
              || CASE WHEN noted THEN ' (needs a tool)' ELSE '' END END,
            CASE WHEN n = 0 THEN 'plan has no required check' END, unclear), '') AS doubts
          FROM p LEFT JOIN a USING (ref))
        SELECT ref, CASE WHEN failed IS NOT NULL THEN 'failed' WHEN doubts IS NOT NULL THEN 'inconclusive'
            ELSE 'passed' END AS verdict,
          coalesce(failed, doubts, 'all ' || n || ' required check(s) passed') AS reasons FROM d""",
    "verify_corpus": DRAFTS + f"""
        SELECT {_REF} AS ref, emitter,
          CASE WHEN emitter IN ('bash', 'python', 'powershell') THEN 'inconclusive' ELSE 'passed' END AS verdict,
          CASE emitter WHEN 'bash' THEN 'required check bash-syntax did not run: no result for this check'
              || ' | required check shellcheck did not run: no result for this check'
            WHEN 'python' THEN 'required check python-ast-parse did not run: no result for this check'
            WHEN 'powershell' THEN 'plan is incomplete: cannot auto-verify (no required check: PowerShell can only be '
              || 'parsed by pwsh, which is not run here; treat as cannot-auto-verify) | plan has no required check'
            WHEN 'sql' THEN 'all 1 required check(s) passed' ELSE 'all 3 required check(s) passed' END AS reasons
        FROM drafts""",
    "record_verification_run": f"""
        WITH r AS ({RUNS}) SELECT ref, arg_max(compiled, verified_at || sha256) AS compiled,
          arg_max(verdict, verified_at || sha256) AS verdict FROM r GROUP BY ref""",
    "verification_freshness": f"""
        WITH r AS ({RUNS}), f AS ({FILES}),
        l AS (SELECT ref, max_by(compiled, verified_at || sha256) AS compiled,
          max_by(verdict, verified_at || sha256) AS verdict,
          max_by(sha256, verified_at || sha256) AS sha256 FROM r GROUP BY ref)
        SELECT l.ref, verdict, CASE WHEN f.ref IS NULL THEN 'missing'
          WHEN f.compiled = l.compiled AND f.sha256 = l.sha256 THEN 'fresh' ELSE 'stale' END AS fresh
        FROM l LEFT JOIN f USING (ref)""",
}
