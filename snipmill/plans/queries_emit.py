"""Naming, rendering and check plans over the derived conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill import TOOL, fixed
from snipmill.operators import emit
from snipmill.operators.names import resolve_collisions
from snipmill.plans.compile import compile_corpus
from snipmill.plans.corpus import derived, table, turns
from snipmill.plans.queries_extract import ALIKE, FENCES, fence_bound, revised, segments
from snipmill.session import cut_lineage

CONTEXT = emit.RenderContext(compiled_at="2026-01-01T00:00:00.000+00:00")
EMITTERS = ["bash", "python", "sql", "prompt", "runbook"]  # powershell left out on purpose

# Names a library already holds; most of them clash with nothing.
TAKEN = """
SELECT DISTINCT 'library' AS namespace, 'scripts' AS kind,
  CASE WHEN p_partkey % 17 > 2 THEN 'other-' || p_partkey WHEN p_partkey % 7 < 5 THEN 'shared-tool' ELSE 'restart-service-' || (p_partkey % 5) END
  || CASE WHEN p_partkey % 13 = 0 THEN '' ELSE '-' || (p_partkey % 13 + 1) END
  || CASE p_partkey % 3 WHEN 0 THEN '.sh' WHEN 1 THEN '.sql' ELSE '.ps1' END AS filename
FROM part
"""


def taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, TAKEN, "part")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.assign_emitter(revised(spark, sf_dir), emit.enabled_rules(EMITTERS))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All emitters on; names left as proposed, so every draft stands alone."""
    rows = emit.assign_emitter(revised(spark, sf_dir)).where(F.col("reason").isNull())
    return emit.propose_filename(rows).withColumns({
        "filename": F.col("proposed_filename"),
        "source": emit.source_label(
            F.lit("chat"), F.lit("2026-01-01"), F.concat(F.lit("conv "), F.col("doc_key"))),
    })


def assign_emitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select(
        "doc_key", "fence_no", "emitter", "extension", "kind", "executable_when_approved",
        "reason", "detail",
    )


def propose_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts(spark, sf_dir).select("doc_key", "fence_no", "proposed_filename")


def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation titles as script names in one library: hot names, many clashes."""
    rows = turns(spark, sf_dir).select(
        F.lit("library").alias("namespace"), F.lit("scripts").alias("kind"),
        F.when(F.col("idx") % 2 == 0, ".sh").otherwise(".sql").alias("extension"),
        F.when(F.col("doc_key") % 3 == 0, "shared-tool").otherwise(
            F.concat(F.lit("tool"), (F.col("doc_key") % 7).cast("string"))).alias("name"),
        "doc_key", "idx",
    )
    named = resolve_collisions(rows, taken(spark, sf_dir), ["doc_key", "idx"])
    return named.select("extension", "name", "doc_key", "idx", "suffix", "final_name")


def name_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = emit.name_drafts(cut_lineage(assigned(spark, sf_dir)), taken(spark, sf_dir))
    return named.select("doc_key", "fence_no", "kind", "filename", "renamed")


def render_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.render_drafts(drafts(spark, sf_dir), CONTEXT).select(
        "doc_key", "fence_no", "emitter", "content"
    )


def find_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.concat(F.col("text"), F.lit(" {{ "), F.col("role"), F.lit(" }} {"),
                 F.col("role"), F.lit("} {x"), F.col("turn").cast("string"), F.lit("} {0} {\"a\": 1}"),
                 ).alias("body"),
    )
    return rows.select(
        "conv_id", "turn",
        F.array_join(emit.find_placeholders(F.col("body")), ",").alias("placeholders"),
    )


def plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.plan_checks(drafts(spark, sf_dir)).select(
        "doc_key", "fence_no", "emitter", "seq", "check_name", "check_kind", "required", "tool",
        F.size("argv").alias("n_argv"), F.get("argv", F.lit(3)).alias("fourth_arg"), "complete",
        F.array_join("notes", " | ").alias("notes"),
    )


def compile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dry run of a whole compile; counts of every outcome per kind and emitter."""
    out = compile_corpus(segments(spark, sf_dir), taken(spark, sf_dir), CONTEXT, enabled=EMITTERS,
                         top=fence_bound(spark, sf_dir))
    drafted = out.drafts.select(F.lit("draft").alias("outcome"), F.col("emitter").alias("what"),
                                F.length("content").alias("chars"))
    skipped = out.skipped.select(F.lit("skipped").alias("outcome"), F.col("reason").alias("what"),
                                 F.lit(0).alias("chars"))
    refused = out.refused.select(F.lit("refused").alias("outcome"), F.col("label").alias("what"),
                                 F.lit(0).alias("chars"))
    counted = out.accounting.select(F.lit("accounted").alias("outcome"), F.lit("fences").alias("what"), F.sum("fences_seen").alias("n"),
                                    F.lit(0).cast("long").alias("chars"))
    return drafted.unionByName(skipped).unionByName(refused).groupBy("outcome", "what").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars")
    ).unionByName(counted)


def fence_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a compile says of every document: fences as extracted against drafts and skips as they come out."""
    return compile_corpus(segments(spark, sf_dir), taken(spark, sf_dir), CONTEXT, enabled=EMITTERS,
                          similarity=False, top=fence_bound(spark, sf_dir)).accounting


def compile_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same compile with revisions by name only, so that SQL can follow it."""
    out = compile_corpus(segments(spark, sf_dir), taken(spark, sf_dir), CONTEXT, enabled=EMITTERS,
                         similarity=False, top=fence_bound(spark, sf_dir))
    return out.outcomes()


QUERIES = {
    "compile_by_name": compile_by_name,
    "fence_accounting": fence_accounting,
    "assign_emitter": assign_emitter,
    "propose_filename": propose_filename,
    "resolve_collisions": resolve_names,
    "name_drafts": name_drafts,
    "render_drafts": render_drafts,
    "find_placeholders": find_placeholders,
    "plan_checks": plan_checks,
    "compile_corpus": compile_all,
}

# ---- SQL twins -----------------------------------------------------------------------
_RULES = "(VALUES " + ", ".join(
    f"('{n}', '{t}', {'NULL' if l is None else repr(l)}, '{e}', {str(x).upper()}, '{k}')"
    for n, t, l, e, x, k in fixed.EMITTERS
) + ") AS rules(emitter, artifact_type, lang, extension, executable, kind)"
_ON = "r.artifact_type = rules.artifact_type AND (rules.lang IS NULL OR rules.lang = r.lang)"
_NAMES = ", ".join(f"'{n}'" for n in EMITTERS)
DRAFTS = FENCES + f""",
drafts AS (
  SELECT r.*, rules.emitter, rules.extension, rules.kind,
    CASE WHEN emitter = 'python' THEN replace(name_proposal, '-', '_') ELSE name_proposal END
      || extension AS filename, 'chat 2026-01-01 "conv ' || doc_key || '"' AS source
  FROM revised r JOIN {_RULES} ON {_ON} WHERE r.reason IS NULL)
"""


def _lines_sql(prefix: str, dialect: bool = False) -> str:
    rows = [
        ("name", "filename"), ("source", "source"),
        ("compiled", f"'{TOOL} {CONTEXT.compiled_at}'"), ("description", "description"),
        ("review", f"'{CONTEXT.review}'"),
        ("risk-flags", "CASE WHEN flags = '' THEN 'none' ELSE replace(flags, ',', ', ') END"),
        ("verify-with", f"'{fixed.FILL_IN}'"),
    ]
    if dialect:
        rows.insert(1, ("dialect", "coalesce(dialect, 'unspecified')"))
    return " || ".join(
        f"'{prefix} {key + ':':<13}' || {value} || chr(10)" for key, value in rows
    )


def _front_sql(kind: str, extra: str = "") -> str:
    def quoted(value: str) -> str:
        return f"""'"' || replace(replace({value}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"'"""

    flags = """CASE WHEN flags = '' THEN '[]' ELSE '["' || replace(flags, ',', '", "') || '"]' END"""
    rows = [
        ("kind", quoted(f"'{kind}'")), ("name", quoted("filename")), ("source", quoted("source")),
        ("compiled", quoted(f"'{TOOL} {CONTEXT.compiled_at}'")),
        ("description", quoted("description")), ("review", quoted(f"'{CONTEXT.review}'")),
        ("risk-flags", flags),
    ]
    if extra:
        rows.append(("placeholders", extra))
    rows.append(("verify-with", quoted(f"'{fixed.FILL_IN}'")))
    return "'---' || chr(10) || " + " || ".join(
        f"'{key}: ' || {value} || chr(10)" for key, value in rows
    ) + " || '---' || chr(10) || chr(10)"


_BARE = "regexp_replace(body, '^#![^\\n]*\\n', '')"
CHECK_ROWS = "(VALUES " + ", ".join(
    f"('{e}', {s}, '{n}', '{k}', {str(r).upper()}, {'NULL' if t is None else repr(t)}, {len(a)}, "
    + ("NULL" if len(a) < 4 else "'" + a[3].replace("'", "''") + "'") + ")"
    for e, s, n, k, r, t, a in fixed.CHECKS
) + ") AS c(emitter, seq, check_name, check_kind, required, tool, n_argv, fourth_arg)"

# The k-th draft of a proposal takes the k-th number not in use for it.
NAMED = DRAFTS + f""",
files AS ({TAKEN}),
queued AS (SELECT *, row_number() OVER (PARTITION BY kind, extension, name_proposal ORDER BY doc_key, fence_no) AS k
  FROM drafts WHERE emitter IN ({_NAMES})),
used AS (SELECT p.kind, p.extension, p.name_proposal, t, row_number() OVER (
    PARTITION BY p.kind, p.extension, p.name_proposal ORDER BY t) AS j
  FROM (SELECT DISTINCT kind, extension, name_proposal FROM queued) p, LATERAL (
    SELECT CAST(coalesce(nullif(regexp_extract(filename, '-([0-9]+)\\.[a-z0-9]+$', 1), ''), '1') AS INT) AS t
    FROM files WHERE kind = p.kind AND p.extension <> '.py' AND (filename = p.name_proposal || p.extension
      OR regexp_replace(filename, '-[0-9]+(\\.[a-z0-9]+)$', '\\1') = p.name_proposal || p.extension
        AND filename <> p.name_proposal || p.extension)) f),
numbered AS (SELECT p.doc_key, p.fence_no, p.kind, p.extension, p.name_proposal, k + count(j) AS n
  FROM queued p LEFT JOIN used u ON u.kind = p.kind AND u.extension = p.extension
    AND u.name_proposal = p.name_proposal AND t - j < k
  GROUP BY p.doc_key, p.fence_no, p.kind, p.extension, p.name_proposal, k),
final AS (SELECT doc_key, fence_no, kind, n, CASE WHEN extension = '.py'
    THEN replace(name_proposal || CASE WHEN n = 1 THEN '' ELSE '-' || n END, '-', '_')
    ELSE name_proposal || CASE WHEN n = 1 THEN '' ELSE '-' || n END END || extension AS filename FROM numbered)"""

_CONTENT = f"""CASE emitter
          WHEN 'bash' THEN '#!/usr/bin/env bash' || chr(10) || {_lines_sql('#')}
            || 'set -euo pipefail' || chr(10) || 'IFS=$''\\n\\t''' || chr(10) || chr(10) || {_BARE}
          WHEN 'python' THEN '#!/usr/bin/env python3' || chr(10) || {_lines_sql('#')} || chr(10) || body
          WHEN 'powershell' THEN {_lines_sql('#')} || chr(10) || body
          WHEN 'sql' THEN {_lines_sql('--', True)} || chr(10) || body
          WHEN 'prompt' THEN {_front_sql('prompt', "'[\"ticket\", \"team\"]'")} || body
          ELSE {_front_sql('runbook')} || body END"""

ORACLES = {
    "compile_corpus": NAMED.replace(FENCES, ALIKE) + f"""
        SELECT outcome, what, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
          SELECT 'draft' AS outcome, emitter AS what, length({_CONTENT}) AS chars FROM (
            SELECT d.* REPLACE (f.filename AS filename, '-' AS source) FROM drafts d JOIN final f USING (doc_key, fence_no))
          UNION ALL SELECT 'skipped', coalesce(reason, 'unsupported-emitter'), 0 FROM revised
          WHERE reason IS NOT NULL OR lang = 'powershell') GROUP BY ALL
        UNION ALL SELECT 'accounted', 'fences', count(*), 0 FROM revised""",
    "fence_accounting": FENCES + """
        SELECT doc_key, count(*) AS fences_seen, count(*) FILTER (WHERE reason IS NULL AND lang <> 'powershell') AS drafts,
          count(reason) AS skipped, count(*) FILTER (WHERE reason IS NULL AND lang = 'powershell') AS unsupported
        FROM revised GROUP BY doc_key""",
    "name_drafts": NAMED + " SELECT doc_key, fence_no, kind, filename, n > 1 AS renamed FROM final",
    "compile_by_name": NAMED + f"""
        SELECT doc_key, fence_no, 'draft' AS outcome, filename AS what FROM final
        UNION ALL SELECT doc_key, fence_no, 'skipped', coalesce(reason, 'unsupported-emitter') FROM revised
        WHERE reason IS NOT NULL OR lang = 'powershell'""",
    "assign_emitter": FENCES + f"""
        SELECT doc_key, fence_no, rules.emitter, rules.extension, rules.kind,
          coalesce(rules.executable, FALSE) AS executable_when_approved,
          CASE WHEN r.reason IS NULL AND rules.emitter IS NULL THEN 'unsupported-emitter'
            ELSE r.reason END AS reason,
          CASE WHEN r.reason IS NULL AND rules.emitter IS NULL
            THEN r.artifact_type || ': no enabled emitter' ELSE r.detail END AS detail
        FROM revised r LEFT JOIN (SELECT * FROM {_RULES} WHERE emitter IN ({_NAMES})) rules
          ON r.reason IS NULL AND {_ON}""",
    "propose_filename": DRAFTS + "SELECT doc_key, fence_no, filename AS proposed_filename FROM drafts",
    "resolve_collisions": f"""
        WITH taken AS ({TAKEN}),
        used AS (SELECT regexp_extract(filename, '(\\.[a-z]+)$', 1) AS extension,
            CAST(coalesce(nullif(regexp_extract(filename, 'shared-tool-([0-9]+)\\.', 1), ''), '1') AS INT) AS t
          FROM taken WHERE filename LIKE 'shared-tool%'),
        ranked AS (SELECT extension, t, row_number() OVER (PARTITION BY extension ORDER BY t) AS j FROM used),
        rows AS (
          SELECT CASE WHEN turn % 2 = 1 THEN '.sh' ELSE '.sql' END AS extension,
            CASE WHEN conv_id % 3 = 0 THEN 'shared-tool' ELSE 'tool' || (conv_id % 7) END AS name,
            conv_id AS doc_key, turn + 1 AS idx FROM conversations),
        placed AS (SELECT *, row_number() OVER (PARTITION BY extension, name ORDER BY doc_key, idx) AS k
          FROM rows),
        numbered AS (SELECT p.extension, p.name, doc_key, idx, k + count(j) AS n
          FROM placed p LEFT JOIN ranked r ON p.name = 'shared-tool' AND p.extension = r.extension
            AND r.t - r.j < p.k
          GROUP BY p.extension, p.name, doc_key, idx, k)
        SELECT extension, name, doc_key, idx, CAST(CASE WHEN n <= 1000 THEN n END AS INT) AS suffix,
          CASE WHEN n = 1 THEN name WHEN n <= 1000 THEN name || '-' || n END AS final_name
        FROM numbered""",
    "render_drafts": DRAFTS + f"""
        SELECT doc_key, fence_no, emitter, {_CONTENT} AS content
        FROM drafts""",
    "find_placeholders": """
        SELECT conv_id, turn, role || ',x' || turn AS placeholders FROM conversations""",
    "plan_checks": DRAFTS + f"""
        SELECT doc_key, fence_no, d.emitter, CAST(seq AS INT) AS seq, check_name, check_kind, required, tool,
          CAST(n_argv AS INT) AS n_argv,
          CASE WHEN fourth_arg = '{{dialect}}' THEN CASE dialect WHEN 'postgresql' THEN 'postgres'
            WHEN 'mysql' THEN 'mysql' WHEN 'sqlite' THEN 'sqlite' WHEN 'tsql' THEN 'tsql' ELSE 'ansi' END
            ELSE fourth_arg END AS fourth_arg,
          d.emitter <> 'powershell' AS complete,
          concat_ws(' | ',
            CASE WHEN d.emitter = 'powershell' THEN 'no required check: PowerShell can only be parsed by pwsh, which is not run here; treat as cannot-auto-verify' END,
            CASE WHEN d.emitter = 'powershell' THEN 'declares #Requires -RunAsAdministrator (not checked by parsing)' END,
            CASE WHEN d.emitter = 'sql' AND dialect IS NULL THEN 'dialect ''unspecified'' has no sqlfluff mapping; the sqlfluff parse uses ''ansi''' END,
            CASE WHEN flags <> '' THEN 'risk flags present (' || replace(flags, ',', ', ')
              || '): review these lines during manual verification' END) AS notes
        FROM drafts d JOIN {CHECK_ROWS} ON d.emitter = c.emitter""",
}
