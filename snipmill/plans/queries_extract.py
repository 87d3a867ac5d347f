"""Extraction queries over the derived conversations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import text as T
from snipmill.operators import extract as X
from snipmill.operators.revisions import revision_groups as groups_of
from snipmill.plans.corpus import TURNS, derived, table, turns

FRONTED = """
SELECT doc_id AS doc_key, CASE doc_id % 3
  WHEN 0 THEN '---' || chr(10) || 'kind: note' || chr(10) || 'id: ' || doc_id || chr(10) || '---' || chr(10)
  WHEN 1 THEN '---' || chr(10) || 'k: v' || chr(10) || '...' || chr(10)
  ELSE '' END || text AS text
FROM documents
"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.turn_segments(turns(spark, sf_dir), fence_bound(spark, sf_dir))


def fences(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    top = fence_bound(spark, sf_dir)
    return X.extract_fences(X.turn_segments(turns(spark, sf_dir), top), top=top, **options)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.candidates(fences(spark, sf_dir), fixed.LANGUAGES)


def fence_bound(spark: SparkSession, sf_dir: str) -> int:
    """Highest turn number; also bounds fence numbers, as a turn has one fence here."""
    return X.top_position(table(spark, sf_dir, "conversations"), "turn") + 1


def revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.supersede_by_name(found(spark, sf_dir), top=fence_bound(spark, sf_dir))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of all bodies, as a library holds them; in ten of eleven conversations the library's body goes on."""
    bodies = derived(spark, sf_dir, TURNS, "conversations")
    more = F.when(F.col("conv_id") % 11 == 0, "").otherwise("\n# changed since")
    return bodies.select(T.content_hash(F.concat("body", more)).alias("sha256"))


def strip_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = X.strip_front_matter(derived(spark, sf_dir, FRONTED, "documents"))
    return segments.select("doc_key", "line_base", F.md5("text").alias("digest"))


def turn_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.turn_markers(segments(spark, sf_dir))


def turn_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fences(spark, sf_dir).select("doc_key", "fence_no", "turn", "role")


def extract_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fences(spark, sf_dir).select(
        "doc_key", "fence_no", "lang_raw", "body", "line_start", "line_end", "closed"
    )


def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fences(spark, sf_dir).select(
        "doc_key", "fence_no", F.array_join("heading_path", " / ").alias("heading_path")
    )


def paragraph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fences(spark, sf_dir, whole_paragraphs=True)
    return rows.select("doc_key", "fence_no", "para", "user_para")


def classify_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.classify_label(fences(spark, sf_dir))
    return rows.groupBy("lang_raw", "lang", "artifact_type", "dialect").agg(
        F.count("*").alias("n")
    )


def skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.skip_reason(X.classify_label(fences(spark, sf_dir)), fixed.LANGUAGES)
    return rows.select("doc_key", "fence_no", "lang_raw", "reason", "detail")


def skip_reason_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.skip_reason(X.classify_label(fences(spark, sf_dir)), include_user=True)
    return rows.groupBy("reason", "detail").agg(F.count("*").alias("n"))


def candidate_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.candidate_name(X.classify_label(fences(spark, sf_dir)))
    return rows.select("doc_key", "fence_no", "name_proposal")


def candidate_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.candidate_description(fences(spark, sf_dir))
    return rows.select("doc_key", "fence_no", "description")


def normalize_and_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return X.normalize_and_hash(rows).select("doc_id", "sha256")


def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.risk_flags(X.classify_label(fences(spark, sf_dir)))
    return rows.select("doc_key", "fence_no", F.array_join("flags", ",").alias("flags"))


def fence_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fence scan with a pattern of its own, as the built-in ones hit nothing here."""
    return X.fence_secrets(fences(spark, sf_dir), [("escalates", r"(?U)\bsudo\b")])


def supersede_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revised(spark, sf_dir).select(
        "doc_key", "fence_no", "reason", "detail", "supersedes", "superseded_count"
    )


def supersede_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.supersede_by_similarity(found(spark, sf_dir), top=fence_bound(spark, sf_dir))
    return rows.select("doc_key", "fence_no", "reason", "detail", "supersedes", "superseded_count")


def revision_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents with bodies of many lengths, in chunks that take several rounds."""
    body = F.concat(F.expr("repeat('x', CAST(xs AS INT))"), F.expr("repeat('y', CAST(ys AS INT))"), F.lit("\n"))
    rows = derived(spark, sf_dir, RUNS, "conversations").select(
        "doc_key", "fence_no", "lang", "name_proposal", "reason", body.alias("body_norm"))
    return groups_of(rows, chunk=64)


def dedup_against_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.dedup_against_library(revised(spark, sf_dir), library(spark, sf_dir))
    return rows.select("doc_key", "fence_no", "reason", "detail", "sha256")


def extract_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_stats(found(spark, sf_dir))


def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.document_stats(found(spark, sf_dir), segments(spark, sf_dir))


def fence_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: conversations to fences to outcomes, by language and type."""
    return found(spark, sf_dir).groupBy("lang", "artifact_type", "reason").agg(
        F.count("*").alias("n_fences"), F.countDistinct("doc_key").alias("n_docs"),
        F.countDistinct("sha256").alias("n_bodies"),
    )


QUERIES = {
    "strip_front_matter": strip_front_matter,
    "turn_markers": turn_markers,
    "turn_as_of": turn_as_of,
    "extract_fences": extract_fences,
    "heading_path": heading_path,
    "paragraph_context": paragraph_context,
    "classify_label": classify_label,
    "skip_reason": skip_reason,
    "skip_reason_default": skip_reason_default,
    "candidate_name": candidate_name,
    "candidate_description": candidate_description,
    "normalize_and_hash": normalize_and_hash,
    "risk_flags": risk_flags,
    "fence_secrets": fence_secrets,
    "supersede_by_name": supersede_by_name,
    "supersede_by_similarity": supersede_by_similarity,
    "revision_groups": revision_groups,
    "dedup_against_library": dedup_against_library,
    "extract_stats": extract_stats,
    "document_stats": document_stats,
    "fence_census": fence_census,
}

# ---- SQL twins --------------------------------------------------------------------
_CASES = {
    i: " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in fixed.LABELS.items() if v[i])
    for i in range(3)
}


def slug_sql(text: str, max_len: int = 48) -> str:
    return (
        f"rtrim(left(trim(regexp_replace(lower({text}), '[^a-z0-9]+', '-', 'g'), '-'), {max_len}), '-')"
    )


def hash_sql(body: str) -> str:
    return (
        f"sha256(regexp_replace(regexp_replace(replace({body}, chr(13) || chr(10), chr(10)), "
        f"'[ \\t]+(\\n|$)', '\\1', 'g'), '\\n+$', '') || chr(10))"
    )


def sentence_sql(text: str) -> str:
    flat = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return (
        f"rtrim(left(CASE WHEN regexp_matches({flat}, '[.!?]\\s') "
        f"THEN regexp_extract({flat}, '^(.*?[.!?])\\s', 1) ELSE {flat} END, 120))"
    )


CORPUS = f"WITH corpus AS ({TURNS})"
FENCES = CORPUS + f""",
placed AS (
  SELECT *, length(content_md) - length(replace(content_md, chr(10), '')) + 1 AS nl FROM corpus),
based AS (
  SELECT *, 11 + coalesce(sum(nl + 2) OVER (PARTITION BY conv_id ORDER BY idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM placed),
context AS (
  SELECT *, last_value(CASE WHEN level = 2 AND role <> 'system' THEN heading END IGNORE NULLS) OVER w AS top_heading,
    last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_para
  FROM based WINDOW w AS (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
fences AS (
  SELECT conv_id AS doc_key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS INT) AS fence_no,
    nullif(label, '') AS lang_raw, CASE WHEN body = '' THEN '' ELSE body || chr(10) END AS body,
    CAST(base + nl + 1 AS INT) AS line_end,
    CAST(base + nl - (CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END) AS INT) AS line_start,
    idx AS turn, role, heading, user_para, 'Runs step ' || idx || '.' AS para,
    CASE WHEN level = 3 AND top_heading IS NOT NULL THEN top_heading || ' / ' || heading ELSE heading END AS heading_path,
    CASE label {_CASES[0]} END AS lang, CASE label {_CASES[1]} END AS artifact_type,
    CASE label {_CASES[2]} END AS dialect
  FROM context WHERE role <> 'system'),
named AS (
  SELECT *, coalesce(nullif({slug_sql('heading')}, ''),
    CASE WHEN lang IN ('bash', 'markdown') AND regexp_matches(body, '(?m)^# ?[A-Za-z]') THEN
      {slug_sql("regexp_extract(body, '(?m)^# ?([A-Za-z].*)$', 1)")} END,
    'block-' || CASE WHEN fence_no < 10 THEN '0' ELSE '' END || fence_no) AS name_proposal,
    coalesce(nullif({sentence_sql('user_para')}, ''), para) AS description,
    {hash_sql('body')} AS sha256,
    concat_ws(',', CASE WHEN regexp_matches(body, '\\bsudo\\b') THEN 'sudo' END,
      CASE WHEN regexp_matches(body, '\\bsystemctl\\b') THEN 'systemd' END,
      CASE WHEN lang = 'powershell' AND body LIKE '%Remove-Item%-Recurse%-Force%' THEN 'remove-recurse-force' END,
      CASE WHEN lang = 'powershell' AND body LIKE '%#Requires -RunAsAdministrator%' THEN 'run-as-admin' END,
      CASE WHEN lang = 'sql' AND regexp_matches(body, '(?i)^DELETE\\b') AND NOT regexp_matches(body, '(?i)\\bWHERE\\b')
        THEN 'delete-no-where' END,
      CASE WHEN lang = 'python' AND regexp_matches(body, '\\bos\\.(system|popen)\\s*\\(') THEN 'os-system' END) AS flags
  FROM fences),
ruled AS (
  SELECT *, CASE WHEN trim(body, chr(10) || ' ') = '' THEN 'empty' WHEN lang_raw IS NULL THEN 'unlabeled'
    WHEN lang_raw IN ('console', 'terminal') THEN 'console' WHEN lang IS NULL THEN 'non-target-lang'
    WHEN role = 'user' THEN 'user-turn' END AS reason FROM named),
grouped AS (
  SELECT *, count(*) OVER g AS n_all, row_number() OVER o AS n_at, lag(sha256) OVER o AS prev,
    arg_max(name_proposal, fence_no) OVER g AS last_name
  FROM ruled WHERE reason IS NULL
  WINDOW g AS (PARTITION BY doc_key, lang, name_proposal),
         o AS (PARTITION BY doc_key, lang, name_proposal ORDER BY fence_no)),
revised AS (
  SELECT doc_key, fence_no, sha256, name_proposal, description, body, flags, lang, artifact_type, dialect,
    lang_raw, turn, role, line_start, line_end, heading_path,
    CASE WHEN n_at < n_all THEN 'superseded' END AS reason,
    CASE WHEN n_at < n_all THEN '→ ' || last_name END AS detail,
    CASE WHEN n_at = n_all THEN prev END AS supersedes,
    CAST(CASE WHEN n_at = n_all THEN n_all - 1 ELSE 0 END AS INT) AS superseded_count
  FROM grouped
  UNION ALL
  SELECT doc_key, fence_no, sha256, name_proposal, description, body, flags, lang, artifact_type, dialect,
    lang_raw, turn, role, line_start, line_end, heading_path, reason,
    CASE WHEN reason = 'non-target-lang' THEN 'unrecognized label' ELSE '' END, NULL, 0
  FROM ruled WHERE reason IS NOT NULL)
"""
# Bodies of one language are the same within a conversation of the recipe, so similarity makes them one group.
ALIKE = FENCES.replace("PARTITION BY doc_key, lang, name_proposal", "PARTITION BY doc_key, lang")
_FRONT = f"WITH fronted AS ({FRONTED})"

# Two runs of letters: what two such bodies match is the shorter x run, the shorter y run and the line end.
RUNS = """
SELECT conv_id % 10 AS doc_key, conv_id * 100 + turn AS fence_no, CASE WHEN turn % 2 = 0 THEN 'bash' ELSE 'sql' END AS lang,
  CASE WHEN (conv_id + turn) % 7 = 3 THEN 'shared' WHEN (conv_id + turn) % 7 = 5 THEN 'other' || (conv_id % 4)
    ELSE 'n' || conv_id || '-' || turn END AS name_proposal,
  1 + (conv_id * 7 + turn * 13 + length(text)) % 60 AS xs, (conv_id * 11 + turn * 5) % 40 AS ys,
  CASE WHEN (conv_id + turn) % 9 = 8 THEN 'user-turn' END AS reason
FROM conversations
"""

ORACLES = {
    "strip_front_matter": _FRONT + """
        SELECT doc_key, CAST(CASE doc_key % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 0 END AS INT) AS line_base,
          md5(CASE doc_key % 3 WHEN 0 THEN text[length('---.kind: note.id: ' || doc_key || '.---.') + 1:]
            WHEN 1 THEN text[length('---.k: v.....') + 1:] ELSE text END) AS digest FROM fronted""",
    "turn_markers": FENCES + """
        SELECT conv_id AS doc_key, CAST(base + 1 AS INT) AS line, idx AS turn, role FROM based""",
    "turn_as_of": FENCES + "SELECT doc_key, fence_no, turn, role FROM fences",
    "extract_fences": FENCES + """
        SELECT doc_key, fence_no, lang_raw, body, line_start, line_end, TRUE AS closed FROM fences""",
    "heading_path": FENCES + "SELECT doc_key, fence_no, heading_path FROM fences",
    "paragraph_context": FENCES + "SELECT doc_key, fence_no, para, user_para FROM fences",
    "classify_label": FENCES + """
        SELECT lang_raw, lang, artifact_type, dialect, count(*) AS n FROM fences GROUP BY ALL""",
    "skip_reason": FENCES + """
        SELECT doc_key, fence_no, lang_raw, reason, CASE WHEN reason = 'non-target-lang'
          THEN 'unrecognized label' WHEN reason IS NOT NULL THEN '' END AS detail FROM ruled""",
    "skip_reason_default": FENCES + """
        SELECT reason, detail, count(*) AS n FROM (
          SELECT CASE WHEN r IN ('empty', 'unlabeled', 'console', 'non-target-lang') THEN r
              WHEN lang <> 'bash' THEN 'non-target-lang' END AS reason,
            CASE WHEN r = 'non-target-lang' THEN 'unrecognized label'
              WHEN r IN ('empty', 'unlabeled', 'console') THEN ''
              WHEN lang <> 'bash' THEN lang || ' not selected' END AS detail
          FROM (SELECT *, nullif(reason, 'user-turn') AS r FROM ruled)) GROUP BY ALL""",
    "candidate_name": FENCES + "SELECT doc_key, fence_no, name_proposal FROM named",
    "candidate_description": FENCES + "SELECT doc_key, fence_no, description FROM named",
    "normalize_and_hash": f"SELECT doc_id, {hash_sql('text')} AS sha256 FROM documents",
    "risk_flags": FENCES + "SELECT doc_key, fence_no, flags FROM named",
    "fence_secrets": FENCES + """
        SELECT doc_key, fence_no, 'escalates' AS label, CAST(line_start + 3 AS INT) AS line
        FROM fences WHERE body LIKE '%sudo %'""",
    "supersede_by_name": FENCES + """
        SELECT doc_key, fence_no, reason, detail, supersedes, superseded_count FROM revised""",
    "supersede_by_similarity": ALIKE + """
        SELECT doc_key, fence_no, reason, detail, supersedes, superseded_count FROM revised""",
    "revision_groups": f"""
        WITH RECURSIVE blocks AS (
          SELECT *, row_number() OVER (PARTITION BY doc_key, lang ORDER BY fence_no) AS place FROM ({RUNS}) WHERE reason IS NULL),
        walk AS (
          SELECT DISTINCT doc_key, lang, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS fence_no, CAST(NULL AS BIGINT) AS spot,
            CAST([] AS STRUCT(xs BIGINT, ys BIGINT, name VARCHAR)[]) AS latest FROM blocks
          UNION ALL
          SELECT doc_key, lang, place, fence_no, spot, latest[:spot - 1] || [{{'xs': xs, 'ys': ys, 'name': name}}] || latest[spot + 1:]
          FROM (
            SELECT b.doc_key, b.lang, b.place, b.fence_no, b.xs, b.ys, b.name_proposal AS name, w.latest,
              coalesce(nullif(list_position(list_transform(w.latest, lambda r: r.name = b.name_proposal
                OR 2.0 * (least(r.xs, b.xs) + least(r.ys, b.ys) + 1) / (r.xs + r.ys + b.xs + b.ys + 2) >= 0.7), TRUE), 0),
                len(w.latest) + 1) AS spot
            FROM walk w JOIN blocks b ON b.doc_key = w.doc_key AND b.lang = w.lang AND b.place = w.place + 1))
        SELECT doc_key, fence_no, CAST(spot - 1 AS BIGINT) AS revision_group FROM walk WHERE place > 0""",
    "dedup_against_library": FENCES + f""",
        held AS (SELECT DISTINCT {hash_sql("body || CASE WHEN conv_id % 11 = 0 THEN '' ELSE chr(10) || '# changed since' END")} AS sha256
          FROM corpus)
        SELECT doc_key, fence_no, sha256,
          CASE WHEN reason IS NULL AND sha256 IN (SELECT sha256 FROM held) THEN 'dupe-in-library'
            ELSE reason END AS reason,
          CASE WHEN reason IS NULL AND sha256 IN (SELECT sha256 FROM held) THEN name_proposal
            ELSE detail END AS detail FROM revised""",
    "extract_stats": FENCES + """
        SELECT 'label' AS measure, coalesce(lang_raw, '(unlabeled)') AS value, count(*) AS n
        FROM ruled GROUP BY ALL
        UNION ALL SELECT 'artifact_type', artifact_type, count(*) FROM ruled
        WHERE reason IS NULL GROUP BY ALL""",
    "document_stats": FENCES + """
        SELECT conv_id AS doc_key, count(fence_no) AS fences_seen, max(idx) AS turns,
          TRUE AS transcript_mode, count(*) FILTER (WHERE fence_no IS NOT NULL AND reason IS NULL) AS candidates
        FROM corpus LEFT JOIN ruled ON conv_id = doc_key AND idx = turn GROUP BY conv_id""",
    "fence_census": FENCES + """
        SELECT lang, artifact_type, reason, count(*) AS n_fences, count(DISTINCT doc_key) AS n_docs,
          count(DISTINCT sha256) AS n_bodies FROM ruled GROUP BY ALL""",
}
