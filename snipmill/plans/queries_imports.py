"""Import queries: trees, flat messages, selection, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.operators import imports as I
from snipmill.plans import compile as C
from snipmill.plans.corpus import derived, table, turns
from snipmill.plans.queries_extract import CORPUS, slug_sql

# The turns as a chain of nodes below a root without message, and a discarded
# copy of every turn beside it. Some chains are broken on purpose.
NODES = """
SELECT conv_id AS conv_key, 'c' || conv_id || '-' || turn AS node_id,
  CASE WHEN turn > 0 THEN 'c' || conv_id || '-' || (turn - 1) ELSE 'c' || conv_id || '-root' END AS parent,
  TRUE AS has_message FROM conversations
UNION ALL SELECT conv_id, 'c' || conv_id || '-alt' || turn,
  CASE WHEN turn > 0 THEN 'c' || conv_id || '-' || (turn - 1) ELSE 'c' || conv_id || '-root' END, TRUE
FROM conversations
UNION ALL SELECT conv_id, 'c' || conv_id || '-root',
  CASE WHEN conv_id % 19 = 18 THEN 'c' || conv_id || '-' || max(turn) END, FALSE
FROM conversations WHERE conv_id % 13 <> 12 GROUP BY conv_id
"""
HEADS = """
SELECT conv_id AS conv_key, CASE WHEN conv_id % 10 = 9 THEN NULL
  WHEN conv_id % 17 = 16 THEN 'c' || conv_id || '-nowhere'
  ELSE 'c' || conv_id || '-' || max(turn) END AS current_node
FROM conversations GROUP BY conv_id
"""
TITLES = """
SELECT CAST(p_partkey % 20 AS INT) AS export_key, p_partkey AS doc_key, 'id-' || p_partkey AS conversation_id,
  CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END || ' ' || p_size AS title,
  p_partkey AS position
FROM part
"""
SELECTORS = """
SELECT o_orderkey AS selector_id, CAST(o_orderkey % 20 AS INT) AS export_key,
  CASE o_orderkey % 6 WHEN 0 THEN 'id-' || o_custkey WHEN 1 THEN 'red widget ' || (o_custkey % 50)
    WHEN 2 THEN 'T ' || (o_custkey % 50) WHEN 3 THEN 'Widget ' || (o_custkey % 50)
    WHEN 4 THEN 'zz' ELSE NULL END AS wanted
FROM orders
"""
PASTES = """
SELECT doc_id AS doc_key, 'doc-' || doc_id AS stem,
  CASE WHEN doc_id % 4 = 0 THEN '---' || chr(10) || 'kind: transcript' || chr(10) || 'schema: 1' || chr(10)
    || 'source: chatgpt' || chr(10) || 'adapter: chatgpt-v1' || chr(10) || 'conversation_id: null' || chr(10)
    || 'title: "T: ' || doc_id || '"' || chr(10) || 'exported_at: 2026-01-01' || chr(10) || 'turns: 1' || chr(10)
    || '---' || chr(10) || chr(10) || '<!-- turn 1 role=user -->' || chr(10) || 'Hello' || chr(10)
    ELSE chr(10) || 'Note ' || lang || ' ' || n_chars || chr(10) || chr(10) END AS text
FROM documents
"""
MARKED = """
SELECT conv_id * 8 + turn AS doc_key,
  'lead' || chr(10) || '<!-- turn 1 role=user -->' || chr(10) || text || chr(10) || chr(10)
  || '<!--  turn 2  role=Robot ts=2026-01-0' || (turn + 1) || ' -->   ' || chr(10) || chr(10) || chr(10)
  || role || chr(10) || 'x <!-- turn 3 role=user -->' || chr(10) AS text
FROM conversations
"""
CANONICAL = """
SELECT conv_id * 8 + turn AS doc_key, (conv_id * 8 + turn) % 12 AS k,
  CASE WHEN (conv_id * 8 + turn) % 12 = 1 THEN '' ELSE '---' || chr(10) END
  || CASE WHEN (conv_id * 8 + turn) % 12 = 2 THEN 'no colon' || chr(10) ELSE '' END
  || 'kind: ' || CASE WHEN (conv_id * 8 + turn) % 12 = 3 THEN 'note' ELSE 'transcript' END || chr(10)
  || 'schema: ' || CASE (conv_id * 8 + turn) % 12 WHEN 4 THEN 'one' WHEN 5 THEN '2' ELSE '1' END || chr(10)
  || 'source: s' || chr(10) || 'adapter: a' || chr(10)
  || CASE WHEN (conv_id * 8 + turn) % 12 = 6 THEN '' ELSE 'conversation_id: null' || chr(10) END
  || 'title: ' || CASE WHEN (conv_id * 8 + turn) % 12 = 7 THEN '"bad \\x"' ELSE '"ok"' END || chr(10)
  || 'exported_at: null' || chr(10)
  || 'turns: ' || CASE (conv_id * 8 + turn) % 12 WHEN 8 THEN '2' WHEN 9 THEN 'few' ELSE '1' END || chr(10)
  || '---' || chr(10) || chr(10) || '<!-- turn 1 role=' || role || ' -->' || chr(10) || text || chr(10) AS text
FROM conversations
""".replace("\\x", "' || chr(92) || 'x")
TAKEN = """
SELECT DISTINCT 'transcripts/2026/01' AS namespace, 'transcripts' AS kind,
  CASE WHEN p_partkey % 9 IN (0, 2, 3, 7) THEN 'shared-tool' ELSE 'other-' || p_partkey END
  || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '-' || (p_partkey % 9 + 1) END || '.md' AS filename
FROM part
"""


def linearize(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return I.linearize_tree(derived(spark, sf_dir, NODES, "conversations"),
                            derived(spark, sf_dir, HEADS, "conversations"))


def linearize_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linearize(spark, sf_dir)[0]


def linearize_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linearize(spark, sf_dir)[1]


def walk_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trees as entries of an export, each walked in its row; (conv_key, node_id, idx) or the error."""
    nodes = derived(spark, sf_dir, NODES, "conversations")
    message = F.when(F.col("has_message"), F.struct(F.lit("x").alias("id")))
    node = F.struct("node_id", F.struct("parent", message.alias("message")).alias("node"))
    trees = nodes.groupBy("conv_key").agg(F.map_from_entries(F.collect_list(node)).alias("mapping"))
    heads = derived(spark, sf_dir, HEADS, "conversations")
    entry = F.to_json(F.struct(F.coalesce("mapping", F.create_map().cast(trees.schema["mapping"].dataType)).alias("mapping"), "current_node"),
                      {"ignoreNullFields": "false"})
    entries = heads.join(trees, "conv_key", "left").select("conv_key", F.parse_json(entry).alias("entry"))
    messages, errors = I.walk_entries(entries)
    none = F.lit(None).cast("string")
    return messages.select("conv_key", "node_id", "idx", none.alias("error")).unionByName(
        errors.select("conv_key", none.alias("node_id"), F.lit(None).cast("int").alias("idx"), "error"))


def _variant(spark: SparkSession, sf_dir: str, column: str, sql: str) -> DataFrame:
    rows = derived(spark, sf_dir, sql, "conversations")
    return rows.withColumn(column, F.parse_json("doc")).drop("doc")


def export_messages_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variant(spark, sf_dir, "message", """
        SELECT conv_id, turn, CASE turn % 5
          WHEN 3 THEN to_json(named_struct('author', named_struct('role', 'robot'), 'create_time', TRUE))
          WHEN 4 THEN to_json(named_struct('author', named_struct('role', role), 'create_time', 'x',
            'content', named_struct('content_type', 'image', 'parts', array(text))))
          ELSE to_json(named_struct('author', named_struct('role', role),
            'create_time', 1700000000 + conv_id + turn / 4,
            'content', named_struct('content_type', 'text', 'parts', array(text, '', role)))) END AS doc
        FROM conversations""")
    return I.tree_messages(rows).select(
        "conv_id", "turn", "role", "content_md", "ts",
        F.array_join(F.map_keys("metadata"), ",").alias("note"),
    )


def export_messages_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variant(spark, sf_dir, "message", """
        SELECT conv_id, turn, CASE turn % 4
          WHEN 3 THEN to_json(named_struct('sender', 'bot', 'text', turn, 'created_at', turn,
            'files', array(named_struct('name', role))))
          ELSE to_json(named_struct('sender', CASE role WHEN 'user' THEN 'human' ELSE role END,
            'text', text, 'created_at', 'day ' || turn, 'attachments', array())) END AS doc
        FROM conversations""")
    return I.flat_turns(rows).select(
        "conv_id", "turn", "role", "content_md", "ts",
        F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])),
                     ",").alias("metadata"),
    )


def export_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variant(spark, sf_dir, "entry", """
        SELECT DISTINCT conv_id AS conv_key, to_json(named_struct(
          'conversation_id', CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'cid-' || conv_id END,
          'id', CASE WHEN conv_id % 6 = 0 THEN NULL ELSE 'alt-' || conv_id END,
          'title', CASE WHEN conv_id % 4 = 0 THEN NULL ELSE 'Talk ' || conv_id END,
          'create_time', 1600000000 + conv_id,
          'update_time', CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 1700000000.5 + conv_id END)) AS doc
        FROM conversations""")
    return I.export_header(rows, fixed.TREE_ADAPTER)


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header per conversation, plus one empty conversation for every fifth."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    empty = ids.where("conv_id % 5 = 0").select((F.col("conv_id") + 1_000_000_000).alias("conv_id"))
    return ids.unionByName(empty).select(
        F.col("conv_id").alias("doc_key"), F.lit("chat").alias("source"), F.lit("chat-v1").alias("adapter"),
        F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("id:"), F.col("conv_id"))).alias("conversation_id"),
        F.when(F.col("conv_id") % 2 == 0, "Shared tool").otherwise(
            F.concat(F.lit("#"), F.col("conv_id"))).alias("title"),
        F.lit("2026-01-01T00:00:00.000+00:00").alias("exported_at"),
        F.lit("2026-01-01T00:00:00.000+00:00").alias("listed_at"),
    )


def passthrough_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, rows = I.passthrough_markdown(derived(spark, sf_dir, PASTES, "documents"))
    return headers.join(rows, "doc_key").drop("ts")


def list_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.list_conversations(_headers(spark, sf_dir), turns(spark, sf_dir))


def select_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.select_conversation(derived(spark, sf_dir, SELECTORS, "orders"),
                                 derived(spark, sf_dir, TITLES, "part"))
    return rows.select("selector_id", "outcome", F.coalesce("stage", F.lit(-1)).alias("stage"),
                       F.coalesce("doc_key", F.lit(-1)).alias("doc_key"))


def render_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.transcript_pieces(I.render_parts(_headers(spark, sf_dir), turns(spark, sf_dir)))


def parse_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.parse_turns(derived(spark, sf_dir, MARKED, "conversations"))


def validate_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.validate_transcript(derived(spark, sf_dir, CANONICAL, "conversations"))


def transcript_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.transcript_destinations(
        _headers(spark, sf_dir), derived(spark, sf_dir, TAKEN, "part"), "2026", "01")


def import_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole import; every thirteenth conversation says a password in one turn."""
    leak = F.when((F.col("doc_key") % 13 == 0) & (F.col("idx") == 2), F.concat(
        "content_md", F.lit("\npassword = hunter2hunter2"))).otherwise(F.col("content_md"))
    headers = _headers(spark, sf_dir).withColumn("source_path", F.concat(F.lit("in/"), "doc_key"))
    out = C.import_corpus(headers, turns(spark, sf_dir).withColumn("content_md", leak),
                          derived(spark, sf_dir, TAKEN, "part"), year="2026", month="01", ts=F.lit("now"))
    return out.ledger.select("source_path", "result", "detail", "turns")


QUERIES = {
    "import_corpus": import_corpus,
    "linearize_tree": linearize_tree,
    "linearize_errors": linearize_errors,
    "walk_entries": walk_entries,
    "export_messages_a": export_messages_a,
    "export_messages_b": export_messages_b,
    "export_header": export_header,
    "passthrough_markdown": passthrough_markdown,
    "list_conversations": list_conversations,
    "select_conversation": select_conversation,
    "render_transcript": render_transcript,
    "parse_turns": parse_turns,
    "validate_transcript": validate_transcript,
    "transcript_slug": transcript_slug,
}

_HEADERS = """headers AS (
  SELECT conv_id AS doc_key, CASE WHEN conv_id % 3 <> 0 THEN 'id:' || conv_id END AS conversation_id,
    CASE WHEN conv_id % 2 = 0 THEN 'Shared tool' ELSE '#' || conv_id END AS title
  FROM (SELECT DISTINCT conv_id FROM conversations UNION
        SELECT conv_id + 1000000000 FROM conversations WHERE conv_id % 5 = 0))"""
_MILLIS = "strftime(make_timestamp(CAST(({}) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00'"

def _slugs(where: str) -> str:
    return f"""{_HEADERS}, taken AS ({TAKEN}),
        used AS (SELECT t, row_number() OVER (ORDER BY t) AS j FROM (SELECT CAST(coalesce(
          nullif(regexp_extract(filename, '-([0-9]+)\\.md$', 1), ''), '1') AS INT) AS t FROM taken WHERE filename LIKE 'shared-tool%')),
        slugs AS (SELECT doc_key, coalesce(nullif({slug_sql('title', 64)}, ''), 'untitled') AS slug
          FROM headers WHERE {where}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_key) AS k FROM slugs),
        numbered AS (SELECT doc_key, slug, k + count(j) AS n FROM ranked
          LEFT JOIN used ON slug = 'shared-tool' AND t - j < k GROUP BY doc_key, slug, k),
        placed AS (SELECT doc_key, slug, 'transcripts/2026/01/' || slug || CASE WHEN n = 1 THEN '' ELSE '-' || n END
          || '.md' AS destination FROM numbered)"""


# A whole transcript in one text.
WHOLE_TEXTS = CORPUS + f""",
        {_HEADERS},
        parts AS (SELECT conv_id, count(*) AS n, string_agg('<!-- turn ' || idx || ' role=' || role || ' -->'
            || chr(10) || content_md, chr(10) || chr(10) ORDER BY idx) AS body FROM corpus GROUP BY conv_id)
        SELECT doc_key, '---' || chr(10) || 'kind: transcript' || chr(10) || 'schema: 1' || chr(10)
          || 'source: chat' || chr(10) || 'adapter: chat-v1' || chr(10) || 'conversation_id: '
          || coalesce('"' || conversation_id || '"', 'null') || chr(10) || 'title: '
          || CASE WHEN title = 'Shared tool' THEN title ELSE '"' || title || '"' END || chr(10)
          || 'exported_at: "2026-01-01T00:00:00.000+00:00"' || chr(10) || 'turns: ' || coalesce(n, 0) || chr(10)
          || '---' || coalesce(chr(10) || chr(10) || body, '') || chr(10) AS text
        FROM headers LEFT JOIN parts ON conv_id = doc_key"""

ORACLES = {
    "import_corpus": f"""
        WITH leaks AS (SELECT conv_id FROM conversations WHERE conv_id % 13 = 0 AND turn = 1),
        {_slugs('doc_key NOT IN (SELECT conv_id FROM leaks)')},
        counts AS (SELECT conv_id, CAST(count(*) AS INT) AS n FROM conversations GROUP BY 1)
        SELECT 'in/' || h.doc_key AS source_path, CASE WHEN p.doc_key IS NULL THEN 'refused' ELSE 'ok' END AS result,
          coalesce(destination, 'secret:kv-secret') AS detail, CAST(coalesce(n, 0) AS INT) AS turns
        FROM headers h LEFT JOIN placed p USING (doc_key) LEFT JOIN counts ON conv_id = h.doc_key""",
    "linearize_tree": f"""
        WITH RECURSIVE nodes AS ({NODES}), heads AS ({HEADS}),
        walk AS (
          SELECT h.conv_key, current_node AS node_id, 0 AS depth FROM heads h
          WHERE current_node IS NOT NULL AND conv_key % 19 <> 18 AND conv_key % 13 <> 12
          UNION ALL
          SELECT w.conv_key, n.parent, depth + 1 FROM walk w JOIN nodes n
            ON n.conv_key = w.conv_key AND n.node_id = w.node_id WHERE n.parent IS NOT NULL)
        SELECT w.conv_key, w.node_id,
          CAST(row_number() OVER (PARTITION BY w.conv_key ORDER BY depth DESC) AS INT) AS idx
        FROM walk w JOIN nodes n ON n.conv_key = w.conv_key AND n.node_id = w.node_id WHERE has_message""",
    "linearize_errors": f"""
        WITH heads AS ({HEADS})
        SELECT conv_key, CASE WHEN conv_key % 17 = 16 THEN 'current_node is not in mapping'
          WHEN conv_key % 13 = 12 THEN 'missing mapping node' ELSE 'cycle in mapping' END AS error
        FROM heads WHERE current_node IS NOT NULL
          AND (conv_key % 17 = 16 OR conv_key % 13 = 12 OR conv_key % 19 = 18)""",
    "export_messages_a": f"""
        SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN 'unknown' ELSE role END AS role,
          CASE WHEN turn % 5 < 3 THEN text || chr(10) || chr(10) || role ELSE '' END AS content_md,
          CASE WHEN turn % 5 < 3 THEN {_MILLIS.format('1700000000 + conv_id + turn / 4')} END AS ts,
          CASE turn % 5 WHEN 3 THEN 'missing_content' WHEN 4 THEN 'unsupported_content_type' ELSE '' END AS note
        FROM conversations""",
    "export_messages_b": """
        SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'unknown' WHEN role = 'user' THEN 'user'
            WHEN role = 'assistant' THEN 'assistant' ELSE 'unknown' END AS role,
          CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS content_md,
          CASE WHEN turn % 4 <> 3 THEN 'day ' || turn END AS ts,
          CASE WHEN turn % 4 = 3 THEN 'files=[{"name":"' || role || '"}],missing_content=true' ELSE '' END AS metadata
        FROM conversations""",
    "export_header": f"""
        SELECT DISTINCT conv_id AS conv_key, 'chatgpt' AS source, 'chatgpt-v1' AS adapter,
          CASE WHEN conv_id % 3 <> 0 THEN 'cid-' || conv_id WHEN conv_id % 6 <> 0 THEN 'alt-' || conv_id END AS conversation_id,
          CASE WHEN conv_id % 4 = 0 THEN 'untitled' ELSE 'Talk ' || conv_id END AS title,
          CASE WHEN conv_id % 5 = 0 THEN {_MILLIS.format('1600000000 + conv_id')}
            ELSE {_MILLIS.format('1700000000.5 + conv_id')} END AS exported_at,
          CASE WHEN conv_id % 5 <> 0 THEN {_MILLIS.format('1700000000.5 + conv_id')} END AS listed_at
        FROM conversations""",
    "passthrough_markdown": """
        SELECT doc_id AS doc_key, CASE WHEN doc_id % 4 = 0 THEN 'chatgpt' ELSE 'markdown' END AS source,
          CASE WHEN doc_id % 4 = 0 THEN 'chatgpt-v1' ELSE 'markdown-v1' END AS adapter,
          CASE WHEN doc_id % 4 = 0 THEN 'T: ' || doc_id ELSE 'doc-' || doc_id END AS title,
          CAST(NULL AS VARCHAR) AS conversation_id, CASE WHEN doc_id % 4 = 0 THEN '2026-01-01' END AS exported_at,
          CAST(1 AS INT) AS idx, CASE WHEN doc_id % 4 = 0 THEN 'user' ELSE 'assistant' END AS role,
          CASE WHEN doc_id % 4 = 0 THEN 'Hello' ELSE 'Note ' || lang || ' ' || n_chars END AS content_md
        FROM documents""",
    "list_conversations": f"""
        WITH {_HEADERS}
        SELECT doc_key, coalesce(conversation_id, '?') AS conversation_id, title, count(conv_id) AS turn_count,
          '2026-01-01T00:00:00.000+00:00' AS exported_at
        FROM headers LEFT JOIN conversations ON conv_id = doc_key GROUP BY ALL""",
    "select_conversation": f"""
        WITH s AS ({SELECTORS}), t AS ({TITLES}),
        hits AS (SELECT selector_id, CASE WHEN wanted IS NULL THEN 0 WHEN wanted = conversation_id THEN 1
            WHEN wanted = title THEN 2 WHEN contains(lower(title), lower(wanted)) THEN 3 END AS stage, doc_key
          FROM s JOIN t USING (export_key)),
        best AS (SELECT selector_id, stage, count(*) AS n, min(doc_key) AS doc_key,
            row_number() OVER (PARTITION BY selector_id ORDER BY stage) AS r
          FROM hits WHERE stage IS NOT NULL GROUP BY selector_id, stage)
        SELECT selector_id, CASE WHEN stage IS NULL THEN 'not_found' WHEN stage = 1 OR n = 1 THEN 'selected'
            ELSE 'ambiguous' END AS outcome, CAST(coalesce(stage, -1) AS INT) AS stage,
          CASE WHEN stage = 1 OR n = 1 THEN doc_key ELSE -1 END AS doc_key
        FROM s LEFT JOIN best USING (selector_id) WHERE r IS NULL OR r = 1""",
    "render_transcript": CORPUS + f""",
        {_HEADERS},
        parts AS (SELECT conv_id, count(*) AS n, max(idx) AS last FROM corpus GROUP BY conv_id)
        SELECT doc_key, 0 AS part_no, '---' || chr(10) || 'kind: transcript' || chr(10) || 'schema: 1' || chr(10)
          || 'source: chat' || chr(10) || 'adapter: chat-v1' || chr(10) || 'conversation_id: '
          || coalesce('"' || conversation_id || '"', 'null') || chr(10) || 'title: '
          || CASE WHEN title = 'Shared tool' THEN title ELSE '"' || title || '"' END || chr(10)
          || 'exported_at: "2026-01-01T00:00:00.000+00:00"' || chr(10) || 'turns: ' || coalesce(n, 0) || chr(10)
          || '---'
          || CASE WHEN n > 0 THEN chr(10) ELSE '' END || chr(10) AS text
        FROM headers LEFT JOIN parts ON conv_id = doc_key
        UNION ALL SELECT conv_id, CAST(idx AS INT), '<!-- turn ' || idx || ' role=' || role || ' -->' || chr(10) || content_md
          || CASE WHEN idx = last THEN '' ELSE chr(10) END || chr(10)
        FROM corpus JOIN parts USING (conv_id)""",
    "parse_turns": """
        SELECT conv_id * 8 + turn AS doc_key, CAST(p AS INT) AS place, CAST(p AS INT) AS idx,
          CASE p WHEN 1 THEN 'user' ELSE 'unknown' END AS role,
          CASE p WHEN 1 THEN text ELSE role || chr(10) || 'x <!-- turn 3 role=user -->' END AS content_md,
          CASE p WHEN 2 THEN '2026-01-0' || (turn + 1) END AS ts
        FROM conversations, (VALUES (1), (2)) AS ps(p)""",
    "validate_transcript": f"""
        SELECT doc_key, CASE k WHEN 1 THEN 'missing or malformed front matter'
          WHEN 2 THEN 'malformed front matter line: no colon' WHEN 3 THEN 'unexpected kind: note'
          WHEN 4 THEN 'schema is not an integer: one' WHEN 5 THEN 'unsupported schema: 2'
          WHEN 6 THEN 'missing fields: conversation_id' WHEN 7 THEN 'malformed quoted value: "bad ' || chr(92) || 'x"'
          WHEN 8 THEN 'declares 2 turns but has 1' WHEN 9 THEN 'turns is not an integer: few' END AS error
        FROM ({CANONICAL})""",
    "transcript_slug": f"WITH {_slugs('TRUE')} SELECT * FROM placed",
}

ORACLES["walk_entries"] = f"""
    SELECT conv_key, node_id, idx, NULL AS error FROM ({ORACLES["linearize_tree"]})
    UNION ALL SELECT conv_key, NULL, NULL, error FROM ({ORACLES["linearize_errors"]})"""
