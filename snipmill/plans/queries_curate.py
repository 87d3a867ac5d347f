"""Tags and collections derived from parts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill.operators import curate
from snipmill.plans.corpus import derived

_REF = "'scripts/' || replace(p_name, ' ', '-') || '-' || (p_partkey % 400) || '.sh'"
FILES = f"""
SELECT CASE WHEN k % 9 = 8 THEN 'scripts/other-' || k || '.sh' ELSE ref END AS ref,
  CASE WHEN k % 2 = 0 THEN 'draft' ELSE 'approved' END AS state, 'gen-' || (k % 4) AS compiled
FROM (SELECT {_REF} AS ref, min(p_partkey) AS k FROM part GROUP BY 1) f
UNION ALL
SELECT ref, 'approved', 'gen-x' FROM (SELECT {_REF} AS ref, min(p_partkey) AS k FROM part GROUP BY 1) g
WHERE k % 22 = 0
"""
TAGS = f"""
SELECT DISTINCT ref, 'gen-' || (CASE WHEN k % 7 = 6 THEN 9 ELSE k % 4 END) AS compiled, tag FROM (
  SELECT {_REF} AS ref, min(p_partkey) OVER (PARTITION BY {_REF}) AS k,
    CASE WHEN p_partkey % 3 = 0 THEN 'shared' ELSE lower(replace(p_brand, '#', '-')) END AS tag, p_partkey
  FROM part) t
"""
TAG_REQUESTS = f"""
SELECT p_partkey AS request_id,
  CASE WHEN p_partkey % 31 = 30 THEN 'scripts/nowhere-' || p_partkey || '.sh' ELSE {_REF} END AS ref,
  CASE i WHEN 0 THEN 'shared' WHEN 1 THEN CASE WHEN p_partkey % 13 = 12 THEN 'Bad Name' ELSE lower(p_type) END
    ELSE lower(replace(p_brand, '#', '-')) END AS tag
FROM (SELECT part.*, 0 AS i FROM part UNION ALL SELECT part.*, 1 FROM part UNION ALL SELECT part.*, 2 FROM part) n
"""
COLLECTIONS = """
SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS name, 'Brand ' || p_brand AS title, 'd' AS description
FROM part UNION ALL SELECT 'Not Legal', 't', 'd'
"""
MEMBERS = f"""
SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY k) AS INT) AS pos, ref,
  'gen-' || (CASE WHEN k % 37 = 36 THEN 9 ELSE k0 % 4 END) AS compiled FROM (
  SELECT lower(replace(p_brand, '#', '-')) AS name, ref, min(p_partkey) AS k, min(k0) AS k0 FROM (
    SELECT *, {_REF} AS ref, min(p_partkey) OVER (PARTITION BY {_REF}) AS k0 FROM part) r
  GROUP BY 1, 2) m
"""
CREATE_REQUESTS = """
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 17 = 16 THEN 'UPPER' || (o_orderkey % 3)
    ELSE 'brand-' || (o_custkey % 40) END AS name,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Brand Brand#' || (o_custkey % 40) ELSE 'Own' END AS title,
  CASE WHEN o_orderkey % 5 = 0 THEN 'd' ELSE NULL END AS description
FROM orders
"""
MEMBER_REQUESTS = f"""
SELECT CAST(floor(p_partkey / 3) AS BIGINT) AS request_id, CAST(p_partkey % 3 AS INT) AS seq,
  CASE WHEN floor(p_partkey / 3) % 29 = 28 THEN 'nobody' ELSE 'brand-' || (CAST(floor(p_partkey / 3) AS BIGINT) % 12 + 1) END AS name,
  CASE WHEN p_partkey % 41 = 40 THEN 'scripts/nowhere.sh' ELSE {_REF} END AS ref
FROM part
"""
ARGS = """
SELECT o_orderkey AS arg_id, CASE o_orderkey % 7 WHEN 0 THEN 'scripts/a-' || o_custkey || '.sh'
  WHEN 1 THEN 'artifacts/drafts/prompts/b_' || o_custkey || '.md' WHEN 2 THEN 'artifacts/approved/runbooks/c.md'
  WHEN 3 THEN 'artifacts/revoked/scripts/d.sh' WHEN 4 THEN 'scripts/../e.sh' WHEN 5 THEN 'Scripts/f.sh'
  ELSE 'scripts/' || lower(o_orderpriority) || '.sh' END AS arg
FROM orders
"""


def _of(sql: str, *tables: str):
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derived(spark, sf_dir, sql, *tables)

    return read


files, tags, tag_requests = _of(FILES, "part"), _of(TAGS, "part"), _of(TAG_REQUESTS, "part")
collections, members = _of(COLLECTIONS, "part"), _of(MEMBERS, "part")
create_requests, member_requests = _of(CREATE_REQUESTS, "orders"), _of(MEMBER_REQUESTS, "part")


def parse_artifact_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.parse_artifact_ref(derived(spark, sf_dir, ARGS, "orders")).select("arg_id", "ref")


def validate_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = derived(spark, sf_dir, """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority
        WHEN 1 THEN lower(replace(o_orderpriority, ' ', '')) ELSE repeat('x', CAST(o_custkey % 90 AS INT)) END AS name
        FROM orders""", "orders")
    return curate.validate_name(names)


def locate_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.locate_artifact(files(spark, sf_dir))


def reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.reference_status(tags(spark, sf_dir), files(spark, sf_dir))


def tag_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.tag_add(tags(spark, sf_dir), tag_requests(spark, sf_dir), files(spark, sf_dir))[0]


def tag_add_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.tag_add(tags(spark, sf_dir), tag_requests(spark, sf_dir), files(spark, sf_dir))[1]


def tag_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.tag_remove(tags(spark, sf_dir), tag_requests(spark, sf_dir), files(spark, sf_dir))[0]


def tag_remove_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.tag_remove(tags(spark, sf_dir), tag_requests(spark, sf_dir), files(spark, sf_dir))[1]


def artifacts_with_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.artifacts_with_tag(tags(spark, sf_dir), files(spark, sf_dir)).select("tag", "ref", "status")


def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.tag_index(tags(spark, sf_dir))


def collection_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.collection_create(collections(spark, sf_dir), create_requests(spark, sf_dir))[0]


def _added(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return curate.collection_add(collections(spark, sf_dir), members(spark, sf_dir),
                                 member_requests(spark, sf_dir), files(spark, sf_dir))


def collection_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _added(spark, sf_dir)[0]


def collection_add_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _added(spark, sf_dir)[1]


def collection_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.collection_remove(members(spark, sf_dir), member_requests(spark, sf_dir),
                                    files(spark, sf_dir))[0]


def collection_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate.collection_show(members(spark, sf_dir), files(spark, sf_dir))
    return rows.select("name", "pos", "ref", "status")


def collection_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.collection_list(collections(spark, sf_dir), members(spark, sf_dir))


def registry_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad_tags = tag_requests(spark, sf_dir).select(
        F.when(F.col("request_id") % 11 == 0, F.upper("ref")).otherwise(F.col("ref")).alias("ref"),
        F.when(F.col("request_id") % 12 != 0, F.lit("gen")).alias("compiled"), "tag")
    bad_members = member_requests(spark, sf_dir).select("name", "ref", F.lit("gen").alias("compiled"))
    return curate.registry_validation(bad_tags, bad_members)


QUERIES = {
    name: globals()[name] for name in (
        "parse_artifact_ref", "validate_name", "locate_artifact", "reference_status", "tag_add",
        "tag_add_table", "tag_remove", "tag_remove_table", "artifacts_with_tag", "tag_index",
        "collection_create", "collection_add", "collection_add_members", "collection_remove",
        "collection_show", "collection_list", "registry_validation",
    )
}

_REF_RX = "^(scripts|prompts|runbooks)/[a-z0-9][a-z0-9_-]*\\.[a-z0-9]+$"
_NAME_RX = "^[a-z0-9][a-z0-9-]{0,47}$"
_LIB = f"""files AS ({FILES}),
located AS (SELECT ref, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE max(state) END AS state,
  CASE WHEN count(*) = 1 THEN max(compiled) END AS compiled FROM files GROUP BY ref)"""
_STATUS = """CASE WHEN l.ref IS NULL THEN 'missing' WHEN l.state = 'ambiguous' THEN 'ambiguous'
  WHEN l.compiled = {t}.compiled THEN l.state ELSE 'stale' END"""
_TAGGING = f"""WITH {_LIB}, tags AS ({TAGS}), requests AS ({TAG_REQUESTS}),
held AS (SELECT ref, max(compiled) AS compiled FROM tags GROUP BY ref)"""
_ADD = _TAGGING + f""",
r AS (SELECT q.*, l.compiled AS stamp, t.tag IS NOT NULL AS present,
    CASE WHEN NOT regexp_matches(q.tag, '{_NAME_RX}') THEN 'invalid-name' WHEN l.ref IS NULL THEN 'unknown-artifact'
      WHEN l.state = 'ambiguous' THEN 'ambiguous-artifact' WHEN h.compiled <> l.compiled THEN 'stale-reference' END AS f
  FROM requests q LEFT JOIN located l USING (ref) LEFT JOIN held h USING (ref)
    LEFT JOIN tags t ON t.ref = q.ref AND t.tag = q.tag),
w AS (SELECT *, min(f) OVER (PARTITION BY request_id) AS fault FROM r),
o AS (SELECT *, CASE WHEN fault IS NULL AND NOT present
    THEN row_number() OVER (PARTITION BY ref, tag, fault IS NULL ORDER BY request_id) END AS n FROM w),
outcomes AS (SELECT request_id, ref, tag, stamp, CASE WHEN fault IS NOT NULL THEN fault WHEN n = 1 THEN 'added'
    ELSE 'unchanged' END AS outcome FROM o)"""
_REMOVE = _TAGGING + f""",
r AS (SELECT q.*, t.tag IS NOT NULL AS present,
    CASE WHEN NOT regexp_matches(q.tag, '{_NAME_RX}') THEN 'invalid-name'
      WHEN h.ref IS NULL AND l.compiled IS NULL THEN 'unknown-artifact' END AS f
  FROM requests q LEFT JOIN located l USING (ref) LEFT JOIN held h USING (ref)
    LEFT JOIN tags t ON t.ref = q.ref AND t.tag = q.tag),
w AS (SELECT *, min(f) OVER (PARTITION BY request_id) AS fault FROM r),
o AS (SELECT *, CASE WHEN fault IS NULL AND present
    THEN row_number() OVER (PARTITION BY ref, tag, fault IS NULL ORDER BY request_id) END AS n FROM w),
outcomes AS (SELECT request_id, ref, tag, CASE WHEN fault IS NOT NULL THEN fault WHEN n = 1 THEN 'removed'
    ELSE 'unchanged' END AS outcome FROM o)"""
_COLL = f"WITH {_LIB}, collections AS ({COLLECTIONS}), members AS ({MEMBERS}), requests AS ({MEMBER_REQUESTS})"
_CADD = _COLL + """,
r AS (SELECT q.*, l.compiled AS stamp, m.ref IS NOT NULL AS present,
    CASE WHEN c.name IS NULL THEN 'unknown-collection' WHEN l.ref IS NULL THEN 'unknown-artifact'
      WHEN l.state = 'ambiguous' THEN 'ambiguous-artifact' WHEN m.compiled <> l.compiled THEN 'stale-reference' END AS f
  FROM requests q LEFT JOIN collections c USING (name) LEFT JOIN located l USING (ref)
    LEFT JOIN members m ON m.name = q.name AND m.ref = q.ref),
w AS (SELECT *, min(f) OVER (PARTITION BY request_id) AS fault FROM r),
o AS (SELECT *, CASE WHEN fault IS NULL AND NOT present
    THEN row_number() OVER (PARTITION BY name, ref, fault IS NULL ORDER BY request_id, seq) END AS n FROM w),
outcomes AS (SELECT *, CASE WHEN fault IS NOT NULL THEN fault WHEN n = 1 THEN 'added' ELSE 'unchanged' END AS outcome
  FROM o)"""

ORACLES = {
    "parse_artifact_ref": f"""
        WITH a AS ({ARGS}), s AS (SELECT *, CASE WHEN regexp_matches(arg, '^artifacts/(drafts|approved)/.')
          THEN regexp_replace(arg, '^artifacts/(drafts|approved)/', '') ELSE arg END AS r FROM a)
        SELECT arg_id, CASE WHEN regexp_matches(r, '{_REF_RX}') THEN r END AS ref FROM s""",
    "validate_name": f"""
        WITH n AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority
          WHEN 1 THEN lower(replace(o_orderpriority, ' ', '')) ELSE repeat('x', CAST(o_custkey % 90 AS INT)) END AS name
          FROM orders)
        SELECT o_orderkey, name, regexp_matches(name, '{_NAME_RX}') AS valid,
          CASE WHEN NOT regexp_matches(name, '{_NAME_RX}') THEN rtrim(left(trim(regexp_replace(lower(name),
            '[^a-z0-9]+', '-', 'g'), '-'), 48), '-') END AS suggestion FROM n""",
    "locate_artifact": f"WITH {_LIB} SELECT * FROM located",
    "reference_status": f"""WITH {_LIB}, tags AS ({TAGS})
        SELECT t.*, {_STATUS.format(t='t')} AS status FROM tags t LEFT JOIN located l USING (ref)""",
    "tag_add": _ADD + "SELECT request_id, ref, tag, outcome FROM outcomes",
    "tag_add_table": _ADD + """SELECT * FROM tags UNION ALL
        SELECT ref, stamp, tag FROM outcomes WHERE outcome = 'added'""",
    "tag_remove": _REMOVE + "SELECT * FROM outcomes",
    "tag_remove_table": _REMOVE + """SELECT * FROM tags WHERE (ref, tag) NOT IN
        (SELECT (ref, tag) FROM outcomes WHERE outcome = 'removed')""",
    "artifacts_with_tag": f"""WITH {_LIB}, tags AS ({TAGS})
        SELECT t.tag, t.ref, {_STATUS.format(t='t')} AS status FROM tags t LEFT JOIN located l USING (ref)""",
    "tag_index": f"""WITH tags AS ({TAGS}), p AS (SELECT DISTINCT tag, ref FROM tags)
        SELECT tag, ref, count(*) OVER (PARTITION BY tag) AS n_refs FROM p""",
    "collection_create": f"""
        WITH c AS ({COLLECTIONS}), q AS ({CREATE_REQUESTS}),
        first AS (SELECT name, min(request_id) AS maker FROM q WHERE regexp_matches(name, '{_NAME_RX}')
          AND name NOT IN (SELECT name FROM c) GROUP BY name),
        stored AS (SELECT name, title, description, NULL AS maker FROM c UNION ALL
          SELECT f.name, coalesce(title, ''), coalesce(description, ''), maker FROM first f JOIN q ON q.request_id = maker)
        SELECT q.request_id, q.name, CASE WHEN NOT regexp_matches(q.name, '{_NAME_RX}') THEN 'invalid-name'
          WHEN s.maker = q.request_id THEN 'created'
          WHEN coalesce(q.title = s.title, TRUE) AND coalesce(q.description = s.description, TRUE) THEN 'unchanged'
          ELSE 'conflict' END AS outcome FROM q LEFT JOIN stored s USING (name)""",
    "collection_add": _CADD + "SELECT request_id, seq, name, ref, outcome FROM outcomes",
    "collection_add_members": _CADD + """SELECT * FROM members UNION ALL
        SELECT o.name, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY o.name ORDER BY request_id, seq) AS INT),
          ref, stamp
        FROM outcomes o LEFT JOIN (SELECT name, max(pos) AS top FROM members GROUP BY name) m ON m.name = o.name
        WHERE outcome = 'added'""",
    "collection_remove": _COLL + """,
        r AS (SELECT request_id, q.name, q.ref, m.ref IS NOT NULL AS present,
            CASE WHEN m.ref IS NULL AND l.compiled IS NULL THEN 'unknown-artifact' END AS f
          FROM requests q LEFT JOIN located l ON l.ref = q.ref LEFT JOIN members m ON m.name = q.name AND m.ref = q.ref)
        SELECT request_id, name, ref, CASE WHEN min(f) OVER (PARTITION BY request_id) IS NOT NULL THEN 'unknown-artifact'
          WHEN present THEN 'removed' ELSE 'unchanged' END AS outcome FROM r""",
    "collection_show": f"""WITH {_LIB}, members AS ({MEMBERS})
        SELECT m.name, m.pos, m.ref, {_STATUS.format(t='m')} AS status FROM members m LEFT JOIN located l USING (ref)""",
    "collection_list": f"""WITH c AS ({COLLECTIONS}), members AS ({MEMBERS})
        SELECT c.name, c.title, c.description, count(m.ref) AS n_members FROM c LEFT JOIN members m USING (name)
        WHERE regexp_matches(c.name, '{_NAME_RX}') GROUP BY ALL""",
    "registry_validation": f"""
        WITH q AS ({TAG_REQUESTS}), t AS (SELECT CASE WHEN request_id % 11 = 0 THEN upper(ref) ELSE ref END AS ref,
          CASE WHEN request_id % 12 <> 0 THEN 'gen' END AS compiled, tag FROM q),
        m AS ({MEMBER_REQUESTS}),
        f AS (SELECT 'tag' AS "table", ref, unnest([CASE WHEN NOT regexp_matches(ref, '{_REF_RX}') THEN 'malformed reference' END,
            CASE WHEN compiled IS NULL THEN 'no stamp' END,
            CASE WHEN NOT regexp_matches(tag, '{_NAME_RX}') THEN 'invalid tag name' END]) AS fault FROM t
          UNION ALL SELECT 'member', ref, 'listed twice' FROM m GROUP BY name, ref HAVING count(*) > 1)
        SELECT "table", ref, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY ALL""",
}
