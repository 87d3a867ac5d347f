"""Governed records: artifacts, revisions, manifests, verifications, approvals,
publications. Each operator takes tables and a batch of requests; refusals are
rows with a code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import text as T
from snipmill.operators.running import join_status
from snipmill.session import cut_lineage, written

#: Ids of a batch that are broadcast to cut the stores down.
FEW = 20_000
SCHEMAS = "record"  # prefix of schema names in manifests


# ---- predicates --------------------------------------------------------------
def is_id(value: Column, prefix: str) -> Column:
    return F.coalesce(value.rlike(rf"^{prefix}_{fixed.ID_BODY}\z"), F.lit(False))


def is_hash(value: Column) -> Column:
    return F.coalesce(value.rlike(fixed.HASH_RULE), F.lit(False))


def is_safe_path(value: Column) -> Column:
    """Relative POSIX path without empty, dot or dot-dot parts and control characters."""
    bad = (
        (value == "") | value.startswith("/") | value.contains("\\")
        | value.rlike(r"[\x00-\x1f\x7f]") | (value != T.strip(value))
        | F.exists(F.split(value, "/", -1), lambda p: p.isin("", ".", ".."))
    )
    return F.coalesce(~bad, F.lit(False))


def new_id(prefix: str, seed: Column) -> Column:
    """An id of the right form that follows from ``seed``, so a retry gives the same one.

    Hex digits are legal id characters; the leading 0 keeps the time part in range.
    """
    return F.concat(F.lit(f"{prefix}_0"), F.upper(F.substring(F.sha2(F.concat(F.lit(prefix), seed), 256), 1, 25)))


def validate_ids(rows: DataFrame) -> DataFrame:
    """Faults of ``(record_id, prefix, content_hash, path, title)`` per row."""
    prefix_ok = F.col("record_id").rlike(rf"^[a-z]+_{fixed.ID_BODY}\z") & (
        F.substring_index("record_id", "_", 1) == F.col("prefix"))
    return rows.withColumn("violations", F.array_compact(F.array(
        F.when(~F.coalesce(prefix_ok, F.lit(False)), F.lit("id")),
        F.when(~is_hash(F.col("content_hash")), F.lit("hash")),
        F.when(~is_safe_path(F.col("path")), F.lit("path")),
        F.when(F.coalesce("title", F.lit("")) == "", F.lit("title")),
    )))


# ---- canonical JSON -------------------------------------------------------------
def canonical_hash(document: Column) -> Column:
    """``sha256:`` hash of JSON text whose keys are in order; non-ASCII is kept."""
    return F.concat(F.lit("sha256:"), F.sha2(document, 256))


def manifest_json(artifact_id: Column, revision_id: Column, entries: Column) -> Column:
    """Canonical manifest; every struct lists its fields in key order."""
    ordered = F.transform(entries, lambda e: F.struct(
        e["executable"].alias("executable"), e["media_type"].alias("media_type"),
        e["path"].alias("path"), e["sha256"].alias("sha256"), e["size"].alias("size")))
    return F.to_json(F.struct(
        artifact_id.alias("artifact_id"), ordered.alias("entries"), revision_id.alias("revision_id"),
        F.lit(f"{SCHEMAS}.content-manifest").alias("schema"), F.lit(1).alias("schema_version"),
    ))


# ---- revisions --------------------------------------------------------------------
def create_revisions(requests: DataFrame, artifacts: DataFrame, created_at: Column
                     ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(revisions, new_artifacts, verifications, refused)`` for a batch.

    Requests are ``(request_id, artifact_id, title, content, content_path,
    source_hash, source_kind, verification_state, media_type, created_by)``;
    NULL means the default. ``artifacts(id, lifecycle)`` are the known ones.
    """
    default = F.coalesce
    known = artifacts.select(F.col("id").alias("artifact_id"), F.col("lifecycle").alias("_life"))
    content = F.col("content")
    rows = requests.join(known, "artifact_id", "left").withColumns({
        "content_path": default("content_path", F.lit(fixed.DEFAULT_CONTENT_PATH)),
        "media_type": default("media_type", F.lit(fixed.DEFAULT_MEDIA_TYPE)),
        "source_kind": default("source_kind", F.lit("operator_input")),
        "verification_state": default("verification_state", F.lit("not_required")),
        "size": F.octet_length(content),
        "actual_hash": F.concat(F.lit("sha256:"), F.sha2(content, 256)),
    }).withColumn("source_hash", default("source_hash", "actual_hash"))
    given = F.col("artifact_id").isNotNull()
    judged = rows.withColumn("code", T.first_of([
        (default(content, F.lit("")) == "", "validation_error"),
        (~is_id(F.col("created_by"), "act"), "validation_error"),
        (~is_safe_path(F.col("content_path")), "validation_error"),
        (~is_hash(F.col("source_hash")), "validation_error"),
        (F.col("source_hash") != F.col("actual_hash"), "content_hash_mismatch"),
        (~F.col("source_kind").isin(*fixed.SOURCE_KINDS), "validation_error"),
        (~F.col("verification_state").isin(*fixed.VERIFICATION_STATES), "validation_error"),
        (~given & (default("title", F.lit("")) == ""), "validation_error"),
        (given & ~is_id(F.col("artifact_id"), "art"), "validation_error"),
        (given & F.col("_life").isNull(), "artifact_not_found"),
        (F.col("_life") != "active", "validation_error"),
    ]))
    seed = F.col("request_id").cast("string")
    made = judged.where(F.col("code").isNull()).withColumns({
        "new_artifact": ~given, "artifact_id": default("artifact_id", new_id("art", seed)),
        "revision_id": new_id("rev", seed), "created_at": created_at,
    })
    entry = F.struct(
        F.lit(True).alias("executable"), "media_type", F.col("content_path").alias("path"),
        F.col("actual_hash").alias("sha256"), "size")
    made = made.withColumn("entries", F.array(entry)).withColumn(
        "manifest", manifest_json(F.col("artifact_id"), F.col("revision_id"), F.col("entries"))
    ).withColumn("content_hash", canonical_hash(F.col("manifest")))
    revisions = made.select(
        F.col("revision_id").alias("id"), "request_id", "artifact_id", F.lit("script").alias("artifact_type"),
        "content_hash", "manifest", "entries", "source_kind", "source_hash", "created_by", "created_at",
        F.lit(1).alias("record_version"),
        F.concat(F.lit("revisions/"), "revision_id", F.lit("/content-manifest.json")).alias("manifest_path"),
    )
    new_artifacts = made.where("new_artifact").select(
        F.col("artifact_id").alias("id"), "title", F.lit("script").alias("artifact_type"),
        F.lit("active").alias("lifecycle"), "created_by", "created_at", F.lit(1).alias("record_version"))
    verifications = made.select(
        new_id("ver", seed).alias("id"), "revision_id", "content_hash", "verification_state",
        "created_by", "created_at", F.lit(1).alias("record_version"))
    return revisions, new_artifacts, verifications, judged.where(F.col("code").isNotNull()).select(
        "request_id", "code")


def verify_manifest(revisions: DataFrame, contents: DataFrame) -> DataFrame:
    """First integrity failure per revision; NULL when all of it holds.

    ``revisions(id, artifact_id, content_hash, manifest)`` with the stored
    manifest text, ``contents(revision_id, path, content)`` with stored bytes.
    Content is hashed where it lies; only hashes are joined. Failures combine
    map-side, so a revision with very many entries is no hot group.
    """
    parsed = F.from_json(
        "manifest",
        "artifact_id string, revision_id string, entries array<struct<executable boolean,"
        "media_type string, path string, sha256 string, size bigint>>",
    )
    rows = revisions.select("id", "artifact_id", "content_hash", "manifest", parsed.alias("m"))
    paths = F.col("m.entries.path")
    whole = rows.withColumn("own", T.first_of([
        (F.col("manifest").isNull(), "manifest is missing"),
        (canonical_hash(F.col("manifest")) != F.col("content_hash"), "manifest hash does not match"),
        (~(F.col("m.artifact_id").eqNullSafe(F.col("artifact_id"))
           & F.col("m.revision_id").eqNullSafe(F.col("id"))), "manifest identity does not match"),
        ((F.array_sort(paths) != paths) | (F.size(F.array_distinct(paths)) != F.size(paths)),
         "manifest paths are not unique and sorted"),
    ]))
    stored = contents.select(
        F.col("revision_id").alias("id"), "path", F.octet_length("content").alias("_size"),
        F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("_sha"))
    # Rows that already failed are not filtered here: a filter would parse the
    # manifest a second time, and their own failure wins below anyway.
    entries = whole.select("id", F.posexplode("m.entries").alias("at", "e")).select(
        "id", "at", "e.path", "e.size", "e.sha256")
    bad = entries.join(stored, ["id", "path"], "left").where(
        F.col("_sha").isNull() | (F.col("_size") != F.col("size")) | (F.col("_sha") != F.col("sha256"))
    ).groupBy("id").agg(F.min(F.struct("at", "path", F.col("_sha").isNull().alias("gone"))).alias("b"))
    return whole.select("id", "own").join(bad, "id", "left").select(
        "id",
        F.when(F.col("own").isNotNull(), F.col("own"))
        .when(F.col("b.gone"), F.concat(F.lit("content is missing: "), "b.path"))
        .when(F.col("b").isNotNull(), F.concat(F.lit("content hash does not match: "), "b.path"))
        .alias("failure"),
    )


def bound_record(requests: DataFrame, revisions: DataFrame, integrity: DataFrame, *, prefix: str,
                 state: str, states: tuple[str, ...], created_at: Column
                 ) -> tuple[DataFrame, DataFrame]:
    """``(records, refused)``: append-only rows bound to a revision and its hash.

    Serves verification and approval requests ``(request_id, revision_id,
    created_by, <state>, reason)`` alike.
    """
    known = revisions.select(F.col("id").alias("revision_id"), "content_hash").join(
        integrity.select(F.col("id").alias("revision_id"), "failure"), "revision_id", "left")
    asked = requests.select("revision_id").distinct()
    rows = join_status(requests, asked.join(known, "revision_id", "left"), ["revision_id"]).withColumn("code", T.first_of([
        (~is_id(F.col("revision_id"), "rev"), "validation_error"),
        (~is_id(F.col("created_by"), "act"), "validation_error"),
        (F.col("content_hash").isNull(), "revision_not_found"),
        (F.col("failure").isNotNull(), "content_hash_mismatch"),
        (F.col("reason") == "", "validation_error"),
        (~F.coalesce(F.col(state).isin(*states), F.lit(False)), "validation_error"),
    ]))
    records = rows.where(F.col("code").isNull()).select(
        new_id(prefix, F.col("request_id").cast("string")).alias("id"), "revision_id", "content_hash",
        state, "reason", "created_by", created_at.alias("created_at"), F.lit(1).alias("record_version"))
    return records, rows.where(F.col("code").isNotNull()).select("request_id", "code")


def record_verification(requests: DataFrame, revisions: DataFrame, integrity: DataFrame,
                        created_at: Column) -> tuple[DataFrame, DataFrame]:
    return bound_record(requests, revisions, integrity, prefix="ver", state="verification_state",
                        states=fixed.VERIFICATION_STATES, created_at=created_at)


def record_approval(requests: DataFrame, revisions: DataFrame, integrity: DataFrame,
                    created_at: Column) -> tuple[DataFrame, DataFrame]:
    return bound_record(
        requests.withColumn("approval_state", F.coalesce("approval_state", F.lit("approved"))),
        revisions, integrity, prefix="apr", state="approval_state", states=fixed.APPROVAL_STATES,
        created_at=created_at)


# ---- what a batch of requests asks for -----------------------------------------------------
def asked_records(requests: DataFrame, revisions: DataFrame, contents: DataFrame, verifications: DataFrame,
                  approvals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(revisions, integrity, governance)`` of the revisions that ``requests`` name, and of no others.

    A few ids (``FEW``) are broadcast and cut the stores down before anything is hashed or folded, so a small batch costs
    what it asks for. For more of them a cut would send whole records to the ids; so records are folded, and contents
    hashed, where they lie, and only what comes out meets the ids. Null ids ask for nothing.
    """
    asked = written(requests.select("revision_id").where(F.col("revision_id").isNotNull()).distinct(), "asked")
    ids = asked.withColumnRenamed("revision_id", "id")
    if asked.count() <= FEW:
        some = revisions.join(F.broadcast(ids), "id", "left_semi")

        def of(records: DataFrame) -> DataFrame:
            return records.join(F.broadcast(asked), "revision_id", "left_semi")

        return some, verify_manifest(some, of(contents)), governance_binding(some, of(verifications), of(approvals))
    return tuple(rows.join(ids, "id", "left_semi") for rows in (
        revisions, verify_manifest(revisions, contents), governance_binding(revisions, verifications, approvals)))


def asked_by_publication(requests: DataFrame, publications: DataFrame, revisions: DataFrame, contents: DataFrame
                         ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(publications, revisions, integrity)`` that requests by publication lead to."""
    asked = requests.select(F.col("publication_id").alias("id")).distinct()
    pubs = cut_lineage(publications.join(asked, "id", "left_semi"))
    some = revisions.join(pubs.select(F.col("revision_id").alias("id")).distinct(), "id", "left_semi")
    stored = contents.join(pubs.select("revision_id").distinct(), "revision_id", "left_semi")
    return pubs, some, verify_manifest(some, stored)


def _channel_status(requests: DataFrame, known: DataFrame, publications: DataFrame) -> DataFrame:
    """A row for each asked (revision_id, channel): what is known of the revision, and its publication there.

    Publications are folded where they lie, and only then meet the pairs.
    """
    pairs = requests.select("revision_id", "channel").distinct()
    published = publication_lookup(publications).select(
        "revision_id", "channel", F.col("id").alias("_pub"), F.col("publication_state").alias("_pub_state"),
        F.col("content_hash").alias("_pub_hash"))
    return pairs.join(known, "revision_id", "left").join(published, ["revision_id", "channel"], "left")


# ---- latest records ---------------------------------------------------------------------
def latest_record(records: DataFrame) -> DataFrame:
    """Per revision the record with the greatest (created_at, id), compared as strings."""
    others = [c for c in records.columns if c != "revision_id"]
    # One struct that starts with the order: rows are sorted for this, so nothing should be in them twice.
    ahead = ["created_at", "id"]
    return records.groupBy("revision_id").agg(
        F.max(F.struct(*ahead, *[c for c in others if c not in ahead])).alias("r")
    ).select("revision_id", *[F.col("r")[c].alias(c) for c in others])


def governance_binding(revisions: DataFrame, verifications: DataFrame, approvals: DataFrame) -> DataFrame:
    """Latest states per revision; ``violation`` when a record names another hash."""
    def last(records: DataFrame, state: str, label: str) -> DataFrame:
        return latest_record(records).select(
            F.col("revision_id").alias("id"), state, F.col("content_hash").alias(f"_{label}"))

    joined = revisions.select("id", "content_hash").join(
        last(verifications, "verification_state", "v"), "id", "left").join(
        last(approvals, "approval_state", "a"), "id", "left")
    return joined.select(
        "id", "verification_state", "approval_state", T.first_of([
            (F.col("_v") != F.col("content_hash"), "verification record is not bound to the revision"),
            (F.col("_a") != F.col("content_hash"), "approval record is not bound to the revision"),
        ]).alias("violation"))


def publication_lookup(publications: DataFrame) -> DataFrame:
    """The publication with the highest id per (revision, channel)."""
    return publications.groupBy("revision_id", "channel").agg(
        F.max_by(F.struct("id", "publication_state", "content_hash", "record_version"), "id").alias("p")
    ).select("revision_id", "channel", "p.*")


# ---- publish and withdraw ------------------------------------------------------------------
def publish(requests: DataFrame, revisions: DataFrame, integrity: DataFrame, governance: DataFrame,
            publications: DataFrame, created_at: Column) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, new_publications)`` for ``(request_id, revision_id, channel, created_by)``.

    A published revision is given back, a withdrawn one refused. Of several
    requests for one revision in a batch the first creates the publication.
    """
    known = revisions.select(F.col("id").alias("revision_id"), "artifact_id", "content_hash").join(
        integrity.select(F.col("id").alias("revision_id"), "failure"), "revision_id", "left").join(
        governance.withColumnRenamed("id", "revision_id"), "revision_id", "left")
    rows = join_status(requests, _channel_status(requests, known, publications), ["revision_id", "channel"])
    state_ok = F.coalesce(F.col("verification_state").isin(*fixed.EXECUTABLE_STATES), F.lit(False))
    judged = rows.withColumn("code", T.first_of([
        (~is_id(F.col("revision_id"), "rev"), "validation_error"),
        (~is_id(F.col("created_by"), "act"), "validation_error"),
        (~F.col("channel").eqNullSafe(F.lit(fixed.EXECUTION_CHANNEL)), "validation_error"),
        (F.col("content_hash").isNull(), "revision_not_found"),
        (F.col("failure").isNotNull(), "content_hash_mismatch"),
        (F.col("_pub_state") == "published", "existing"),
        (F.col("_pub").isNotNull(), "publication_withdrawn"),
        (F.col("violation").isNotNull(), "security_violation"),
        (~state_ok, "verification_failed"),
        (~F.col("approval_state").eqNullSafe(F.lit("approved")), "approval_revoked"),
    ]))
    first = judged.where(F.col("code").isNull()).groupBy("revision_id", "channel").agg(
        F.min("request_id").alias("_first"))
    made_id = new_id("pub", F.col("_first").cast("string"))
    settled = join_status(judged, first, ["revision_id", "channel"])
    outcomes = settled.select(
        "request_id",
        F.when(F.col("code").isNull(), F.when(F.col("_first") == F.col("request_id"), "published")
               .otherwise("existing")).otherwise(F.col("code")).alias("outcome"),
        F.when(F.col("code").isNull(), made_id).when(F.col("code") == "existing", F.col("_pub"))
        .alias("publication_id"),
    )
    new = settled.where(F.col("code").isNull() & (F.col("_first") == F.col("request_id"))).select(
        made_id.alias("id"), "revision_id", "artifact_id", "content_hash", "channel",
        F.lit("published").alias("publication_state"), "created_by", created_at.alias("created_at"),
        F.lit(1).alias("record_version"))
    return outcomes, new


def withdraw(requests: DataFrame, publications: DataFrame, withdrawn_at: Column
             ) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, publications)`` after withdrawing; already withdrawn rows stay as they are.

    Of several requests for one publication the first legal one withdraws it.
    """
    current = publications.select(F.col("id").alias("publication_id"), "publication_state")
    rows = requests.join(current, "publication_id", "left").withColumn("code", T.first_of([
        (~is_id(F.col("publication_id"), "pub"), "validation_error"),
        (~is_id(F.col("created_by"), "act"), "validation_error"),
        (F.col("publication_state").isNull(), "artifact_not_published"),
        (F.col("publication_state") == "withdrawn", "unchanged"),
        (F.coalesce("reason", F.lit("")) == "", "validation_error"),
    ]))
    first = rows.where(F.col("code").isNull()).groupBy("publication_id").agg(
        F.min(F.struct("request_id", "reason")).alias("_first"))
    # A request after the first one meets a withdrawn publication.
    after = F.col("_first").isNotNull() & (F.col("_first.request_id") < F.col("request_id"))
    outcomes = rows.join(first, "publication_id", "left").select(
        "request_id",
        F.when(F.col("code").isNull() & ~after, "withdrawn")
        .when(after & is_id(F.col("created_by"), "act"), "unchanged")
        .otherwise(F.col("code")).alias("outcome"))
    changed = first.select(F.col("publication_id").alias("id"), F.col("_first.reason").alias("_reason"))
    joined = publications.join(changed, "id", "left")
    hit = F.col("_reason").isNotNull()
    updated = joined.withColumns({
        "publication_state": F.when(hit, "withdrawn").otherwise(F.col("publication_state")),
        "record_version": F.when(hit, F.col("record_version") + 1).otherwise(F.col("record_version")),
        "withdrawn_at": F.when(hit, withdrawn_at), "withdrawal_reason": F.col("_reason"),
    }).drop("_reason")
    return outcomes, updated


def resolve_publication(requests: DataFrame, publications: DataFrame, revisions: DataFrame,
                        integrity: DataFrame) -> DataFrame:
    """Publication to revision to manifest for ``(request_id, publication_id)``."""
    pubs = publications.select(
        F.col("id").alias("publication_id"), "revision_id", "publication_state",
        F.col("content_hash").alias("_pub_hash"))
    revs = revisions.select(F.col("id").alias("revision_id"), "content_hash", "manifest").join(
        integrity.select(F.col("id").alias("revision_id"), "failure"), "revision_id", "left")
    asked = requests.select("publication_id").distinct()
    rows = join_status(requests, asked.join(pubs, "publication_id", "left").join(revs, "revision_id", "left"), ["publication_id"])
    code = T.first_of([
        (~is_id(F.col("publication_id"), "pub"), "validation_error"),
        (F.col("publication_state").isNull(), "artifact_not_published"),
        (F.col("publication_state") == "withdrawn", "publication_withdrawn"),
        (F.col("content_hash").isNull(), "revision_not_found"),
        (F.col("failure").isNotNull(), "content_hash_mismatch"),
        (F.col("_pub_hash") != F.col("content_hash"), "content_hash_mismatch"),
    ])
    return rows.withColumn("code", code).select(
        "request_id", "code", F.when(F.col("code").isNull(), F.col("revision_id")).alias("revision_id"),
        F.when(F.col("code").isNull(), F.col("manifest")).alias("manifest"))


def execution_eligibility(requests: DataFrame, revisions: DataFrame, integrity: DataFrame,
                          governance: DataFrame, publications: DataFrame) -> DataFrame:
    """First failing rule per ``(request_id, revision_id, content_hash, channel, entrypoint)``.

    ``revisions`` carry ``artifact_type`` and the manifest ``entries``. The
    order of the rules is the answer: the first one that fails gives the code.
    """
    revs = revisions.select(
        F.col("id").alias("revision_id"), "artifact_type", "entries", F.col("content_hash").alias("_hash")
    ).join(integrity.select(F.col("id").alias("revision_id"), "failure"), "revision_id", "left").join(
        governance.withColumnRenamed("id", "revision_id"), "revision_id", "left")
    rows = join_status(requests, _channel_status(requests, revs, publications), ["revision_id", "channel"])
    state_ok = F.coalesce(F.col("verification_state").isin(*fixed.EXECUTABLE_STATES), F.lit(False))
    runs = F.exists("entries", lambda e: (e["path"] == F.col("entrypoint")) & e["executable"])
    code = T.first_of([
        (~is_id(F.col("revision_id"), "rev"), "validation_error"),
        (F.col("_hash").isNull(), "revision_not_found"),
        (F.col("failure").isNotNull(), "content_hash_mismatch"),
        (F.col("_hash") != F.col("content_hash"), "content_hash_mismatch"),
        (F.col("_pub_state").isNull(), "artifact_not_published"),
        (F.col("_pub_state") == "withdrawn", "publication_withdrawn"),
        (F.col("_pub_hash") != F.col("_hash"), "content_hash_mismatch"),
        (F.col("violation").isNotNull(), "security_violation"),
        (~state_ok, "verification_failed"),
        (~F.col("approval_state").eqNullSafe(F.lit("approved")), "approval_revoked"),
        (F.col("artifact_type") != "script", "unsupported_artifact_type"),
        (~F.coalesce(runs, F.lit(False)), "entrypoint_not_in_manifest"),
    ])
    return rows.withColumn("code", code).select(
        "request_id", F.col("code").isNull().alias("eligible"), "code")


def lifecycle_audit(history: DataFrame, transitions: list[tuple[str, str]] | None = None) -> DataFrame:
    """Illegal state changes in ``history(id, record_version, publication_state)``.

    Versions are numbered, so a row is joined to the version before it instead
    of sorting one record's history in one task.
    """
    legal = fixed.PUBLICATION_TRANSITIONS if transitions is None else transitions
    before = history.select(
        "id", (F.col("record_version") + 1).alias("record_version"),
        F.col("publication_state").alias("from_state"))
    changed = history.join(before, ["id", "record_version"]).where(
        F.col("from_state") != F.col("publication_state"))
    allowed = F.lit(False)
    for a, b in legal:
        allowed = allowed | ((F.col("from_state") == a) & (F.col("publication_state") == b))
    return changed.where(~allowed).select(
        "id", "record_version", "from_state", F.col("publication_state").alias("to_state"))


def scan_records(documents: DataFrame, schema: str) -> DataFrame:
    """Record documents ``(path, text)`` as rows; a file must carry its own id.

    Unreadable documents and documents under another id become ``code`` rows.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.json\z", 1)
    rows = documents.withColumns({"doc": F.from_json("text", schema), "file_id": stem})
    readable = F.try_parse_json("text").isNotNull() & F.schema_of_variant(
        F.try_parse_json("text")).startswith("OBJECT")
    return rows.select(
        "path", "doc.*",
        F.when(~F.coalesce(readable, F.lit(False)), "dependency_unavailable")
        .when(~F.col("doc.id").eqNullSafe(F.col("file_id")), "security_violation").alias("code"))
