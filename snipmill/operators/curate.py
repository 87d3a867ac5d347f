"""Tags, collections and references as tables.

Files are ``(ref, state, compiled)``; tags ``(ref, compiled, tag)``;
collections ``(name, title, description)``; members ``(name, pos, ref,
compiled)``. Operations take batches of requests and give back one row per
requested item with its ``outcome``, next to the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import text as T
from snipmill.operators.running import add_rank, join_status


def ref_of(arg: Column) -> Column:
    """``<kind>/<file>`` of a short or library-relative form; NULL when neither."""
    inner = F.regexp_extract(arg, fixed.STATE_PREFIX, 1)
    return F.when(arg.rlike(fixed.REF_RULE), arg).when(inner.rlike(fixed.REF_RULE), inner)


def parse_artifact_ref(args: DataFrame) -> DataFrame:
    return args.withColumn("ref", ref_of(F.col("arg")))


def validate_name(names: DataFrame) -> DataFrame:
    """Whether a name is a legal tag or collection name, and a legal one to try."""
    valid = F.coalesce(F.col("name").rlike(fixed.NAME_RULE), F.lit(False))
    return names.withColumn("valid", valid).withColumn(
        "suggestion", F.when(~valid, T.slug(F.col("name"), 48))
    )


def locate_artifact(files: DataFrame) -> DataFrame:
    """Where each ref lives: draft, approved, or ambiguous when in both."""
    found = files.groupBy("ref").agg(
        F.count("*").alias("n"), F.max("state").alias("state"), F.max("compiled").alias("compiled")
    )
    return found.select(
        "ref", F.when(F.col("n") > 1, "ambiguous").otherwise(F.col("state")).alias("state"),
        F.when(F.col("n") == 1, F.col("compiled")).alias("compiled"),
    )


def reference_status(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Status of stored references: draft, approved, stale, missing or ambiguous."""
    now = locate_artifact(files).select(
        "ref", F.col("state").alias("_state"), F.col("compiled").alias("_now")
    )
    return refs.join(now, "ref", "left").withColumn(
        "status",
        F.when(F.col("_state").isNull(), "missing")
        .when(F.col("_state") == "ambiguous", "ambiguous")
        .when(F.col("_now") == F.col("compiled"), F.col("_state")).otherwise("stale"),
    ).drop("_state", "_now")


# ---- tags ----------------------------------------------------------------------
def _whole_request(rows: DataFrame) -> DataFrame:
    """A fault in one item refuses every item of its request."""
    faults = rows.where(F.col("fault").isNotNull()).groupBy("request_id").agg(
        F.min("fault").alias("request_fault")
    )
    return rows.drop("fault").join(faults, "request_id", "left")


def _tag_status(requests: DataFrame, tags: DataFrame, refs: DataFrame) -> DataFrame:
    """A row for each asked (ref, tag): what ``refs`` (a row a ref) says, and whether the tag is there."""
    present = tags.select("ref", "tag").distinct().withColumn("_present", F.lit(True))
    return requests.select("ref", "tag").distinct().join(refs, "ref", "left").join(present, ["ref", "tag"], "left")


def tag_add(tags: DataFrame, requests: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, tags)`` after adding ``requests(request_id, ref, tag)``.

    An invalid tag, an unknown file or a stale entry refuses the request; a tag
    already there is unchanged. Of equal additions the first request adds.
    """
    now = locate_artifact(files).select("ref", F.col("state").alias("_state"), F.col("compiled").alias("_now"))
    held = tags.groupBy("ref").agg(F.max("compiled").alias("_held"))
    rows = (
        join_status(requests, _tag_status(requests, tags, now.join(held, "ref", "full")), ["ref", "tag"])
        .withColumn("fault", T.first_of([
            (~F.col("tag").rlike(fixed.NAME_RULE), "invalid-name"),
            (F.col("_state").isNull(), "unknown-artifact"),
            (F.col("_state") == "ambiguous", "ambiguous-artifact"),
            (F.col("_now").isNull(), "unknown-artifact"),
            (F.col("_held") != F.col("_now"), "stale-reference"),
        ]))
    )
    judged = _whole_request(rows)
    open_row = F.col("request_fault").isNull() & F.col("_present").isNull()
    first = judged.where(open_row).groupBy("ref", "tag").agg(F.min("request_id").alias("_first"))
    outcomes = judged.join(first, ["ref", "tag"], "left").withColumn(
        "outcome",
        F.when(F.col("request_fault").isNotNull(), F.col("request_fault"))
        .when(open_row & (F.col("_first") == F.col("request_id")), "added").otherwise("unchanged"),
    )
    added = outcomes.where(F.col("outcome") == "added").select(
        "ref", F.col("_now").alias("compiled"), "tag").distinct()
    return (
        outcomes.select("request_id", "ref", "tag", "outcome"),
        tags.select("ref", "compiled", "tag").distinct().unionByName(added),
    )


def tag_remove(tags: DataFrame, requests: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, tags)`` after removing tags; stale and missing refs may be cleaned."""
    known = tags.select("ref").distinct().withColumn("_tagged", F.lit(True))
    alive = locate_artifact(files).where(F.col("compiled").isNotNull()).select(
        "ref", F.lit(True).alias("_alive"))
    rows = join_status(
        requests, _tag_status(requests, tags, known.join(alive, "ref", "full")), ["ref", "tag"]
    ).withColumn("fault", T.first_of([
        (~F.col("tag").rlike(fixed.NAME_RULE), "invalid-name"),
        (F.col("_tagged").isNull() & F.col("_alive").isNull(), "unknown-artifact"),
    ]))
    judged = _whole_request(rows)
    open_row = F.col("request_fault").isNull() & F.col("_present").isNotNull()
    first = judged.where(open_row).groupBy("ref", "tag").agg(F.min("request_id").alias("_first"))
    outcomes = judged.join(first, ["ref", "tag"], "left").withColumn(
        "outcome",
        F.when(F.col("request_fault").isNotNull(), F.col("request_fault"))
        .when(open_row & (F.col("_first") == F.col("request_id")), "removed").otherwise("unchanged"),
    )
    return (
        outcomes.select("request_id", "ref", "tag", "outcome"),
        tags.join(first.select("ref", "tag"), ["ref", "tag"], "left_anti"),
    )


def artifacts_with_tag(tags: DataFrame, files: DataFrame) -> DataFrame:
    """Every tag with the refs that carry it and their status."""
    return reference_status(tags.select("tag", "ref", "compiled").distinct(), files)


def tag_index(tags: DataFrame) -> DataFrame:
    """Inverted index in long form, ``(tag, ref, n_refs)``; no tag is one huge row."""
    pairs = tags.select("tag", "ref").distinct()
    counts = pairs.groupBy("tag").agg(F.count("*").alias("n_refs"))
    return pairs.join(counts, "tag")


# ---- collections -----------------------------------------------------------------
def collection_create(collections: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, collections)`` for ``requests(request_id, name, title, description)``.

    The first request of a new name creates it; a later one is unchanged when
    what it gives equals what is stored, else a conflict.
    """
    legal = requests.where(F.col("name").rlike(fixed.NAME_RULE))
    maker = legal.groupBy("name").agg(
        F.min(F.struct("request_id", "title", "description")).alias("first")
    ).join(collections.select("name"), "name", "left_anti")
    made = maker.select(
        "name", F.coalesce("first.title", F.lit("")).alias("title"),
        F.coalesce("first.description", F.lit("")).alias("description"),
        F.col("first.request_id").alias("_maker"),
    )
    stored = collections.select("name", "title", "description").withColumn(
        "_maker", F.lit(None).cast(requests.schema["request_id"].dataType)
    ).unionByName(made)
    held = stored.select("name", F.col("title").alias("_title"),
                         F.col("description").alias("_description"), "_maker")
    same = (F.coalesce(F.col("title") == F.col("_title"), F.lit(True))
            & F.coalesce(F.col("description") == F.col("_description"), F.lit(True)))
    outcomes = requests.join(held, "name", "left").withColumn(
        "outcome",
        F.when(~F.col("name").rlike(fixed.NAME_RULE), "invalid-name")
        .when(F.col("_maker") == F.col("request_id"), "created")
        .when(same, "unchanged").otherwise("conflict"),
    )
    return outcomes.select("request_id", "name", "outcome"), stored.drop("_maker")


def collection_add(collections: DataFrame, members: DataFrame, requests: DataFrame,
                   files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, members)`` after appending ``requests(request_id, seq, name, ref)``.

    One unknown or stale ref refuses its whole request. New members follow the
    present ones in request order; the first occurrence counts.
    """
    now = locate_artifact(files).select("ref", F.col("state").alias("_state"), F.col("compiled").alias("_now"))
    held = members.select("name", "ref", F.col("compiled").alias("_held"))
    known = collections.select("name", F.lit(True).alias("_known"))
    rows = requests.join(known, "name", "left").join(now, "ref", "left").join(
        held, ["name", "ref"], "left"
    ).withColumn("fault", T.first_of([
        (F.col("_known").isNull(), "unknown-collection"),
        (F.col("_state").isNull(), "unknown-artifact"),
        (F.col("_state") == "ambiguous", "ambiguous-artifact"),
        (F.col("_now").isNull(), "unknown-artifact"),
        (F.col("_held") != F.col("_now"), "stale-reference"),
    ]))
    judged = _whole_request(rows)
    open_row = F.col("request_fault").isNull() & F.col("_held").isNull()
    first = judged.where(open_row).groupBy("name", "ref").agg(
        F.min(F.struct("request_id", "seq")).alias("_first"), F.max("_now").alias("compiled"))
    outcomes = judged.join(first.drop("compiled"), ["name", "ref"], "left").withColumn(
        "outcome",
        F.when(F.col("request_fault").isNotNull(), F.col("request_fault"))
        .when(open_row & (F.col("_first") == F.struct("request_id", "seq")), "added")
        .otherwise("unchanged"),
    )
    last = members.groupBy("name").agg(F.max("pos").alias("_last"))
    new = first.select("name", "ref", "compiled", F.col("_first.request_id").alias("request_id"),
                       F.col("_first.seq").alias("seq"))
    placed = add_rank(new, ["name"], ["request_id", "seq"], "rank").join(last, "name", "left").select(
        "name", (F.coalesce("_last", F.lit(0)) + F.col("rank")).cast("int").alias("pos"), "ref", "compiled")
    return (
        outcomes.select("request_id", "seq", "name", "ref", "outcome"),
        members.select("name", F.col("pos").cast("int").alias("pos"), "ref", "compiled").unionByName(placed),
    )


def collection_remove(members: DataFrame, requests: DataFrame, files: DataFrame
                      ) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, members)`` after removing ``requests(request_id, name, ref)``.

    Others keep their order. A ref that is neither a member nor a live file
    refuses its whole request.
    """
    alive = locate_artifact(files).where(F.col("compiled").isNotNull()).select(
        "ref", F.lit(True).alias("_alive"))
    present = members.select("name", "ref", F.lit(True).alias("_present"))
    rows = requests.join(alive, "ref", "left").join(present, ["name", "ref"], "left").withColumn(
        "fault", F.when(F.col("_present").isNull() & F.col("_alive").isNull(), "unknown-artifact"))
    judged = _whole_request(rows)
    outcomes = judged.withColumn(
        "outcome",
        F.when(F.col("request_fault").isNotNull(), F.col("request_fault"))
        .when(F.col("_present"), "removed").otherwise("unchanged"),
    )
    gone = outcomes.where(F.col("outcome") == "removed").select("name", "ref").distinct()
    return (
        outcomes.select("request_id", "name", "ref", "outcome"),
        members.join(gone, ["name", "ref"], "left_anti"),
    )


def collection_show(members: DataFrame, files: DataFrame) -> DataFrame:
    """Members with their place and status."""
    return reference_status(members.select("name", "pos", "ref", "compiled"), files)


def collection_list(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Collections with member counts; names that are not legal are not collections."""
    counts = members.groupBy("name").agg(F.count("ref").alias("n_members"))
    legal = collections.where(F.col("name").rlike(fixed.NAME_RULE))
    return legal.join(counts, "name", "left").select(
        "name", "title", "description", F.coalesce("n_members", F.lit(0)).alias("n_members"))


def registry_validation(tags: DataFrame, members: DataFrame) -> DataFrame:
    """Faults of stored tags and members, with the number of rows each concerns."""
    tag_faults = tags.select(F.lit("tag").alias("table"), "ref", F.explode(F.array_compact(F.array(
        F.when(~F.col("ref").rlike(fixed.REF_RULE), F.lit("malformed reference")),
        F.when(F.coalesce("compiled", F.lit("")) == "", F.lit("no stamp")),
        F.when(F.col("tag").isNull(), F.lit("no tags")),
        F.when(~F.col("tag").rlike(fixed.NAME_RULE), F.lit("invalid tag name")),
    ))).alias("fault"))
    member_faults = members.select(F.lit("member").alias("table"), "ref", F.explode(F.array_compact(F.array(
        F.when(~F.col("ref").rlike(fixed.REF_RULE), F.lit("malformed reference")),
        F.when(F.coalesce("compiled", F.lit("")) == "", F.lit("no stamp")),
        F.when(~F.col("name").rlike(fixed.NAME_RULE), F.lit("invalid collection name")),
    ))).alias("fault"))
    twice = members.groupBy("name", "ref").agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit("member").alias("table"), "ref", F.lit("listed twice").alias("fault"))
    return tag_faults.unionByName(member_faults).unionByName(twice).groupBy("table", "ref", "fault").agg(
        F.count("*").alias("n"))
