"""First free ``name[-N]`` per library, kind and extension.

The k-th draft of a proposal gets the k-th number that is not blocked for it: a rank and a count, no loop.
Blocked are the numbers of names in use and of names that another proposal has got first.
Two proposals can want the same name only if one of them is the other with ``-N`` behind it (``x`` reaches
``x-2`` as its second number, ``x-2`` as its first), and then the earlier draft gets it:

* The first draft of ``x-2`` asks for the bare name at its own place in the order, whatever happens to ``x``.
* ``x`` reaches number N with its draft number (free numbers up to N) - (numbers below N that other
  proposals got first). It is in time if that draft comes before the first one of ``x-N``.

So who gets the name follows from one count per contested number, in the order of numbers. Contests of ``x`` come
before those of ``x-2``, since it may lose its bare name to ``x``: one round for each ``-N`` that names end in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from snipmill import fixed
from snipmill.operators.running import Running, add_rank, add_running, top_position
from snipmill.session import cut_lineage

PLACE = ["namespace", "kind", "extension"]
PROPOSAL = [*PLACE, "name"]
_NUMBER = r"-([2-9]|[1-9][0-9]+)\z"


def _parent(name: Column) -> Column:
    return F.regexp_replace(name, _NUMBER, "")


def _number(name: Column) -> Column:
    """The number that ``name`` is of its parent; NULL if it ends in none that a parent can reach."""
    return F.nullif(F.regexp_extract(name, _NUMBER, 1), F.lit("")).try_cast("bigint")


def _taken_names(taken: DataFrame) -> DataFrame:
    """File names in use, as the proposal that would produce them."""
    stem = F.regexp_replace("filename", r"\.[a-z0-9]+\z", "")
    python = F.col("extension") == ".py"
    rows = taken.select(
        "namespace", "kind",
        F.regexp_extract("filename", r"(\.[a-z0-9]+)\z", 1).alias("extension"), stem.alias("stem"),
    )
    # A Python file never has a dash, so one with a dash cannot clash.
    name = F.when(~python, F.col("stem")).when(
        ~F.col("stem").contains("-"), F.replace("stem", F.lit("_"), F.lit("-"))
    )
    return rows.withColumn("name", name).where(F.col("name").isNotNull()).select(*PROPOSAL).distinct()


def _numbers(names: DataFrame) -> DataFrame:
    """Both proposals that a name blocks, and the number it has for each: itself with 1, its parent with N."""
    number = _number(F.col("name"))
    own = F.struct(F.col("name").alias("name"), F.lit(1).cast("bigint").alias("number"))
    other = F.when(number.isNotNull(), F.struct(_parent(F.col("name")).alias("name"), number.alias("number")))
    return names.select(*PLACE, F.explode(F.array_compact(F.array(own, other))).alias("b")).select(*PLACE, "b.*")


def _contests(rows: DataFrame, firsts: DataFrame, held: DataFrame, order: list[str]) -> DataFrame:
    """Contested names: parent ``name`` and ``number``, the ``child`` that wants it bare, and ``earlier``, the parent's
    drafts before the child's first one. Names in use are not contested."""
    children = firsts.select(*PLACE, _parent(F.col("name")).alias("name"), _number(F.col("name")).alias("number"),
                             F.col("name").alias("child"), *order).where(F.col("number").isNotNull())
    open_names = children.join(held.withColumnRenamed("name", "child"), [*PLACE, "child"], "left_anti")
    return cut_lineage(open_names.join(firsts.select(*PROPOSAL), PROPOSAL, "left_semi"))


def _win_or_lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the child gets the name, for contests sorted by parent and number: a count of those it got so far."""
    current, lost = None, 0
    for batch in batches:
        wins = []
        for key, ahead in zip(zip(*(batch.column(c).to_pylist() for c in PROPOSAL), strict=True),
                              batch.column("ahead").to_pylist(), strict=True):
            if key != current:
                current, lost = key, 0
            wins.append(ahead > lost)
            lost += ahead > lost
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wins, pa.bool_())], names=[*batch.schema.names, "wins"])


def _settle_contests(rows: DataFrame, contests: DataFrame, blocked: DataFrame, order: list[str]) -> DataFrame:
    """(proposal, number) that contests block: the number for the parent, or the bare name for the child."""
    # Drafts of the parent before the child's first one: places in both orders, less the contests among them.
    parents = contests.select(*PROPOSAL).distinct()
    marks = contests.select(*PROPOSAL, *order, "child", "number")
    both = rows.join(parents, PROPOSAL, "left_semi").select(*PROPOSAL, *order).unionByName(marks, allowMissingColumns=True)
    placed = add_rank(both, PROPOSAL, order, "_all").where("child IS NOT NULL")
    counted = add_rank(placed, PROPOSAL, order, "_marks").withColumn("earlier", F.col("_all") - F.col("_marks"))
    # Blocked numbers below the contested one.
    below = counted.select(*PROPOSAL, "number", "child", "earlier").unionByName(
        blocked.join(parents, PROPOSAL, "left_semi").select(*PROPOSAL, "number"), allowMissingColumns=True)
    freed = cut_lineage(add_running(below, PROPOSAL, "number", ["number"], [
        Running("_blocked", "sum", F.when(F.col("child").isNull(), 1).otherwise(0), current=False)],
        top_position(below, "number")).where("child IS NOT NULL").select(
            *PROPOSAL, "number", "child", (F.col("number") - F.col("_blocked") - F.col("earlier")).alias("ahead"),
            F.length(F.regexp_replace(F.regexp_extract("name", fixed.FAMILY_SUFFIXES, 0), "[^-]", "")).alias("depth")))
    out, bare = None, None
    for level in range(top_position(freed, "depth") + 1):
        now = freed.where(F.col("depth") == level)
        if bare is not None:  # a parent that lost its bare name has one free number less
            now = now.join(bare.withColumn("_lost", F.lit(1)), PROPOSAL, "left").withColumn(
                "ahead", F.col("ahead") - F.coalesce("_lost", F.lit(0))).drop("_lost")
        schema = StructType([*now.schema.fields, StructField("wins", BooleanType())])
        settled = cut_lineage(now.repartition(*PROPOSAL).sortWithinPartitions(*PROPOSAL, "number").mapInArrow(_win_or_lose, schema))
        bare = settled.where("NOT wins").select(*PLACE, F.col("child").alias("name"))
        part = settled.where("wins").select(*PROPOSAL, "number").unionByName(
            bare.withColumn("number", F.lit(1).cast("bigint")))
        out = part if out is None else out.unionByName(part)
    return out


def resolve_collisions(drafts: DataFrame, taken: DataFrame, order: list[str]) -> DataFrame:
    """Number each draft ``(namespace, kind, extension, name, *order)``.

    Adds ``suffix`` (1 = bare name) and ``final_name``. Numbers have no upper end,
    so every draft gets a name. ``order`` must tell drafts apart.
    """
    rows = drafts.select(*PROPOSAL, *order)
    first = F.min(F.struct(*order))
    firsts = cut_lineage(rows.groupBy(*PROPOSAL).agg(first.alias("_first"), F.count("*").alias("_n"))).select(
        *PROPOSAL, "_n", *[F.col(f"_first.{c}").alias(c) for c in order])
    held = _taken_names(taken)
    blocked = _numbers(held).join(firsts.select(*PROPOSAL), PROPOSAL, "left_semi")
    contests = _contests(rows, firsts, held, order)
    if not contests.isEmpty():
        blocked = blocked.unionByName(_settle_contests(rows, contests, cut_lineage(blocked), order))
    blocked = cut_lineage(blocked)
    top = top_position(firsts, "_n")

    # The k-th free number is k plus the blocked numbers below it. For the j-th
    # blocked number t (counted from 1), t - j numbers below it are free, so t
    # shifts every draft with k > t - j. Proposals without one have their rank.
    counted = add_running(blocked, PROPOSAL, "number", ["number"],
                          [Running("j", "sum", F.lit(1))], top_position(blocked, "number"))
    shifts = counted.select(
        *PROPOSAL, ((F.col("number") - F.col("j")) * 2 + 1).alias("_at"), F.lit(1).alias("_shift")
    ).where(F.col("_at") <= 2 * top)
    ranked = add_rank(rows, PROPOSAL, order, "rank")
    plain = ranked.select(*PROPOSAL, *order, "rank", (F.col("rank") * 2).cast("bigint").alias("_at"), F.lit(0).alias("_shift"))
    named = add_running(
        plain.unionByName(shifts, allowMissingColumns=True), PROPOSAL, "_at", ["_at"],
        [Running("_skipped", "sum", F.col("_shift"))], 2 * top + 1,
    ).where(F.col("rank").isNotNull()).select(
        *PROPOSAL, *order, (F.col("rank") + F.col("_skipped")).cast("int").alias("suffix")
    )
    return drafts.join(named, [*PROPOSAL, *order], "left").withColumn(
        "final_name",
        F.when(F.col("suffix") == 1, F.col("name")).otherwise(
            F.concat("name", F.lit("-"), F.col("suffix").cast("string"))
        ),
    )
