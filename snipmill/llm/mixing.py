"""Mixing sources to target weights by weighted sampling without replacement.

Every source gets a target of words. Whole epochs of a source come first; what is left
of its target is filled by Efraimidis-Spirakis sampling: each document draws an
exponential key scaled by its quality weight, the smallest keys come first, and a prefix
sum of sizes along the keys ends at the budget. DataFrame functions only.

The prefix sum is never one task's work: range partitions over (source, key) are summed,
the sums of earlier partitions are added as offsets, and the decision of a source is one
number, the last key that is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snipmill.llm.common import WORDS, staged, table

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a share of all words.
BUDGET = 1.5
#: The most epochs of a source.
EPOCHS = 2
#: Characters that lower a document's quality weight, and the least weight.
MARKS = "#*$%&|<>"
LEAST_WEIGHT = 0.05


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """Share of characters that are no marks, at least ``LEAST_WEIGHT``; 1 for no text."""
    chars = F.length(text)
    share = F.length(F.translate(text, MARKS, "")) / F.greatest(chars, F.lit(1))
    return F.when(F.coalesce(chars, F.lit(0)) == 0, 1.0).otherwise(F.greatest(share, F.lit(LEAST_WEIGHT)))


def draw_key(doc_id: Column, size: Column, quality: Column) -> Column:
    """-ln(u) / quality, with u in (0, 1) from an MD5 of the id and the size."""
    name = F.concat_ws(":", doc_id.cast("string"), size.cast("string"))
    number = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    return -F.log((number + 0.5) / float(1 << 52)) / quality


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, source_size), one row per source.

    A target is the source's share by weight of the budget, at most ``EPOCHS`` sizes; the
    excess goes to the others by weight. With sources in order of size over weight, the full
    ones come first, and the level of the rest follows from running sums. One row per
    source is all that meets in the windows without a key.
    """
    ordered = sizes.withColumn(
        "weight", F.get(F.array(*map(F.lit, WEIGHTS)),
                        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    cap = F.col("source_size") * EPOCHS
    level = ((F.sum("source_size").over(everything) * BUDGET - F.coalesce(F.sum(cap).over(before), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    leveled = ordered.withColumn("level", level).withColumn("full", cap <= F.col("weight") * F.col("level"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return leveled.select(
        "source", "source_size",
        F.when(F.col("full"), cap.cast("double")).otherwise(F.col("weight") * shared).alias("target"))


#: Sources whose row is broadcast, some MB; beyond that a source's rows are dealt to this many salted keys.
BROADCAST, SALTS = 50_000, 64


def by_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, draw, ...) with the columns of their source's one row of ``plan``, which is staged.

    No task gets all rows of a source: the plan goes to the rows, or a source's rows to salted copies of its row.
    """
    if plan.count() <= BROADCAST:
        small = F.broadcast(plan)
        return rows.join(small, rows.source.eqNullSafe(small.source)).drop(plan.source)
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("draw"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, dealt.source.eqNullSafe(salted.source) & (dealt._salt == salted._salt)).drop(
        plan.source, salted._salt, dealt._salt)


def mix_plan(thin: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, last_key) from ``thin`` (source, size, draw)."""
    spread = staged(thin.repartitionByRange("source", "draw").withColumn("slice", F.spark_partition_id()), "draws")
    # Sums by source and slice: at most sources + slices rows.
    sums = staged(spread.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "draw-sums")
    plan = targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")))
    plan = staged(plan.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    # Only the slice in which a source's budget ends needs the running sum of its rows.
    on_source = offsets.source.eqNullSafe(plan.source)
    ends = staged(offsets.join(plan, on_source).where("epochs < {} AND before < rest AND before + slice_size > 0".format(EPOCHS))
                  .select(offsets.source, "slice", "before", "rest"), "mix-offsets")
    rows = by_source(spread, ends.withColumnRenamed("slice", "end")).where("slice = end").select(
        "source", "slice", "draw", "size", "before", "rest")
    # Equal draws count as one: the frame takes in all of them.
    running = Window.partitionBy("source", "slice").orderBy("draw").rangeBetween(Window.unboundedPreceding, 0)
    taken = rows.withColumn("sum", F.col("before") + F.sum("size").over(running)).where(
        F.col("sum") - F.col("size") / 2 <= F.col("rest"))
    last = taken.groupBy("source").agg(F.max("draw").alias("last_key"))
    return staged(plan.join(last, plan.source.eqNullSafe(last.source), "left").select(
        plan.source, "source_size", "target", F.col("epochs").cast("int").alias("epochs"), "last_key"), "mix-plan")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        quality: Column | None = None, name: str = "mix") -> DataFrame:
    """``docs`` with a struct ``name``: size, source_size, target, copies, taken.

    A null source is a source of its own. Null and empty texts have size 0 and are taken
    with 0 words. Rows that repeat a key with the same size and source draw the same key and
    are taken or left together. A quality that is null or not above 0 counts as
    ``LEAST_WEIGHT``. An empty table gives none. A column of the name ``name`` is replaced;
    other columns stay as they are.
    """
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{source}`").alias("source"), size_of(F.col(text)).alias("size"),
                       (quality if quality is not None else quality_of(F.col(text))).alias("quality"), F.col(key).alias("key"))
    weight = F.when(F.col("quality") > 0, F.col("quality")).otherwise(LEAST_WEIGHT)
    kept = kept.withColumn("draw", draw_key(F.col("key"), F.col("size"), weight)).drop("quality", "key")
    plan = mix_plan(kept.select("source", "size", "draw"))
    copies = F.col("epochs") + F.when(F.col("draw") <= F.col("last_key"), 1).otherwise(0)
    out = by_source(kept, plan).withColumn("copies", copies)
    columns = [c for c in docs.columns if c != name]
    return out.select(
        *[F.col(f"row.`{c}`") for c in columns],
        F.struct("size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")).alias(name))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size, quality = size_of(F.col("text")), quality_of(F.col("text"))
    # The draws are made once and written without the texts.
    thin = staged(docs.select("doc_id", "source", size.alias("size"), quality.alias("quality")), "mix-documents")
    drawn = thin.withColumn("draw", draw_key(F.col("doc_id"), F.col("size"), F.col("quality")))
    plan = mix_plan(drawn.select("source", "size", "draw"))
    copies = F.col("epochs") + F.when(F.col("draw") <= F.col("last_key"), 1).otherwise(0)
    return by_source(drawn, plan).select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 1.0 ELSE
      greatest(length(translate(text, '#*$%&|<>', '')) / greatest(length(text), 1), 0.05) END AS quality
  FROM documents),
k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5(concat_ws(':', doc_id, size)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
    / 4503599627370496.0) / quality AS draw FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER b, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN 2 * source_size <= weight * level THEN CAST(2 * source_size AS DOUBLE)
    ELSE weight * max(CASE WHEN 2 * source_size > weight * level THEN level END) OVER () END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY draw) AS running
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN epochs < 2 AND running - size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": OP7_SQL}
