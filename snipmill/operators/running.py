"""Running maxima, sums and counts per key that stay whole when one key is hot.

A window over a hot key would put all its rows into one task. Where the order
column is a position (turn number, fence number), rows are cut into slices of
``SLICE`` positions: one window runs inside each (key, slice), a second one
over the per-slice totals, and the two are added up. The result is the same;
no task sees more than ``SLICE`` positions of a key, or one row per slice.

``top_position`` asks the data once how far positions go. When no key passes
one slice, the plain window already has that bound and is used alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snipmill.session import cut_lineage

SLICE = 50_000


@dataclass(frozen=True)
class Running:
    name: str
    kind: str  # "max" or "sum"
    value: Column
    current: bool = True  # whether the row itself counts


def top_position(df: DataFrame, column: str) -> int:
    top = df.agg(F.max(column)).first()[0]
    return 0 if top is None else int(top)


def _total(spec: Running) -> Column:
    return F.max(spec.value) if spec.kind == "max" else F.sum(spec.value)


def _plus(spec: Running, a: Column, b: Column) -> Column:
    if spec.kind == "max":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.greatest(a, b))
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def _running(specs: list[Running], window) -> dict[str, Column]:
    return {
        s.name: _total(s).over(
            window.rowsBetween(Window.unboundedPreceding, 0 if s.current else -1)
        )
        for s in specs
    }


def add_running(df: DataFrame, key: list[str], position: str, order: list[str],
                specs: list[Running], top: int, slice_size: int = SLICE) -> DataFrame:
    """Add one column per spec; ``order`` must start with or follow ``position``."""
    if top < slice_size:
        running = _running(specs, Window.partitionBy(*key).orderBy(*order))
        return df.withColumns({
            s.name: F.coalesce(running[s.name], F.lit(0)) if s.kind == "sum" else running[s.name]
            for s in specs
        })

    sliced = df.withColumn("_slice", F.floor(F.col(position) / slice_size))
    group = [*key, "_slice"]
    totals = sliced.groupBy(*group).agg(*[_total(s).alias(s.name) for s in specs])
    before = (
        Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *group,
        *[
            (F.max(s.name) if s.kind == "max" else F.sum(s.name)).over(before).alias(f"_c_{s.name}")
            for s in specs
        ],
    )
    sliced = sliced.withColumns(_running(specs, Window.partitionBy(*group).orderBy(*order)))
    joined = sliced.join(carried, group, "left").withColumns({
        s.name: _plus(s, F.col(f"_c_{s.name}"), F.col(s.name)) for s in specs
    })
    return joined.drop("_slice", *[f"_c_{s.name}" for s in specs])


def add_total(df: DataFrame, key: list[str], spec: Running, top: int,
              slice_size: int = SLICE) -> DataFrame:
    """Add a maximum or sum per key; a partial aggregate and a join beyond one slice."""
    if top < slice_size:
        return df.withColumn(spec.name, _total(spec).over(Window.partitionBy(*key)))
    return df.join(df.groupBy(*key).agg(_total(spec).alias(spec.name)), key, "left")


def join_status(rows: DataFrame, status: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the one row that ``status`` has for their keys; null keys are keys.

    ``status`` is written first: the join is then the only one on its exchange, and adaptive execution can split a
    key that very many rows share.
    """
    held = cut_lineage(status).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(held, same, "left").drop(*[f"_k_{k}" for k in keys])


def add_rank(df: DataFrame, key: list[str], order: list[str], name: str,
             partitions: int | None = None) -> DataFrame:
    """1-based rank per key in an order that has no integer position.

    Rows are range partitioned on (key, order), so a hot key is spread over
    many ranges. The rank is the place inside the range plus the rows of the
    key in earlier ranges. The ranged rows are written once, which pins the
    range numbers for every later task and retry. ``order`` must be unique per
    key, or ties may be numbered in any order.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(count, *key, *order).withColumn("_range", F.spark_partition_id())
    )
    group = [*key, "_range"]
    sizes = ranged.groupBy(*group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = ranged.withColumn(
        name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    )
    return placed.join(offsets, group).withColumn(
        name, F.col(name) + F.col("_offset")
    ).drop("_range", "_offset")
