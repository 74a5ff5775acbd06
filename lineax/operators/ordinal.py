"""Distributed ordinals without a single-partition window.

A global ``row_number`` over an un-partitioned window moves every row into one
task.  Here the rows are range-partitioned and sorted by Spark, each row is
tagged with (partition, position) of the sorted output, and the tagged rows
are written once to the checkpoint folder (so the tags are fixed even if an
executor is lost and work is re-run).  A row's ordinal is its partition's
offset plus its position inside the partition; the only gathered table is one
row per partition, which is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineax.session import materialize, materialize_parts

_LOW_BITS = (1 << 33) - 1


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def with_global_ordinal(df: DataFrame, order_by: Sequence[str | Column], name: str = "ordinal",
                        salt: bool = True, written: bool = False, keep: Sequence[str] | None = None,
                        stretches: Sequence[Column] | None = None) -> DataFrame:
    """Add a 0-based dense position of each row in the total order ``order_by``.

    Rows equal on ``order_by`` get their positions in arbitrary order.  With
    ``salt`` a seeded random value is the last sort key, so a value repeated in
    a third of the rows is still split over many range partitions.  The input
    is cached for the two passes the range sort makes (sampling, then sorting)
    and released afterwards; a ``written`` one (little work on a written table)
    is read twice instead, which takes no room.  ``keep`` names the columns that
    the result has, all by default: others serve the order only.  ``stretches``
    are conditions that cut the order into consecutive stretches (every row is
    in one): they are sorted one after the other, each with the disk of its rows.
    """
    mid = F.monotonically_increasing_id()
    keys = _as_cols(order_by) + ([F.rand(7)] if salt else [])
    src = df if written else df.persist(StorageLevel.MEMORY_AND_DISK)

    def ordered(i: int, rows: DataFrame) -> DataFrame:
        pid = F.shiftright(mid, 33) + F.lit(i << 31)
        return rows.orderBy(*keys).select(*(keep or ["*"]), pid.alias("_pid"), mid.bitwiseAND(F.lit(_LOW_BITS)).alias("_loc"))

    try:
        tagged = materialize_parts([ordered(i, src if c is None else src.where(c)) for i, c in enumerate(stretches or [None])], "ordinal")
    finally:
        if not written:
            src.unpersist()
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # One row per partition: a proven bound, safe to broadcast.
    joined = tagged.join(F.broadcast(offsets), "_pid")
    return joined.withColumn(name, F.col("_off") + F.col("_loc")).drop("_pid", "_loc", "_off")


def with_group_ordinal(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: Sequence[str | Column],
    name: str = "ordinal",
) -> DataFrame:
    """0-based position inside each group; a hot group is spread over many range partitions."""
    glob = with_global_ordinal(df, [*_as_cols(group_by), *_as_cols(order_by)], "_g")
    keys = {g: f"_key{i}" for i, g in enumerate(group_by)}
    starts = glob.groupBy(*group_by).agg(F.min("_g").alias("_start")).withColumnsRenamed(keys)
    cond = [F.col(g).eqNullSafe(F.col(k)) for g, k in keys.items()]
    out = glob.join(starts, cond).withColumn(name, F.col("_g") - F.col("_start"))
    return out.drop("_g", "_start", *keys.values())


def with_running_total(df: DataFrame, order_by: Sequence[str | Column], weight: str, name: str = "before") -> DataFrame:
    """Add the sum of ``weight`` over all rows strictly before each row in the total order ``order_by``.

    Same scheme as ``with_global_ordinal``: range-sort, tag (partition,
    position), write once; then a running sum inside each range partition (one
    balanced partition per window task) plus the total of earlier partitions.
    """
    mid = F.monotonically_increasing_id()
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ordered = src.orderBy(*_as_cols(order_by))
        tagged = materialize(
            ordered.select("*", F.shiftright(mid, 33).alias("_pid"), mid.bitwiseAND(F.lit(_LOW_BITS)).alias("_loc")),
            "running")
    finally:
        src.unpersist()
    inside = Window.partitionBy("_pid").orderBy("_loc").rowsBetween(Window.unboundedPreceding, -1)
    within = tagged.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    sizes = tagged.groupBy("_pid").agg(F.sum(weight).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    joined = within.join(F.broadcast(offsets), "_pid")
    return joined.withColumn(name, F.col("_off") + F.col("_in")).drop("_pid", "_loc", "_off", "_in")
