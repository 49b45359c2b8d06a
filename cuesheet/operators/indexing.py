"""Ordinals without a single-partition window, and dense-ordinal lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_ordinal(
    df: DataFrame,
    order: Sequence[str | Column],
    out_col: str = "ordinal",
    start: int = 0,
    num_partitions: int | None = None,
) -> DataFrame:
    """Number all rows by ``order`` (which must be a total order).

    Range-partitions by the order, numbers rows inside each partition with
    ``monotonically_increasing_id`` and adds each partition's offset, taken
    from a per-partition count table (one row per partition, so its size is
    bounded by the partition count and it is broadcast).  Range bounds come
    from sampling, which depends on the input's row order, so the numbered
    rows are written once to the shared checkpoint folder: counts, offsets and
    every consumer (and any task retry) see the same numbering.
    """
    from cuesheet.sinks.files import materialize

    order = list(order)
    # without an explicit count AQE may coalesce adjacent (still ordered) ranges
    s = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    s = s.sortWithinPartitions(*order)
    s = s.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    s = materialize(s, "ordinal")
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return (
        s.join(F.broadcast(offsets), "__pid")
        .withColumn(out_col, F.col("__off") + local + F.lit(start))
        .drop("__pid", "__mid", "__off")
    )


def lag_dense(
    df: DataFrame, keys: Sequence[str], ordinal: str, cols: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """Previous row's ``cols`` for a dense per-key ordinal: an equi-join on
    ``ordinal - 1`` instead of a window, so one large key is not one task."""
    keys = list(keys)
    prev = df.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        (F.col(ordinal) + 1).alias("__next"),
        *[F.col(c).alias(prefix + c) for c in cols],
    )
    cond = [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col(ordinal) == F.col("__next")]
    return df.join(prev, cond, "left").drop(*[f"__k_{k}" for k in keys], "__next")


def zip_by_position(
    left: DataFrame, left_order: Sequence[str | Column], right: DataFrame, right_order: Sequence[str | Column], longest: bool = False
) -> DataFrame:
    """Rows of two tables side by side: the i-th of one with the i-th of the other, each by its own total order.

    Both are numbered (``position`` from 0) and joined on the number.  Of tables
    of unequal length the surplus is dropped, or kept beside nulls if
    ``longest``.
    """
    a, b = global_ordinal(left, left_order, "position"), global_ordinal(right, right_order, "position")
    return a.join(b, "position", "full" if longest else "inner")
