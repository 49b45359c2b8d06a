"""Ordered scans that stay parallel when one key holds a large share of rows.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task.
These helpers split each key into blocks (by ordinal or by time bucket), run
the window inside ``(key, block)``, and carry values across block borders
from a per-block summary, which is tiny (one row per block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 1 << 16


def forward_fill(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    value_col: str,
    out_col: str,
    block: Column | None = None,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """``out_col`` = last non-null ``value_col`` at or before each row per ``keys``.

    ``block`` must be monotone in ``order_col`` (default: ``floor(order/block_rows)``
    for an integer ordinal).
    """
    keys = list(keys)
    blk = "__ff_blk"
    if block is None:
        block = F.floor(F.col(order_col) / F.lit(block_rows))
    # both levels read the input: cache it so upstream work runs once (deterministic,
    # so a lost cached block recomputes identically)
    d = df.withColumn(blk, block).persist()
    w_in = Window.partitionBy(*keys, blk).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("__ff_local", F.last(value_col, ignorenulls=True).over(w_in))
    # last non-null value of every block (null when the block has none)
    summary = d.groupBy(*keys, blk).agg(
        F.max(F.when(F.col(value_col).isNotNull(), F.struct(F.col(order_col).alias("o"), F.col(value_col).alias("v"))))[
            "v"
        ].alias("__ff_last")
    )
    w_blk = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, blk, F.last("__ff_last", ignorenulls=True).over(w_blk).alias("__ff_carry"))
    out = local.join(carry, [*keys, blk], "left")
    return out.withColumn(out_col, F.coalesce(F.col("__ff_local"), F.col("__ff_carry"))).drop(
        blk, "__ff_local", "__ff_carry"
    )
