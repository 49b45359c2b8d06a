"""Shards by extendible hashing.

Documents hash to 60 bits.  The directory starts as one bucket; a bucket whose
documents exceed the byte limit splits on the next bit of the hash, the others
stay, until every bucket fits.  The splits come from one histogram of hash
prefixes: a bucket is a shard if it fits and its parent doesn't.  Only cells
that are too large at the histogram's depth are counted again, deeper.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.sinks.files import materialize

BITS = 60
SHARD_BYTES = 1 << 20
SPARE_BITS = 4
BROADCAST_ROWS = 1 << 20


def hash_bits(doc_id: str = "doc_id") -> Column:
    """The first 60 bits of the md5 of the id as text (an empty text for a null id)."""
    hexed = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(hexed, 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column, depth: Column | int) -> Column:
    """The first ``depth`` of the 60 bits."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def text_bytes() -> Column:
    """Bytes of a row's text, none for a null."""
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")


@dataclass
class Directory:
    """``shards``: shard, depth, prefix, bytes, rows, parts; ``levels``: (depth, cell -> shard) of each counting round."""

    shards: DataFrame
    levels: list[tuple[int, DataFrame]]
    limit: int = SHARD_BYTES

    def depth(self) -> int:
        """Global depth: the most bits that a shard uses."""
        return self.shards.agg(F.max("depth")).first()[0] or 0


def build_directory(docs: DataFrame, limit: int = SHARD_BYTES, spare_bits: int = SPARE_BITS) -> Directory:
    """The directory for ``docs`` (doc_id, text) with at most ``limit`` text bytes a shard.

    What can't be split by hash bits is dealt out by bytes instead: the rows of
    one id that exceed the limit get about ``parts`` shards of the same prefix.
    A single longer document has a shard of its own.
    """
    rows = docs.select(hash_bits().alias("h"), text_bytes().alias("bytes"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    top, depth = -1, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + spare_bits)
    shards, levels = None, []
    while True:
        cells = rows.groupBy(_prefix(F.col("h"), depth).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        cells = materialize(cells, "cells")
        # every cell adds to its ancestors down from the first depth not decided yet
        up = cells.withColumn("depth", F.explode(F.sequence(F.lit(top + 1), F.lit(depth))))
        up = up.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")))
        buckets = up.groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        single = F.col("low") == F.col("high")  # one hash: no bit can split it
        state = buckets.withColumn("done", (F.col("bytes") <= limit) | single)
        state = materialize(state, "buckets")
        split = state.where(~F.col("done")).select(
            (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
        )
        first = (F.col("depth") == 0) if top < 0 else (F.col("depth") == top + 1)
        reached = state.where(first).unionByName(state.where(~first).join(split, ["depth", "prefix"], "left_semi"))
        parts = F.when(F.col("bytes") > limit, F.least(F.col("rows"), F.ceil(2 * F.col("bytes") / F.lit(limit)))).otherwise(1)
        name = F.concat(F.lit("s"), F.when(F.col("depth") > 0, F.expr("lpad(bin(prefix), depth, '0')")).otherwise(""))
        new = reached.where("done").select(name.alias("shard"), "depth", "prefix", "bytes", "rows", parts.cast("int").alias("parts"))
        new = materialize(new, "shards")
        # the shard of each cell: that of its one ancestor that is a shard
        lookup = up.select("cell", "depth", "prefix").join(new.select("depth", "prefix", "shard", "parts"), ["depth", "prefix"])
        levels.append((depth, materialize(lookup.select("cell", "shard", "parts", F.col("depth").alias("shard_depth")), "lookup")))
        shards = new if shards is None else shards.unionByName(new)
        left = state.where((F.col("depth") == depth) & ~F.col("done")).select(F.col("prefix").alias("cell"))
        if depth >= BITS or left.isEmpty():
            return Directory(shards, levels, limit)
        rows = rows.withColumn("cell", _prefix(F.col("h"), depth)).join(left, "cell", "left_semi").drop("cell")
        top, depth = depth, min(BITS, depth + 2 * spare_bits)


def assign(docs: DataFrame, directory: Directory, column: str = "shard", depth_column: str = "shard_depth") -> DataFrame:
    """``docs`` with the name of each row's shard, and the shard's bits.

    A lookup of bounded size is broadcast; a longer one is joined by shuffling.
    """
    out = docs.drop(column, depth_column).withColumn("__h", hash_bits())
    found, depths, parts = [], [], []
    for i, (depth, table) in enumerate(directory.levels):
        names = [f"__cell{i}", f"__shard{i}", f"__parts{i}", f"__depth{i}"]
        table = table.select("cell", "shard", "parts", "shard_depth").toDF(*names)
        table = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
        out = out.join(table, _prefix(F.col("__h"), depth) == F.col(names[0]), "left")
        found.append(F.col(names[1]))
        parts.append(F.col(names[2]))
        depths.append(F.col(names[3]))
    out = out.withColumn(column, F.coalesce(*found)).withColumn(depth_column, F.coalesce(*depths))
    out = out.withColumn("__parts", F.coalesce(*parts))
    drop = [c for c in out.columns if c.startswith("__") and c not in docs.columns]
    if directory.shards.where("parts > 1").isEmpty():
        return out.drop(*drop)
    whole = out.where(F.coalesce(F.col("__parts"), F.lit(1)) <= 1).drop(*drop)
    return whole.unionByName(_deal(out.where("__parts > 1").drop(*drop), directory.limit, column))


def _deal(rows: DataFrame, limit: int, column: str) -> DataFrame:
    """``rows`` of ids beyond the limit, ``-part`` added to their shard's name.

    A text over half the limit is a part of its own; the others are cut where
    their running bytes pass a multiple of half the limit, so no part of two
    rows exceeds it.  Sums run inside the partitions and start from the bytes
    of the partitions before, a row per shard and partition.
    """
    rows = rows.withColumn("__place", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("__task", F.shiftright("__place", 33)), "oversize")  # places must not change any more
    big = text_bytes() * 2 > limit
    small_bytes, bigs = F.when(big, 0).otherwise(text_bytes()).cast("long"), F.when(big, 1).otherwise(0).cast("long")
    rows = rows.withColumn("__small", small_bytes).withColumn("__big", bigs)
    sums = rows.groupBy(column, "__task").agg(F.sum("__small").alias("__s"), F.sum("__big").alias("__b"))
    shard = Window.partitionBy(column)
    earlier = shard.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        column,
        "__task",
        F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s0"),
        F.coalesce(F.sum("__b").over(earlier), F.lit(0)).alias("__b0"),
        F.floor(F.sum("__s").over(shard) * 2 / limit).alias("__last"),
    )
    before = Window.partitionBy(column, "__task").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    upto = [F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("__small", "__big")]
    rows = rows.withColumn("__s1", upto[0]).withColumn("__b1", upto[1]).join(sums, [column, "__task"])
    small = F.floor((F.col("__s0") + F.col("__s1")) * 2 / limit)
    part = F.when(F.col("__big") == 1, F.col("__last") + 1 + F.col("__b0") + F.col("__b1")).otherwise(small)
    named = rows.withColumn(column, F.concat(F.col(column), F.lit("-"), part.cast("string")))
    return named.drop("__place", "__task", "__small", "__big", "__s1", "__b1", "__s0", "__b0", "__last")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> Directory:
    """Write ``docs`` (doc_id, text and any others) as one Parquet folder ``shard=<name>`` per shard.

    A shard is named ``s`` and its hash bits, and ``-part`` if its one id had to
    be dealt out; the whole of a shard meets in one
    task, which is bounded by the limit.  Rows are kept as they are: null texts
    count no bytes, repeated rows stay, and an empty table has no shard.
    """
    directory = build_directory(docs, limit)
    dealt = assign(docs, directory).drop("shard_depth")
    dealt.repartition("shard").sortWithinPartitions("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    return directory
