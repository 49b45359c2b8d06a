"""Connected components of a table of links, by alternating star operations.

Every round is a few aggregations and joins, written to the shared folder; no
link reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.sinks.files import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node of the component of every linked node but the roots themselves.

    ``links``: u, v (long).  Links of a node with itself and with null count
    for nothing; repeated links count once.
    """
    now = materialize(links.select("u", "v").where("u <> v").distinct(), "links")
    for _ in range(rounds):
        now = materialize(_small_star(_large_star(now)).where("u <> v").distinct(), "links")
        # settled: every node has one link, to a smaller node that has none
        many = now.groupBy("u").count().where("count > 1").select("u")
        if now.join(many.unionByName(now.select("v").distinct().withColumnRenamed("v", "u")), "u", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components not settled after {rounds} rounds")
