"""Checkpoint artifacts: retention before saving and latest-checkpoint resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.operators.trainprep import rank_within


def _numbered(artifacts: DataFrame) -> DataFrame:
    """Checkpoints with their step; a name without a number is none."""
    a = artifacts.where(F.col("path").startswith("checkpoint"))
    step = F.get(F.split(F.col("path"), "-"), F.lit(1)).try_cast("long")
    return a.withColumn("step", step).where(F.col("step").isNotNull())


def artifact_retention(artifacts: DataFrame, limit: int) -> DataFrame:
    """Before saving a new checkpoint keep at most ``limit - 1``: when an owner
    has ``n >= limit`` checkpoints the ``n - limit + 1`` lowest-numbered are
    removed.  ``artifacts``: owner, path (``checkpoint-<step>``)."""
    a = _numbered(artifacts)
    r = rank_within(a, ["owner"], ["step", "path"], "rank")
    n = a.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    r = r.join(n, "owner")
    remove = (F.col("n") >= limit) & (F.col("rank") < F.col("n") - limit + 1)
    return r.select("owner", "path", "step", F.when(remove, F.lit("remove")).otherwise(F.lit("keep")).alias("action"))


def latest_artifact(artifacts: DataFrame, updates_per_epoch: int) -> DataFrame:
    """Highest-numbered checkpoint per owner, its step and the epoch to resume at."""
    a = _numbered(artifacts)
    best = a.groupBy("owner").agg(F.max_by("path", "step").alias("path"), F.max("step").alias("global_step"))
    return best.withColumn("first_epoch", F.floor(F.col("global_step") / updates_per_epoch))
