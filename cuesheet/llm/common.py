"""Helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.sinks.files import materialize

STEPS = 32


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``counts`` with the highest ``n``, ``most`` at most.

    The cutoff comes from a histogram with STEPS buckets for each doubling of
    ``n``, so no task and no driver gathers more than the rows that are kept;
    a bucket that doesn't fit whole is left out with all below it.
    """
    counts = materialize(counts, "counts")
    bucket = F.floor(F.log2("n") * STEPS).cast("long")
    bars = sorted(counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r["b"])
    cutoff, total = None, 0
    for bar in bars:
        total += bar["rows"]
        if total > most:
            break
        cutoff = bar["b"]
    return counts.where(F.lit(False) if cutoff is None else bucket >= cutoff)


def give_back() -> None:
    """Hand what a task has freed back to the system: Spark uses its Python processes again for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass
