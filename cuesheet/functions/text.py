"""Small text helpers as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_strip(c: Column) -> Column:
    """Strip leading/trailing whitespace like Python ``str.strip()``.

    Spark ``trim`` removes only the ASCII blank; this removes any Unicode
    whitespace.
    """
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

