"""Corpus pipeline: five stages over ``documents``, each on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  Each sets the session as the queries do, so
that what its Python workers get at once is bounded however it is called.  ``run`` writes each stage's result to the
shared checkpoint folder and hands what it reads back to the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm import decontam, langid, linededup, triejoin
from cuesheet.llm.queries import bpe_digests
from cuesheet.session import apply_conf
from cuesheet.sinks.files import materialize
from cuesheet.sources.tables import read_table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_settings(stage: Stage) -> Stage:
    """``stage`` under the settings of ``cuesheet.session``, also where a caller runs it by itself."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apply_conf(spark)
        return stage(spark, docs, sf_dir)

    return run


@with_settings
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects; learned from the rows with a language."""
    model = langid.fit(docs.select("doc_id", "text", "lang"), ~langid.held_out())
    return langid.identify(docs, model, prefix="__").where("NOT __rejected").select(*docs.columns)


@with_settings
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later repeated runs of lines; a document that loses all its words goes.  ``n_chars`` follows the text."""
    cut = linededup.dedup_lines(docs, removed="__removed")
    touched = F.size("__removed") > 0
    kept = cut.where(~touched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


@with_settings
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return triejoin.keep_first(docs).select(*docs.columns)


@with_settings
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of a benchmark item."""
    found = decontam.find_leaks(docs, read_table(spark, sf_dir, "benchmark"), column="__leaks")
    return found.where(F.size("__leaks") == 0).select(*docs.columns)


@with_settings
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe_digests(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("bpe", tokens),
]

# The stages can't be told in SQL; the tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
