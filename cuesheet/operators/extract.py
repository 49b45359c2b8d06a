"""Pluggable extractor calls over batch prompts, kept in a durable ledger.

The original sends each batch prompt to a hosted model and waits between
calls.  Here the callable is any ``pandas.Series -> pandas.Series`` function
(prompt texts in, response texts out); Spark runs it inside ``mapInPandas``
on ``max_concurrency`` partitions, pausing ``interval_s`` between calls inside
a task.

Calls are paid for, so none may be made twice.  A :class:`ResponseLedger` is an
append-only table of responses by (episode, batch, attempt, hash of the prompt).
A run first reads it and calls only what it lacks, in waves of a few calls a
task; each wave is appended before the next one starts.  A run that is killed,
or a task that fails, therefore loses the calls of its own wave at most, and a
new application goes on where the last one stopped.  Dead letters are rows of
the ledger with their own state.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cuesheet.constants import REQUEST_INTERVAL_S

Caller = Callable[[pd.Series], pd.Series]
KEY = ["episode", "batch", "attempt", "prompt_hash"]
LEDGER_SCHEMA = "episode string, batch int, attempt int, prompt_hash string, state string, text string, run string"
ANSWERED, DEAD = "answered", "dead"
CALLS_PER_WAVE = 8


def rate_limited(fn: Caller, interval_s: float = REQUEST_INTERVAL_S) -> Caller:
    """Call ``fn`` one text at a time with a pause between calls (per task)."""

    def call(texts: pd.Series) -> pd.Series:
        out = []
        for i, t in enumerate(texts.tolist()):
            if i and interval_s > 0:
                time.sleep(interval_s)
            out.append(fn(pd.Series([t])).iloc[0])
        return pd.Series(out, index=texts.index, dtype="object")

    return call


def keyed(requests: DataFrame) -> DataFrame:
    """``requests`` (episode, batch, attempt, prompt) with the prompt's hash; a null prompt counts as empty."""
    full = requests.withColumn("prompt", F.coalesce("prompt", F.lit("")))
    return full.withColumn("prompt_hash", F.sha2("prompt", 256))


@dataclass
class ResponseLedger:
    """The ledger at ``path``, a folder that outlives the application; made by its first wave."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        """All rows; of several with one key (two runs at once) one is kept, the same one for every reader."""
        try:
            found = self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        first = F.min(F.struct("run", "text")).alias("m")
        return found.groupBy(*KEY, "state").agg(first).select(*KEY, "state", "m.text", "m.run")

    def responses(self) -> DataFrame:
        return self.rows().where(F.col("state") == ANSWERED).drop("state", "run")

    def missing(self, requests: DataFrame) -> DataFrame:
        """Requests without a response, each key once."""
        return keyed(requests).dropDuplicates(KEY).join(self.responses().select(*KEY), KEY, "left_anti")

    def append(self, rows: DataFrame, state: str, run: str) -> None:
        out = rows.select(*KEY, F.lit(state).alias("state"), "text", F.lit(run).alias("run"))
        out.write.mode("append").parquet(self.path)

    def call(
        self, requests: DataFrame, fn: Caller, max_concurrency: int = 1, interval_s: float = 0.0, calls_per_wave: int = CALLS_PER_WAVE
    ) -> DataFrame:
        """``requests`` with the ``text`` of their responses, calling ``fn`` for those that the ledger lacks."""
        run = uuid.uuid4().hex
        call = rate_limited(fn, interval_s) if interval_s > 0 else fn
        todo = self.missing(requests).select(*KEY, "prompt")
        size = max(1, max_concurrency * calls_per_wave)
        # waves are cut by hash, so a restart finds the same few keys in each
        waves = -(-todo.count() // size)
        wave = F.pmod(F.xxhash64(*KEY), F.lit(max(1, waves)))

        def answer(frames):
            for pdf in frames:
                pdf["text"] = call(pdf["prompt"]).astype("object")
                yield pdf.drop(columns="prompt")

        for w in range(waves):
            part = todo.where(wave == w).repartition(max_concurrency)
            self.append(part.mapInPandas(answer, "episode string, batch int, attempt int, prompt_hash string, text string"), ANSWERED, run)
        return keyed(requests).join(self.responses(), KEY, "left")

    def bury(self, rows: DataFrame) -> None:
        """Adds the dead letters ``rows`` (episode, batch, attempt, text) that aren't there yet."""
        dead = keyed(rows.withColumnRenamed("text", "prompt")).withColumn("text", F.col("prompt"))
        known = self.rows().where(F.col("state") == DEAD).select(*KEY)
        self.append(dead.dropDuplicates(KEY).join(known, KEY, "left_anti"), DEAD, uuid.uuid4().hex)

    def dead(self) -> DataFrame:
        return self.rows().where(F.col("state") == DEAD).drop("state", "run")


def extract_responses(
    prompts: DataFrame,
    extractor: Caller,
    ledger: ResponseLedger,
    max_concurrency: int = 1,
    interval_s: float = 0.0,
    calls_per_wave: int = CALLS_PER_WAVE,
) -> DataFrame:
    """prompts (episode, batch, prompt) -> responses (episode, batch, attempt=0, text)."""
    requests = prompts.select("episode", F.col("batch").cast("int").alias("batch"), F.lit(0).alias("attempt"), "prompt")
    found = ledger.call(requests, extractor, max_concurrency, interval_s, calls_per_wave)
    return found.select("episode", "batch", "attempt", "text")
