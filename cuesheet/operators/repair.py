"""Extractor responses -> validated scene rows, rejects and dead letters.

* ``repair_frame``: rule-based response repair as staged projections
  (three regex rewrites, fence removal, removal of a ``...`` next-to-last line).
* ``resolve_responses``: staged retry rounds.  Round 0 parses every response;
  each later round only touches responses that still fail, applies the repair
  (a Column function, or a pandas callable for an external service), and
  re-parses.  Every round is written to the shared checkpoint folder.  Calls of
  an external service go through a ledger that outlives the application, so
  none is ever repeated; a deterministic repair that no longer changes the
  text ends the retries for that row.
* ``scene_rows``: explode parsed scenes, repair keys, validate types.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.constants import ENVIRONMENT, MAX_RETRIES, SCENE_FIELDS
from cuesheet.functions.text import py_strip
from cuesheet.operators.extract import ResponseLedger
from cuesheet.sinks.files import materialize

RESPONSE_SCHEMA = "struct<scenes: array<map<string, variant>>>"
JSON_OPTIONS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
STRING_FIELDS = ["character", "speaker", "background", "action", "object", "poses", "scene_description"]
FLOAT_FIELDS = ["start_time", "end_time"]
INT_PATTERN = r"^\s*[-+]?[0-9]+\s*$"


def _repair_steps(c: Column) -> list[tuple[str, Column]]:
    """The repair as named stages; each stage only references earlier ones, so
    every intermediate value is computed once per row."""
    d = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(c, r'(?d)\n([a-z_]+)"?:', '\n\t"$1":'), '\n"', '"'),
        # only lines that end in a quote can match: the look-ahead spares others the search over all their quotes
        r'(?d)("scene_description": "(?=.*"\n).+)"(.+)"(.+"\n)', "$1'$2'$3",
    )
    lines = F.split(F.col("__r_d"), "\n", -1)
    lo = F.when(F.col("__r_d").startswith("```json"), F.lit(1)).otherwise(F.lit(0))
    hi = F.when(F.col("__r_d").endswith("```"), F.size(lines) - 1).otherwise(F.size(lines))
    kept = F.filter(F.col("__r_lines"), lambda x, i: (i >= F.col("__r_lo")) & (i < F.col("__r_hi")))
    m = F.col("__r_m")
    dots = F.when(m >= 2, py_strip(F.try_element_at(F.col("__r_kept"), m - 1)) == "...").otherwise(F.lit(False))
    final = F.when(dots, F.filter(F.col("__r_kept"), lambda x, i: i != m - 2)).otherwise(F.col("__r_kept"))
    return [
        ("__r_d", d),
        ("__r_lines", lines),
        ("__r_lo", lo),
        ("__r_hi", hi),
        ("__r_kept", kept),
        ("__r_m", F.size(F.col("__r_kept"))),
        ("__r_out", F.array_join(final, "\n")),
    ]


def repair_frame(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Apply the rule-based repair to ``text_col`` as staged projections."""
    stages = _repair_steps(F.col(text_col))
    cur = df
    for name, expr in stages[:2]:
        cur = cur.withColumn(name, expr)
    cur = cur.withColumns({"__r_lo": stages[2][1], "__r_hi": stages[3][1]})
    for name, expr in stages[4:]:
        cur = cur.withColumn(name, expr)
    return cur.withColumn(out_col, F.col("__r_out")).drop(*[n for n, _ in stages])


def parse_response(c: Column) -> Column:
    return F.from_json(c, RESPONSE_SCHEMA, JSON_OPTIONS)


def _status(parsed: Column) -> Column:
    return (
        F.when(parsed["scenes"].isNull(), F.lit("error"))
        .when(F.size(parsed["scenes"]) == 0, F.lit("empty"))
        .otherwise(F.lit("ok"))
    )


def _parsed(df: DataFrame) -> DataFrame:
    """``df`` with status and parsed, written so that later rounds and the result read it and don't make it again.

    Rows that a repair left as they were (``__changed`` false) aren't parsed again: their status stays ``error``.
    """
    status = _status(parse_response(F.col("text")))
    if "__changed" in df.columns:
        status = F.when(F.col("__changed"), status).otherwise(F.lit("error"))
    out = materialize(df.withColumn("status", status), "responses")
    return out.withColumn("parsed", F.when(F.col("status") != "error", parse_response(F.col("text"))))


def resolve_responses(
    responses: DataFrame,
    repair: Callable[[Column], Column] | Callable[[pd.Series], pd.Series] | None = None,
    max_retries: int = MAX_RETRIES,
    external: bool = False,
    max_concurrency: int = 1,
    interval_s: float = 0.0,
    ledger: ResponseLedger | None = None,
) -> DataFrame:
    """Parse responses with bounded repair rounds.

    ``responses``: episode, batch, text (any extra columns are kept).
    Output adds ``attempt`` (round that produced the final text), ``status``
    (``ok`` / ``empty`` / ``dead``) and ``parsed``.  A response whose list of
    scenes is empty is counted once as ``empty``; one that never parses within
    ``max_retries`` parse attempts is ``dead`` (the dead-letter rows).  A
    deterministic repair that leaves a text unchanged cannot make progress, so
    that row is dead at once.  ``repair`` defaults to the rule-based repair;
    ``external=True`` treats it as a pandas Series -> Series callable (e.g. a
    model call) run once per row and round through ``ledger``, which it needs:
    a run that starts again repeats no call, and dead rows are kept there, too.
    ``max_concurrency`` bounds the parallel calls (partitions) and
    ``interval_s`` pauses between calls inside a task.
    """
    if external and ledger is None:
        raise ValueError("external repairs are paid for: name a ledger")
    base = [c for c in responses.columns if c not in ("text", "attempt")]
    cur = responses.select(*base, "text", F.lit(0).alias("attempt"))
    cur = _parsed(cur)
    finished = [cur.where(F.col("status") != "error")]
    pending = cur.where(F.col("status") == "error")
    for k in range(1, max_retries):
        if external:
            asked = pending.select(*base, F.lit(k).alias("attempt"), F.col("text").alias("prompt"))
            rep = ledger.call(asked, repair, max_concurrency, interval_s).select(*base, "text", "attempt")
            rep = rep.withColumn("__changed", F.lit(True))
        else:
            if repair is None:
                rep = repair_frame(pending.select(*base, "text", "attempt"), "text", "__new")
            else:
                rep = pending.select(*base, "text", "attempt", repair(F.col("text")).alias("__new"))
            changed = F.coalesce(F.col("__new") != F.col("text"), F.lit(False))
            rep = rep.select(*base, F.col("__new").alias("text"), changed.alias("__changed"), "attempt")
            rep = rep.withColumn("attempt", F.when(F.col("__changed"), F.lit(k)).otherwise(F.col("attempt")))
        # one table for stuck and changed rows: a filter on the repair itself would run it once for each mention
        now = _parsed(rep)
        stuck, moved = now.where(~F.col("__changed")).drop("__changed"), now.where("__changed").drop("__changed")
        finished.append(stuck.withColumn("status", F.lit("dead")))
        finished.append(moved.where(F.col("status") != "error"))
        pending = moved.where(F.col("status") == "error")
        if pending.isEmpty():
            break
    if external:
        ledger.bury(pending)
    finished.append(pending.withColumn("status", F.lit("dead")))
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_string(v: Column) -> Column:
    return F.coalesce(_vtype(v) == "STRING", F.lit(False))


def _is_number(v: Column) -> Column:
    t = _vtype(v)
    return F.coalesce(
        t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"), F.lit(False)
    )


def _as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _int_value(v: Column) -> Column:
    s = _as_string(v)
    d = F.try_variant_get(v, "$", "double")
    return (
        F.when(_is_number(v) & (d == F.floor(d)), d.try_cast("int"))
        .when(_vtype(v) == "BOOLEAN", F.when(s == "true", F.lit(1)).otherwise(F.lit(0)))
        .when(_is_string(v) & s.rlike(INT_PATTERN), F.trim(s).try_cast("int"))
    )


def scene_rows(resolved: DataFrame) -> DataFrame:
    """Explode scenes of parsed responses, repair keys, validate field types.

    Key repair: any key starting with ``end`` other than ``end_time`` becomes
    ``end_time`` (the last such key wins over an existing ``end_time``); an
    ``environment`` key is removed and sets ``character = 'environment'``.
    Validation: the ten fields must be present; text fields must be JSON
    strings; ``in_game`` an integer (whole number, boolean or integer text);
    times numbers (or numeric text).  Extra keys are ignored.

    Output: episode, batch, attempt, scene_idx, reason (null when valid) and the
    typed scene fields.
    """
    keep = [c for c in resolved.columns if c not in ("parsed", "status", "text")]
    ex = resolved.where(F.col("status") == "ok").select(
        *keep, F.posexplode("parsed.scenes").alias("scene_idx", "m")
    )
    m = F.col("m")
    end_keys = F.filter(F.map_keys(m), lambda k: k.startswith("end") & (k != "end_time"))
    end_v = F.when(F.size(end_keys) > 0, m[F.try_element_at(end_keys, F.lit(-1))]).otherwise(m["end_time"])
    env = F.map_contains_key(m, "environment")
    vals = {f: m[f] for f in SCENE_FIELDS}
    vals["end_time"] = end_v
    typed = {
        f: (F.when(_is_string(vals[f]), _as_string(vals[f])) if f in STRING_FIELDS else None)
        for f in SCENE_FIELDS
    }
    typed["character"] = F.when(env, F.lit(ENVIRONMENT)).otherwise(typed["character"])
    typed["in_game"] = _int_value(vals["in_game"])
    for f in FLOAT_FIELDS:
        v = vals[f]
        typed[f] = (
            F.when(_is_number(v), F.try_variant_get(v, "$", "double"))
            .when(_vtype(v) == "BOOLEAN", F.when(_as_string(v) == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
            .when(_is_string(v), _as_string(v).try_cast("double"))
        )
    reason = None
    for f in reversed(SCENE_FIELDS):
        missing = F.when(typed[f].isNull(), F.lit(f))
        reason = missing if reason is None else F.coalesce(missing, reason)
    return ex.select(
        *keep, "scene_idx",
        reason.alias("reason"),
        *[typed[f].alias(f) for f in SCENE_FIELDS],
    )


def valid_scenes(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNull()).drop("reason")


def rejected_scenes(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNotNull())
