"""Throttled scene-change detection over playback positions (batch and stream).

Events of a session are taken in the order of (ts, event_id).  An event checks
for a change when its position lies more than ``duration`` beyond the position
of the last such event (0 at first), or when its position is 0; only the former
moves that mark.  A seek/reset event (``event_type == 1``) takes the mark back
to 0 after its own check.  A check emits when (character, scene id) differ from
those of the check before (nothing at first).

Between two resets the mark only rises, so the events that move it are found by
jumps: the next one is where the running maximum of the positions first exceeds
the mark by more than ``duration``, one binary search per jump.  In a batch the
events of a session are cut into blocks.  Each block tells, for each running
maximum before its first reset (the only places where the mark can first be
moved), with which mark it would be left; a pass over these small tables gives
every block the mark it is entered with, and then all blocks find their checks
in parallel.  A stream keeps the mark and the last check in its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuesheet.constants import SCENE_DURATION_S
from cuesheet.sinks.files import materialize

EVENT_COLUMNS = ["session", "ts", "event_id", "episode", "position", "event_type", "speaker", "character", "scene_id"]
OUT_COLUMNS = ["session", "ts", "event_id", "episode", "position", "speaker", "character", "scene_id"]
UPDATE_COLUMNS = ["event_id", "session", "ts", "episode", "speaker", "character", "scene_name", "image_url"]
EMIT_SCHEMA = (
    "session long, ts timestamp, event_id long, episode string, position double, speaker string, character string, scene_id int"
)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK_ROWS = 1 << 16


def checks(position: np.ndarray, reset: np.ndarray, mark: float, duration: float) -> tuple[np.ndarray, float]:
    """Which events check for a change, and the mark afterwards.  A missing position never checks."""
    position = np.where(np.isnan(position), -np.inf, position)
    found, start = position == 0, 0
    for end in np.append(np.flatnonzero(reset) + 1, len(position)):
        high = np.maximum.accumulate(position[start:end])
        while (at := int(np.searchsorted(high, mark + duration, side="right"))) < len(high):
            mark = float(high[at])
            found[start + at] = True
        if end > start and reset[end - 1]:
            mark = 0.0
        start = end
    return found, mark


def _summary(rows: pd.DataFrame, duration: float) -> dict:
    """How a block turns the mark it is entered with into the one it is left with.

    ``highs``: the running maxima up to the first reset; ``leaves``: the mark
    in the end if it is first moved there; ``otherwise``: the mark in the end
    if it is never moved before the first reset (null: it stays as it is).
    """
    position = rows["position"].to_numpy(np.float64)
    reset = rows["event_type"].to_numpy() == 1
    first = int(np.argmax(reset)) + 1 if reset.any() else len(rows)
    after = checks(position[first:], reset[first:], 0.0, duration)[1] if reset.any() else None
    head = np.where(np.isnan(position[:first]), -np.inf, position[:first])
    running = np.maximum.accumulate(head)
    highs = running[np.diff(running, prepend=-np.inf) > 0]
    leaves = np.empty(len(highs))
    for i in range(len(highs) - 1, -1, -1):  # a mark set at one high is next moved at a later one
        j = int(np.searchsorted(highs, highs[i] + duration, side="right"))
        leaves[i] = leaves[j] if j < len(highs) else (highs[i] if after is None else after)
    return {"highs": highs.tolist(), "leaves": leaves.tolist(), "otherwise": after}


def _by_block(run: Callable[[pd.DataFrame], pd.DataFrame | None]):
    """Calls ``run`` on the rows of each (session, block) of sorted input; many small blocks share an Arrow batch."""

    def stream(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for chunk in chunks:
            if chunk.empty:
                continue
            ids = chunk[["session", "block"]].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True):
                part = chunk.iloc[a:b]
                if held and tuple(held[0][["session", "block"]].iloc[0]) != tuple(part[["session", "block"]].iloc[0]):
                    out.append(run(pd.concat(held)))
                    held = []
                held.append(part)
            if out := [rows for rows in out if len(rows)]:
                yield pd.concat(out)
        if held:
            yield run(pd.concat(held))

    return stream


def _entries(duration: float):
    """The mark that each block of a session is entered with, block by block."""

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, mark = None, 0.0
        for chunk in chunks:
            out = []
            for s, block, highs, leaves, otherwise in chunk.itertuples(index=False):
                if s != session:
                    session, mark = s, 0.0
                out.append((s, block, mark))
                at = int(np.searchsorted(np.asarray(highs, np.float64), mark + duration, side="right"))
                if at < len(highs):
                    mark = float(leaves[at])
                elif not pd.isna(otherwise):
                    mark = float(otherwise)
            yield pd.DataFrame(out, columns=["session", "block", "mark"])

    return run


def playback_changes(resolved: DataFrame, duration: float = SCENE_DURATION_S, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The emitted changes.  ``resolved``: EVENT_COLUMNS, one row per event.

    Rows are range-partitioned by (session, ts, event_id) and cut into blocks
    of ``block_rows``; a long session spans many of them.
    """
    d = resolved.select(*EVENT_COLUMNS).repartitionByRange("session", "ts", "event_id")
    d = d.sortWithinPartitions("session", "ts", "event_id")
    # the id counts the rows of a partition in order, so blocks are stretches of a session
    block = F.floor(F.monotonically_increasing_id() / F.lit(block_rows))
    d = materialize(d.withColumn("block", block), "playback")
    ordered = d.repartition("session", "block").sortWithinPartitions("session", "block", "ts", "event_id")

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"session": rows["session"].iat[0], "block": rows["block"].iat[0], **_summary(rows, duration)}])

    tables = ordered.select("session", "block", "ts", "event_id", "position", "event_type").mapInPandas(
        _by_block(summarise), "session long, block long, highs array<double>, leaves array<double>, otherwise double"
    )
    tables = tables.repartition("session").sortWithinPartitions("session", "block")
    marks = tables.mapInPandas(_entries(duration), "session long, block long, mark double")

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        hit = checks(rows["position"].to_numpy(np.float64), rows["event_type"].to_numpy() == 1, rows["mark"].iat[0], duration)[0]
        return rows.loc[hit, [*OUT_COLUMNS, "block"]]

    entered = d.join(marks, ["session", "block"]).repartition("session", "block")
    checked = entered.sortWithinPartitions("session", "block", "ts", "event_id").mapInPandas(
        _by_block(check), EMIT_SCHEMA + ", block long"
    )
    checked = materialize(checked, "checks")
    # the check before: in the same block, or the last one of an earlier block (one row per block)
    values = F.struct("character", "scene_id")
    here = Window.partitionBy("session", "block").orderBy("ts", "event_id")
    ends = checked.groupBy("session", "block").agg(F.max_by(values, F.struct("ts", "event_id")).alias("end"))
    earlier = ends.withColumn("before", F.lag("end").over(Window.partitionBy("session").orderBy("block"))).drop("end")
    both = checked.withColumn("inside", F.lag(values).over(here)).join(earlier, ["session", "block"])
    before = F.coalesce("inside", "before")
    same = F.col("character").eqNullSafe(before["character"]) & F.col("scene_id").eqNullSafe(before["scene_id"])
    return both.where(~same).select(*OUT_COLUMNS)


class ChangeDetector(StatefulProcessor):
    """Per session: the mark, the last check and the newest event seen, each a state of its own; gone when a timer finds it idle."""

    def __init__(self, duration: float, idle: int | None):
        self.duration, self.idle = duration, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "mark double")
        self.check = handle.getValueState("check", "character string, scene_id int")
        self.seen = handle.getValueState("seen", "ts_us long, event_id long")
        self.timer = handle.getValueState("timer", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        rows["us"] = rows["ts"].astype("datetime64[us]").astype("int64")
        if self.seen.exists():  # events behind what the state has seen come too late
            us, last = self.seen.get()
            rows = rows[(rows["us"] > us) | ((rows["us"] == us) & (rows["event_id"] > last))]
        if rows.empty:
            return
        mark = self.mark.get()[0] if self.mark.exists() else 0.0
        before = tuple(self.check.get()) if self.check.exists() else (None, None)
        hit, mark = checks(rows["position"].to_numpy(np.float64), rows["event_type"].to_numpy() == 1, mark, self.duration)
        found = rows.loc[hit]
        pairs = [
            (None if pd.isna(c) else c, None if pd.isna(i) else int(i))
            for c, i in zip(found["character"], found["scene_id"], strict=True)
        ]
        changed = [now != then for now, then in zip(pairs, [before, *pairs[:-1]], strict=True)]
        self.mark.update((float(mark),))
        if pairs:
            self.check.update(pairs[-1])
        self.seen.update((int(rows["us"].iat[-1]), int(rows["event_id"].iat[-1])))
        if self.idle:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = max(timerValues.getCurrentWatermarkInMs(), int(rows["us"].iat[-1]) // 1000) + self.idle * 1000
            self.handle.registerTimer(at)
            self.timer.update((at,))
        if any(changed):
            yield found.loc[changed, OUT_COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.mark, self.check, self.seen, self.timer):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def playback_stream(
    resolved: DataFrame, duration: float = SCENE_DURATION_S, watermark: str | None = None, idle: int = 86_400
) -> DataFrame:
    """Stream form over :func:`cuesheet.operators.lookup.lookup_scenes` output (EVENT_COLUMNS).

    Events of one micro-batch are sorted per session; events behind the newest
    one already processed for the session are dropped.  With a ``watermark``, a
    session's state goes once the watermark has moved ``idle`` seconds past its
    last event; without one it is kept.  Needs the RocksDB state store (see
    ``use_state_store``).
    """
    d = (resolved.withWatermark("ts", watermark) if watermark else resolved).select(*EVENT_COLUMNS)
    return d.groupBy("session").transformWithStateInPandas(
        ChangeDetector(duration, idle if watermark else None), EMIT_SCHEMA, "append", "eventTime" if watermark else "none"
    )


def use_state_store(spark) -> None:
    """``transformWithState`` keeps its fields in RocksDB; queries started later in the session use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def changes_of(events: DataFrame, viewer: DataFrame, watermark: str | None = None, idle: int = 86_400) -> DataFrame:
    """Polled events -> scene lookup (stream-static join) -> throttled change detection.

    The lookup's segments are written once and read as the static side of every
    micro-batch.  Events: session, ts, event_id, episode, position, event_type.
    """
    from cuesheet.operators.lookup import build_lookup_index, lookup_scenes

    segments = build_lookup_index(viewer)
    segments = replace(segments, index=materialize(segments.index, "lookup"))
    use_state_store(events.sparkSession)
    return playback_stream(lookup_scenes(events, segments, {"episode_name": "episode"}), watermark=watermark, idle=idle)


def start_playback_stream(
    events: DataFrame,
    viewer: DataFrame,
    checkpoint_location: str,
    sink_path: str,
    watermark: str | None = None,
    idle: int = 86_400,
    trigger: dict | None = None,
    query_name: str | None = None,
):
    """Changes of a stream of events (see ``changes_of``), as Parquet.

    ``checkpoint_location`` is the caller's: a restart with the same one goes on
    where the stream stopped.  A batch that runs again replaces what it wrote.
    """
    out = changes_of(events, viewer, watermark, idle)
    return _start(out, lambda batch: batch, checkpoint_location, sink_path, trigger, query_name)


def start_image_updates(
    events: DataFrame,
    viewer: DataFrame,
    checkpoint_location: str,
    sink_path: str,
    variation: Column,
    watermark: str | None = None,
    idle: int = 86_400,
    trigger: dict | None = None,
    query_name: str | None = None,
):
    """Image updates of a stream of events: each change looks its scene up again among the rows of its speaker and
    character, and gets the URL of the scene's image number ``variation`` (see ``image_url``)."""
    from cuesheet.operators.lookup import build_lookup_index, image_url, lookup_scenes

    segments = build_lookup_index(viewer, ["episode_name", "speaker", "character"])
    segments = replace(segments, index=materialize(segments.index, "lookup"))

    def update(batch: DataFrame) -> DataFrame:
        found = lookup_scenes(batch, segments, {"episode_name": "episode"})
        return image_url(found, "episode", variation).select(*UPDATE_COLUMNS)

    return _start(changes_of(events, viewer, watermark, idle), update, checkpoint_location, sink_path, trigger, query_name)


def _start(out: DataFrame, finish: Callable[[DataFrame], DataFrame], checkpoint_location: str, sink_path: str, trigger, query_name):
    """Writes each micro-batch to a partition of its own, named by the batch id, in place of what a first try left there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        finish(batch).write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")

    w = out.writeStream.outputMode("append").option("checkpointLocation", checkpoint_location).foreachBatch(write)
    w = w.queryName(query_name) if query_name else w
    return (w.trigger(**trigger) if trigger else w).start()
