"""Playback position -> scene lookup.

Rules per event (episode rows optionally filtered by speaker/character):
clamp the position into ``[min start_time, max end_time]`` of the rows; at or
before the episode's game start -> nearest *environment* row by midpoint;
inside the break (inclusive) -> nearest environment row to position 0;
otherwise the row whose ``[start_time, end_time]`` holds the time (lowest row
order when several do), else the nearest row by midpoint.  Ties go to the
lowest row order.

Implementation: the rows of each key become disjoint segments (see
:mod:`cuesheet.operators.segments`), each with the interval that wins there,
how many intervals overlap, and the rows and environment rows next to it by
midpoint.  An event sends one probe and meets one segment, so nothing is
aggregated and the event's columns are moved once.  The segments are a plain
table, and the same join serves a stream (stream-static join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.constants import DEFAULT_IMAGE_BASE_URL, ENVIRONMENT, EPISODE_META, NUM_IMAGE_VARIATIONS
from cuesheet.operators.segments import BLOCK_ROWS, Segments, build_segments, locate, nearest, with_bounds

PAYLOAD = ["idx", "scene_id", "speaker", "character", "scene_name"]


def episode_meta(spark) -> DataFrame:
    """Fixed per-episode constants (game start, break); three rows."""
    return spark.createDataFrame(
        EPISODE_META, "meta_episode string, game_start int, break_start int, break_end int"
    )


def build_lookup_index(viewer: DataFrame, keys: Sequence[str] = ("episode_name",), block_rows: int = BLOCK_ROWS) -> Segments:
    """The segments that :func:`lookup_scenes` reads.

    ``viewer``: keys + idx (row order), scene_id, speaker, character,
    scene_name, start_time, end_time, mid_point.
    """
    rows = viewer.select(*dict.fromkeys([*keys, *PAYLOAD, "start_time", "end_time", "mid_point"]))
    kinds = {"all": F.lit(True), "env": F.coalesce(F.col("character") == ENVIRONMENT, F.lit(False))}
    return build_segments(rows, keys, "mid_point", "idx", PAYLOAD, kinds, ("start_time", "end_time"), block_rows)


def lookup_scenes(
    events: DataFrame,
    segments: Segments,
    event_key_map: dict[str, str] | None = None,
    position_col: str = "position",
    meta: DataFrame | None = None,
) -> DataFrame:
    """Resolve every event to one viewer row (null columns when none exists).

    ``event_key_map`` maps lookup keys to event columns (default same name).
    Output: event columns + ``t`` (clamped time), ``mode``, ``overlap_count``
    (how many intervals hold the time; null in intro and break) and the row
    fields.  ``events`` may be a stream.
    """
    on = {k: (event_key_map or {}).get(k, k) for k in segments.keys}
    meta = meta if meta is not None else episode_meta(events.sparkSession)
    # the constants table has three rows: a proven bound, so it is broadcast
    e = with_bounds(events, segments, on).join(F.broadcast(meta), F.col(on[segments.keys[0]]) == F.col("meta_episode"), "left")
    pos = F.col(position_col)
    e = e.withColumn("t", F.when(F.col("last_end").isNotNull(), F.greatest(F.least(pos, F.col("last_end")), F.col("first_start"))))
    intro = F.coalesce(F.col("t") <= F.col("game_start"), F.lit(False))
    brk = F.coalesce((F.col("t") >= F.col("break_start")) & (F.col("t") <= F.col("break_end")), F.lit(False))
    e = e.withColumn("mode0", F.when(intro, F.lit("intro")).when(brk, F.lit("break")).otherwise(F.lit("scene")))
    # during the break the episode's start is what an environment is looked for at
    e = e.withColumn("p_t", F.when(brk, F.lit(0.0)).otherwise(F.col("t")))
    j = locate(e, segments, on, "p_t")
    scene, hit = F.col("mode0") == "scene", F.col("hit").isNotNull()
    best = F.when(~scene, nearest("env", F.col("p_t"))["a"]).when(hit, F.col("hit")).otherwise(nearest("all", F.col("p_t"))["a"])
    mode = F.when(~scene, F.col("mode0")).when(hit, F.lit("hit")).when(F.col("b").isNotNull(), F.lit("nearest"))
    fields = [c for c in ["scene_id", "speaker", "character", "scene_name", "idx"] if c not in events.columns]
    overlap = F.when(scene, F.col("overlap_count")).alias("overlap_count")
    return j.withColumn("b", best).select(*events.columns, "t", mode.alias("mode"), overlap, *[F.col(f"b.{c}").alias(c) for c in fields])


def image_url(df: DataFrame, episode_col: str, variation: "F.Column", base: str = DEFAULT_IMAGE_BASE_URL) -> DataFrame:
    """``{base}/{episode}/{scene_name}_image_{nn:02}.png`` for a variation 0..11."""
    url = F.format_string(f"{base}/%s/%s_image_%02d.png", F.col(episode_col), F.col("scene_name"),
                          F.pmod(variation, F.lit(NUM_IMAGE_VARIATIONS)))
    return df.withColumn("image_url", F.when(F.col("scene_name").isNotNull(), url))


def nearest_scene(events: DataFrame, viewer: DataFrame, environment: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nearest row by midpoint (optionally among environment rows), ties -> lowest row order.  One row per event."""
    rows = viewer.where(F.col("character") == ENVIRONMENT) if environment else viewer
    segments = build_segments(rows, ["episode_name"], "mid_point", "idx", ["scene_id"], block_rows=block_rows)
    on = {"episode_name": "episode"}
    found = locate(with_bounds(events, segments, on), segments, on, "position").withColumn("b", nearest("all", F.col("position")))
    return found.select(*events.columns, F.col("b.a.scene_id").alias("scene_id"), F.col("b.a.idx").alias("idx"), F.col("b.dist").alias("distance"))
