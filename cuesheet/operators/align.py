"""Caption <-> scene alignment (speaker equality + nearest start time)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.constants import ALIGN_TOLERANCE_S
from cuesheet.operators.segments import BLOCK_ROWS, build_segments, locate, nearest, with_bounds


def align_scenes(
    turns: DataFrame,
    scenes: DataFrame,
    tolerance: float = ALIGN_TOLERANCE_S,
    keep_unaligned: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Attach a scene to every caption turn.

    Candidates: scenes of the same episode whose speaker equals the caption's
    speaker case-insensitively and whose ``start_time <= start + tolerance``
    (no lower bound).  The candidate with the smallest
    ``|start_time - start|`` wins; ties go to the lowest ``scene_id``.
    Captions without a candidate get ``scene_id = -1`` and are dropped unless
    ``keep_unaligned``.

    ``turns``: episode, youtube_id, idx, speaker, text, start, end.
    ``scenes``: episode, scene_id, speaker, character, in_game, start_time.
    ``block_rows``: scenes of a key that share a block of the join (cut at
    quantiles of their times).
    Output: episode_name, youtube_id, idx, speaker, text, start, end,
    scene_id, character, in_game.
    """
    if tolerance < 0:
        raise ValueError("tolerance must be >= 0")
    anchors = scenes.select("episode", F.lower("speaker").alias("_spk"), "start_time", "scene_id", "character", "in_game")
    segments = build_segments(
        anchors, ["episode", "_spk"], "start_time", "scene_id", ["scene_id", "character", "in_game"], block_rows=block_rows
    )
    on = {"episode": "episode", "_spk": "_spk"}
    probes = turns.select(
        "episode", "youtube_id", "idx", "speaker", "text", "start", "end", F.lower("speaker").alias("_spk")
    )
    found = locate(with_bounds(probes, segments, on), segments, on, "start")
    found = found.withColumn("m", nearest("all", F.col("start"), limit=F.col("start") + F.lit(float(tolerance))))
    out = found.select(
        F.col("episode").alias("episode_name"),
        "youtube_id", "idx", "speaker", "text", "start", "end",
        F.coalesce(F.col("m.a.scene_id"), F.lit(-1)).cast("int").alias("scene_id"),
        F.col("m.a.character").alias("character"),
        F.col("m.a.in_game").alias("in_game"),
    )
    return out if keep_unaligned else out.where(F.col("scene_id") != -1)
