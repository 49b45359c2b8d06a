"""Captions -> speaker turns (speaker tag split + forward fill)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.constants import DEFAULT_INITIAL_SPEAKER, SPEAKER_PATTERN
from cuesheet.operators.ordered import forward_fill


def speaker_turns(
    captions: DataFrame,
    episode_col: str = "episode",
    idx_col: str = "idx",
    pattern: str = SPEAKER_PATTERN,
    default_speaker: str = DEFAULT_INITIAL_SPEAKER,
) -> DataFrame:
    """Attribute every caption to a speaker.

    ``captions`` holds ``episode, idx (0-based file order), text, start, duration``.
    A caption that is the first of its episode, or that matches ``pattern``
    (upper-case tag and colon at the start), is split on its first colon into
    speaker and text (the text keeps its leading blank).  A first caption
    without a colon gets ``default_speaker`` and keeps its text.  Other captions
    keep their text and inherit the last speaker.  ``end = start + duration``.
    """
    text = F.col("text")
    pos = F.instr(text, ":")
    split_here = (F.col(idx_col) == 0) | text.rlike(pattern)
    tagged = captions.select(
        "*",
        F.when(split_here & (pos > 0), F.substring_index(text, ":", 1))
        .when(split_here, F.lit(default_speaker))
        .alias("__spk"),
        F.when(split_here & (pos > 0), F.expr("substr(text, instr(text, ':') + 1)"))
        .otherwise(text)
        .alias("__text"),
    )
    filled = forward_fill(tagged, [episode_col], idx_col, "__spk", "speaker")
    rest = [c for c in captions.columns if c not in ("text", "duration")]
    return filled.select(
        *rest,
        "speaker",
        F.col("__text").alias("text"),
        (F.col("start") + F.col("duration")).alias("end"),
    )
