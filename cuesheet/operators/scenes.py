"""Scene-table operators: id maps, episode lists, bounds, gaps, resume and pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.constants import SPEAKER_MAP, TRANSCRIPT_LANGUAGES
from cuesheet.operators.indexing import global_ordinal, lag_dense


def video_id_map(viewer: DataFrame, order_col: str = "idx") -> DataFrame:
    """episode_name -> first non-null youtube_id in row order."""
    return (
        viewer.where(F.col("youtube_id").isNotNull())
        .groupBy("episode_name")
        .agg(F.min_by("youtube_id", F.col(order_col)).alias("youtube_id"))
    )


def distinct_in_order(rows: DataFrame, value: str, order: str | Column, more: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values, numbered from 0 (``position``) by where each first appears in ``order``; nulls are one value.

    One row a value leaves the tasks that read the rows; only these few are
    ranked.  ``more`` names further aggregates.
    """
    order = F.col(order) if isinstance(order, str) else order
    first = rows.groupBy(value).agg(F.min(order).alias("__first"), *(c.alias(n) for n, c in (more or {}).items()))
    return global_ordinal(first, ["__first", value], out_col="position").drop("__first")


def episode_list(viewer: DataFrame, order_col: str = "idx") -> DataFrame:
    """Distinct episodes in the order in which they first appear by ``order_col`` (a total order of the viewer's rows), with
    their dropdown label and first video id."""
    order = F.col(order_col)
    video = F.min_by("youtube_id", F.when(F.col("youtube_id").isNotNull(), order))
    ranked = distinct_in_order(viewer, "episode_name", order, {"youtube_id": video})
    return ranked.select(
        "episode_name",
        F.col("position").cast("int").alias("position"),
        # a name without the separator has no label
        F.concat(F.lit("Campaign 2 Episode "), F.get(F.split("episode_name", "e"), F.lit(1))).alias("label"),
        "youtube_id",
    )


def scene_bounds(viewer: DataFrame, keys: Sequence[str] = ("episode_name",)) -> DataFrame:
    return viewer.groupBy(*keys).agg(
        F.min("start_time").alias("min_start"), F.max("end_time").alias("max_end"), F.count(F.lit(1)).alias("n_rows")
    )


def scene_gap(scenes: DataFrame) -> DataFrame:
    """Previous scene's end time per episode (dense scene ids), gap and overlap."""
    d = lag_dense(scenes.select("episode", "scene_id", "start_time", "end_time"), ["episode"], "scene_id", ["end_time"])
    return d.select(
        "episode", "scene_id", "start_time", "end_time",
        F.col("prev_end_time"),
        (F.col("start_time") - F.col("prev_end_time")).alias("gap"),
        (F.col("start_time") < F.col("prev_end_time")).cast("int").alias("overlap"),
    )


def assemble_scenes(valid: DataFrame, collected: DataFrame) -> DataFrame:
    """Valid scenes of all batches of an episode, numbered, each with the turns of its batch.

    ``valid``: episode, batch, scene_idx and scene fields; ``collected``:
    episode, batch, turns (see ``batch_collect``).  ``scene_id`` counts from 0
    over (batch, scene_idx): the place within the batch, which is bounded, plus
    the scenes of earlier batches, from a table with one row per batch.  A
    batch without turns gives an empty array.
    """
    inside = Window.partitionBy("episode", "batch").orderBy("scene_idx")
    sizes = valid.groupBy("episode", "batch").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("episode").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("episode", "batch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    turns = collected.select(
        "episode", "batch", F.transform("turns", lambda t: t.dropFields("idx")).alias("turns")
    )
    none = F.array().cast(turns.schema["turns"].dataType)
    numbered = valid.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["episode", "batch"])
    return (
        numbered.withColumn("scene_id", (F.col("before") + F.col("place")).cast("int"))
        .drop("before", "place")
        .join(turns, ["episode", "batch"], "left")
        .withColumn("turns", F.coalesce("turns", none))
    )


def episode_limit(files: DataFrame, done: DataFrame, n_episodes: int | None) -> DataFrame:
    """Sorted files, first ``n_episodes`` (done ones count toward n), minus done.

    ``files``: stem; ``done``: stem.
    """
    stems = files.select("stem").distinct()
    if n_episodes is None:
        ranked = global_ordinal(stems, ["stem"], out_col="ordinal", start=1)
    else:
        # the first n of each task are all that is compared; n rows are numbered
        ranked = stems.orderBy("stem").limit(n_episodes).withColumn("ordinal", F.row_number().over(Window.orderBy("stem")).cast("long"))
    return ranked.join(done.select("stem").distinct(), "stem", "left_anti")


def resume_anti(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work still to do: rows whose key has no finished output."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def episode_pairing(captions: DataFrame, scenes: DataFrame, stop_at_gap: bool = False) -> DataFrame:
    """Caption episodes paired with a scene file by stem; episodes whose scene
    list is empty are skipped.  ``stop_at_gap`` keeps only episodes sorted
    before the first caption file that has no scene file."""
    cap = captions.select("stem").distinct()
    sc = scenes.groupBy("stem").agg(F.count(F.lit(1)).alias("n_scenes"))
    paired = cap.join(sc, "stem", "left")
    if stop_at_gap:
        # one scalar (the first stem without a scene file) comes to the driver
        gap = paired.where(F.col("n_scenes").isNull()).agg(F.min("stem")).first()[0]
        if gap is not None:
            paired = paired.where(F.col("stem") < F.lit(gap))
    return paired.where(F.col("n_scenes") > 0)


def video_id_extract(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Video id = text after the last ``v=``."""
    return urls.withColumn("video_id", F.substring_index(F.col(url_col), "v=", -1))


def transcript_pick(transcripts: DataFrame, languages: Sequence[str] = tuple(TRANSCRIPT_LANGUAGES)) -> DataFrame:
    """First manually created transcript by language preference per video.

    ``transcripts``: video, language, is_manual, transcript_id.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("language"))
    cand = transcripts.where(F.col("is_manual") & (rank > 0))
    return cand.groupBy("video").agg(
        F.min(F.struct(rank.alias("rank"), F.col("transcript_id").alias("transcript_id"), F.col("language").alias("language"))).alias("b")
    ).select("video", "b.transcript_id", "b.language")


def episode_numbering(videos: DataFrame, order: Sequence[str], id_col: str = "video_id") -> DataFrame:
    """1-based playlist ordinal -> transcript file name ``c2e{i:03}_{id}.json``."""
    ranked = global_ordinal(videos, list(order), out_col="ordinal", start=1)
    return ranked.select(
        "*",
        F.format_string("c2e%03d_%s.json", F.col("ordinal"), F.col(id_col)).alias("file_name"),
    )


def speaker_check(viewer: DataFrame) -> DataFrame:
    """Consistency of character and speaker with the fixed character->speaker map."""
    pairs = viewer.sparkSession.createDataFrame(list(SPEAKER_MAP.items()), "character_key string, expected_speaker string")
    d = viewer.withColumn("character_key", F.lower(F.trim("character")))
    j = d.join(F.broadcast(pairs), "character_key", "left")
    return j.groupBy("episode_name", "character_key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("expected_speaker").isNull(), 0)
              .when(F.upper("speaker") == F.col("expected_speaker"), 0).otherwise(1)).cast("long").alias("n_mismatch"),
        F.max(F.col("expected_speaker")).alias("expected_speaker"),
    )
