"""Sinks: per-episode caption/scene JSON, aligned CSV export, lookup CSV, tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.session import checkpoint_dir
from cuesheet.sinks.named import write_named
from cuesheet.sources.files import CSV_OPTIONS


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def write_caption_files(captions: DataFrame, path: str) -> None:
    """One JSON array per episode, the file ``<episode>_<youtube_id>.json``.

    ``captions``: episode, youtube_id, idx, text, start, duration.  An episode
    transcript is one file by format, so its captions are gathered per episode.
    """
    per = captions.groupBy("episode", "youtube_id").agg(
        F.to_json(
            F.transform(
                F.array_sort(F.collect_list(F.struct("idx", "text", "start", "duration"))),
                lambda c: F.struct(c["text"].alias("text"), c["start"].alias("start"), c["duration"].alias("duration")),
            )
        ).alias("value")
    )
    write_named(per.select(F.concat(F.concat_ws("_", "episode", "youtube_id"), F.lit(".json")).alias("name"), F.col("value").alias("text")), path)


def write_scene_files(scenes: DataFrame, path: str) -> None:
    """One ``{name, scenes}`` JSON document per episode (scene order by scene_id), the file ``<name>_scenes.json``.

    Scenes keep their ``turns`` (see ``assemble_scenes``); without that column
    the arrays are empty.  An episode is one document by format.
    """
    kind = "array<struct<speaker:string,text:string,start:double,end:double>>"
    if "turns" not in scenes.columns:
        scenes = scenes.withColumn("turns", F.array().cast(kind))
    fields = [
        "character", "speaker", "in_game", "background", "action", "object", "poses",
        "start_time", "end_time", "scene_description",
    ]
    per = scenes.groupBy("episode", "youtube_id").agg(
        F.array_sort(F.collect_list(F.struct("scene_id", *fields, "turns"))).alias("s")
    )
    doc = per.select(
        F.concat_ws("_", "episode", "youtube_id").alias("name"),
        F.transform(
            "s",
            lambda x: F.struct(
                *[x[f].alias(f) for f in fields],
                x["turns"].cast(kind).alias("turns"),
            ),
        ).alias("scenes"),
    )
    write_named(doc.select(F.concat(F.col("name"), F.lit("_scenes.json")).alias("name"), F.to_json(F.struct("name", "scenes")).alias("text")), path)


def export_aligned(aligned: DataFrame, path: str, with_all: bool = True) -> None:
    """CSV with header: ``by_episode/<episode>.csv`` for each, in the order of idx, and one table ``all`` of them.

    Quotes are doubled and texts may hold line breaks, as CSV readers expect;
    an empty text stays apart from a null one.  An episode is one file by format.
    """
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_OPTIONS.items()}
    line = F.to_csv(F.struct(*aligned.columns), options)
    per = aligned.select("episode_name", F.struct("idx", line.alias("line")).alias("l")).groupBy("episode_name").agg(F.array_sort(F.collect_list("l")).alias("l"))
    header = F.lit(",".join(aligned.columns))
    text = F.concat(F.array_join(F.concat(F.array(header), F.col("l.line")), "\n"), F.lit("\n"))
    write_named(per.select(F.concat("episode_name", F.lit(".csv")).alias("name"), text.alias("text")), f"{path}/by_episode")
    if with_all:
        aligned.write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{path}/all")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Publish a table: what was there before goes, partitions included."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace the partitions that ``df`` has rows for; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


_MATERIALIZED: dict[tuple[str, str], str] = {}


def materialize(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read
    it back: cuts the lineage (a lost executor re-reads files instead of
    recomputing upstream joins) and stops fan-out from recomputing it.
    ``key`` memoizes the table for the session (e.g. a published table reused
    by several queries)."""
    spark = df.sparkSession
    memo = (spark.sparkContext.applicationId, key) if key else None
    if memo and memo in _MATERIALIZED:
        return spark.read.parquet(_MATERIALIZED[memo])
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    if memo:
        _MATERIALIZED[memo] = path
    return spark.read.parquet(path)
