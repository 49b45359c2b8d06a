"""Image work manifests: per-scene metadata, image rows, upload points, file naming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.constants import BATCHES_PER_PROMPT, IMAGES_PER_PROMPT
from cuesheet.operators.indexing import global_ordinal


def scene_metadata(scenes: DataFrame, metadata: dict[str, str | None], fields: list[str]) -> DataFrame:
    """``{**scene, **metadata}`` as JSON (metadata wins on equal keys) and its file name."""
    d = scenes.withColumns({k: F.lit(v).cast("string") for k, v in metadata.items()})
    keep = [c for c in fields if c not in metadata] + list(metadata)
    return d.select(
        "episode_name", "scene_id",
        F.format_string("scene_%03d_metadata.json", F.col("scene_id")).alias("metadata_file"),
        F.to_json(F.struct(*[F.col(c) for c in keep]), {"ignoreNullFields": "false"}).alias("metadata_json"),
    )


def image_manifest(
    scenes: DataFrame,
    done: DataFrame | None = None,
    images_per_prompt: int = IMAGES_PER_PROMPT,
    batches_per_prompt: int = BATCHES_PER_PROMPT,
) -> DataFrame:
    """One row per image to render: scenes minus finished ones (by episode, scene),
    ``batches * per_prompt`` images each, named ``{ep}/scene_{id:03}_image_{n:02}.png``."""
    todo = scenes if done is None else scenes.join(
        done.select("episode_name", "scene_id").distinct(), ["episode_name", "scene_id"], "left_anti"
    )
    n = images_per_prompt * batches_per_prompt
    if n <= 0:
        return todo.select("episode_name", "scene_id").where(F.lit(False)).withColumns(
            {"image_num": F.lit(0), "image_path": F.lit("")}
        )
    out = todo.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("image_num"))
    return out.withColumn(
        "image_path",
        F.format_string("%s/scene_%03d_image_%02d.png", F.col("episode_name"), F.col("scene_id"), F.col("image_num")),
    )


def upload_points(generated: DataFrame) -> DataFrame:
    """Change points of the episode along the processing order (episode, scene).

    Every episode is uploaded once, right after its last scene; ``is_first``
    marks where the episode changes (first row included).
    """
    g = global_ordinal(generated.select("episode_name", "scene_id"), ["episode_name", "scene_id"], out_col="ordinal")
    # episodes are contiguous in this order
    ends = g.groupBy("episode_name").agg(F.min("ordinal").alias("__first"), F.max("ordinal").alias("__last"))
    return g.join(ends, "episode_name").select(
        "ordinal", "episode_name", "scene_id",
        (F.col("ordinal") == F.col("__first")).alias("is_first"),
        (F.col("ordinal") == F.col("__last")).alias("upload_after"),
    )


def content_names(images: DataFrame, existing: DataFrame) -> DataFrame:
    """``{index + existing}-{sha1(content)}.jpg`` per instance folder.

    ``images``: instance, id, content (index = 0-based order by id within the
    instance); ``existing``: instance, n_existing.
    """
    # the digest, not the content, goes through the sort and the scratch table
    named = images.select("instance", "id", F.sha1("content").alias("digest"))
    g = global_ordinal(named, ["instance", "id"], out_col="__o")
    first = g.groupBy("instance").agg(F.min("__o").alias("__o0"))
    g = g.join(first, "instance").join(existing, "instance", "left")
    idx = F.col("__o") - F.col("__o0")
    return g.select(
        "instance", "id",
        F.format_string("%d-%s.jpg", idx + F.coalesce(F.col("n_existing"), F.lit(0)), F.col("digest")).alias(
            "file_name"
        ),
    )


def download_manifest(instances: DataFrame) -> DataFrame:
    """Target ``{instance}/{last URL path piece}``; on a name collision the
    URL later in the list wins (it overwrites the earlier file)."""
    d = instances.select("instance_name", "url", "pos", F.substring_index("url", "/", -1).alias("file_name"))
    best = d.groupBy("instance_name", "file_name").agg(
        F.max_by(F.struct("url", "pos"), F.col("pos")).alias("w"), F.count(F.lit(1)).alias("n_urls")
    )
    return best.select(
        "instance_name", "file_name",
        F.concat_ws("/", "instance_name", "file_name").alias("target"),
        F.col("w.url").alias("url"), F.col("w.pos").alias("pos"), "n_urls",
    )


def unnest_urls(config: DataFrame) -> DataFrame:
    """Config rows with a list ``instance_urls`` -> a row per URL with its place ``pos`` in the list (from 0).

    An instance whose list is kept in several rows has their number in
    ``part``; its parts count on.  Null and empty lists, and null URLs, give
    no row.
    """
    if "part" in config.columns:
        before = Window.partitionBy("instance_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        config = config.withColumn("__first", F.coalesce(F.sum(F.size("instance_urls")).over(before), F.lit(0)))
    else:
        config = config.withColumn("__first", F.lit(0))
    urls = config.select("instance_name", "__first", F.posexplode("instance_urls").alias("i", "url"))
    return urls.where(F.col("url").isNotNull()).select("instance_name", "url", (F.col("__first") + F.col("i")).cast("long").alias("pos"))
