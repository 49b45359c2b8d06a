"""Transcript-shaped views derived from the driver tables.

The driver tables carry no transcripts, so the shapes the operators consume
(captions, scenes, extractor responses, playback positions, image folders,
vectors, checkpoints) are derived from them with one fixed rule each.  The
same rules exist as DuckDB SQL in :mod:`cuesheet.plans.oracle_views`; both
must stay in step.  Lengths are divided by 16 so every time is a dyadic
fraction and sums are exact in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.sources.tables import read_table

# ---------------------------------------------------------------------------
# FIXED VALUES of the fixture rules
# ---------------------------------------------------------------------------
TIME_DIVISOR = 16
SCENE_SHIFT_S = 40.0
SCENES_PER_RESPONSE = 3
RESPONSE_VARIANTS = 7
N_INSTANCES = 11
FREE_CHARACTERS = ["Fjord and Jester", "beauregard", "essek", " Caleb ", "jest"]


def captions_view(spark: SparkSession, sf_dir: str, keep_keys: bool = False) -> DataFrame:
    """conversations -> caption rows (episode, youtube_id, idx, text, start, duration).

    Every line of a turn is one caption; the first line of each turn carries the
    role as an upper-case speaker tag.  Times are cumulative text length / 16.
    """
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    lines = conv.select(
        "conv_id", "turn", "role",
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
    )
    text = F.when(F.col("pos") == 0, F.concat(F.upper("role"), F.lit(": "), F.col("line"))).otherwise(
        F.col("line")
    )
    w = Window.partitionBy("conv_id").orderBy("turn", "pos")
    df = lines.select(
        F.format_string("c2e%03d", F.col("conv_id")).alias("episode"),
        F.concat(F.lit("vid"), F.col("conv_id").cast("string")).alias("youtube_id"),
        "conv_id", "turn", "pos",
        text.alias("text"),
    )
    df = df.select(
        "*",
        (F.row_number().over(w) - 1).cast("int").alias("idx"),
        (
            F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            .cast("double") / TIME_DIVISOR
        ).alias("start"),
        (F.length("text").cast("double") / TIME_DIVISOR).alias("duration"),
    )
    cols = ["episode", "youtube_id", "idx", "text", "start", "duration"]
    return df.select(*cols, "conv_id", "turn") if keep_keys else df.select(*cols)


def _free_character() -> F.Column:
    out = None
    for i, name in enumerate(FREE_CHARACTERS):
        cond = (F.col("conv_id") % len(FREE_CHARACTERS)) == i
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def scenes_view(spark: SparkSession, sf_dir: str, keep_keys: bool = False) -> DataFrame:
    """One scene per conversation turn (episode, scene_id, speaker, character, ...)."""
    caps = captions_view(spark, sf_dir, keep_keys=True)
    times = caps.groupBy("conv_id", "turn").agg(
        F.min("start").alias("t0"), F.max(F.col("start") + F.col("duration")).alias("t1")
    )
    conv = read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.replace("text", F.lit("\n"), F.lit(" ")).alias("line")
    )
    # the whole text, in four parts
    part = F.floor((F.length("line") + 3) / 4).cast("int")
    field = lambda i: F.substring(F.col("line"), i * part + 1, part)
    df = conv.join(times, ["conv_id", "turn"])
    shift = ((F.col("turn") + 1) % 4).cast("double") * SCENE_SHIFT_S
    character = (
        F.when(F.col("role") == "system", F.lit("environment"))
        .when(F.col("role") == "user",
              F.when(F.col("conv_id") % 2 == 0, F.lit("fjord")).otherwise(F.lit("Sam as Veth")))
        .when(F.col("turn") % 3 == 0, F.lit("caduceus"))
        .when(F.col("turn") % 3 == 1, F.lit("matt"))
        .otherwise(_free_character())
    )
    description = (
        F.when(F.col("turn") % 5 == 3, F.lit("jester"))
        .when(F.col("turn") % 5 == 4, F.lit(" JESTER "))
        .otherwise(F.col("line"))
    )
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = df.select(
        F.format_string("c2e%03d", F.col("conv_id")).alias("episode"),
        (F.row_number().over(w) - 1).cast("int").alias("scene_id"),
        F.when(F.col("turn") % 2 == 0, F.lower("role")).otherwise(F.upper("role")).alias("speaker"),
        character.alias("character"),
        F.when(F.col("role") == "system", F.lit(0)).otherwise(F.lit(1)).cast("int").alias("in_game"),
        field(0).alias("background"),
        field(1).alias("action"),
        field(2).alias("object"),
        field(3).alias("poses"),
        (F.col("t0") + shift).alias("start_time"),
        (F.col("t1") + shift).alias("end_time"),
        description.alias("scene_description"),
        "conv_id", "turn",
    )
    cols = [
        "episode", "scene_id", "speaker", "character", "in_game", "background", "action",
        "object", "poses", "start_time", "end_time", "scene_description",
    ]
    return out.select(*cols, "conv_id", "turn") if keep_keys else out.select(*cols)


def _esc(c: F.Column) -> F.Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def responses_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor responses (episode, batch, attempt, text), one per 3 scenes.

    Variant by (conv_id + batch) % 7: 0 valid, 1 fenced, 2 '...' line,
    3 missing opening quote after a newline, 4 'endtime' key,
    5 'environment' key, 6 truncated (cannot be repaired).
    """
    sc = scenes_view(spark, sf_dir, keep_keys=True).withColumn(
        "batch", F.floor(F.col("scene_id") / SCENES_PER_RESPONSE).cast("int")
    )
    v = (F.col("conv_id") + F.col("batch")) % RESPONSE_VARIANTS
    end_key = F.when(v == 4, F.lit('"endtime"')).otherwise(F.lit('"end_time"'))
    head = (
        F.when(v == 3, F.lit('{\ncharacter": '))
        .when(v == 5, F.lit('{"environment": "yes", "character": '))
        .otherwise(F.lit('{"character": '))
    )
    # typed-value cases: in_game as text (coerced), 1.5 (rejected); numeric character (rejected)
    sid = F.col("scene_id")
    char_txt = F.when(sid % 7 == 6, sid.cast("string")).otherwise(F.concat(F.lit('"'), _esc(F.col("character")), F.lit('"')))
    in_game_txt = (
        F.when(sid % 5 == 2, F.concat(F.lit('"'), F.col("in_game").cast("string"), F.lit('"')))
        .when(sid % 5 == 4, F.concat(F.col("in_game").cast("string"), F.lit(".5")))
        .otherwise(F.col("in_game").cast("string"))
    )
    line = F.concat(
        head, char_txt,
        F.lit(', "speaker": "'), _esc(F.col("speaker")),
        F.lit('", "in_game": '), in_game_txt,
        F.lit(', "background": "'), _esc(F.col("background")),
        F.lit('", "action": "'), _esc(F.col("action")),
        F.lit('", "object": "'), _esc(F.col("object")),
        F.lit('", "poses": "'), _esc(F.col("poses")),
        F.lit('", "start_time": '), F.col("start_time").cast("string"),
        F.lit(", "), end_key, F.lit(": "), F.col("end_time").cast("string"),
        F.lit(', "scene_description": "'), _esc(F.col("scene_description")),
        F.lit('"}'),
    )
    per = sc.select("episode", "conv_id", "batch", "scene_id", line.alias("line"))
    grouped = per.groupBy("episode", "conv_id", "batch").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("scene_id", "line"))), lambda s: s["line"]),
            ",\n",
        ).alias("lines")
    )
    v = (F.col("conv_id") + F.col("batch")) % RESPONSE_VARIANTS
    body = F.concat(F.lit('{"scenes": [\n'), F.col("lines"), F.lit("\n]}"))
    text = (
        F.when(v == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(v == 2, F.concat(F.lit('{"scenes": [\n'), F.col("lines"), F.lit("\n...\n]}")))
        .when(v == 6, F.substring(body, 1, F.floor(F.length(body) / 2).cast("int")))
        .otherwise(body)
    )
    return grouped.select("episode", "batch", F.lit(0).alias("attempt"), text.alias("text"))


def positions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playback events (event_id, session, episode, position, event_type, ts) from `events`.

    episode = user_id % (number of conversations); 'signup' is a seek/reset (1),
    everything else a poll (0).  Times are cut to the day, so events of a
    session share them.
    """
    n_conv = read_table(spark, sf_dir, "conversations").select(F.countDistinct("conv_id")).scalar()
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return ev.select(
        "event_id",
        F.col("user_id").alias("session"),
        F.format_string("c2e%03d", F.col("user_id") % n_conv).alias("episode"),
        F.col("value").alias("position"),
        F.when(F.col("event_type") == "signup", F.lit(1)).otherwise(F.lit(0)).cast("int").alias("event_type"),
        F.date_trunc("day", "ts").alias("ts"),
    )


def instances_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image URLs per training instance (instance_name, url, pos) from `pages`."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select(
        F.format_string("inst%02d", F.col("page_id") % N_INSTANCES).alias("instance_name"),
        "url",
        F.col("page_id").alias("pos"),
    )


def images_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image-folder rows (id, instance, height, width, content) from `documents`."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.format_string("inst%02d", F.col("doc_id") % N_INSTANCES).alias("instance"),
        (F.lit(256) + F.col("n_chars") % 700).cast("int").alias("height"),
        (F.lit(256) + (F.col("n_chars") * 7) % 900).cast("int").alias("width"),
        F.col("text").alias("content"),
    )


def vectors_view(spark: SparkSession, sf_dir: str, ragged: bool = False) -> DataFrame:
    """Vectors (id, label, v); the ragged form keeps the first 64 - label values."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    v = F.slice("embedding", 1, F.lit(64) - F.col("label")) if ragged else F.col("embedding")
    return emb.select(F.col("vec_id").alias("id"), "label", v.alias("v"))


def artifacts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint folders (owner, path) from `orders`."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return orders.select(
        F.col("o_custkey").alias("owner"),
        F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("path"),
    )


def instance_config_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance configuration rows derived from the instances of `pages`.

    instance_data_root ``instances/<name>``; class folder and class prompt on
    even-numbered instances only; no validation prompt on every third one.
    """
    names = instances_view(spark, sf_dir).select("instance_name").distinct()
    n = F.substring("instance_name", 5, 2).cast("int")
    has_class = n % 2 == 0
    return names.select(
        "instance_name",
        F.concat(F.lit("instances/"), F.col("instance_name")).alias("instance_data_root"),
        F.concat(F.lit("a photo of "), F.col("instance_name")).alias("instance_prompt"),
        F.when(has_class, F.concat(F.lit("class/"), F.col("instance_name"))).alias("class_data_root"),
        F.when(has_class, F.lit("a photo of a person")).alias("class_prompt"),
        F.when(n % 3 != 0, F.concat(F.lit("a picture of "), F.col("instance_name"))).alias("validation_prompt"),
    )
