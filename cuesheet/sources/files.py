"""File sources: caption JSON, scene-episode JSON, viewer CSV, instance YAML, image folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# written and read alike: quotes doubled, line breaks inside quotes, null apart from empty
CSV_OPTIONS = {
    "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "multiLine": True, "quote": '"', "escape": '"', "nullValue": "\\N",
}
CAPTION_ARRAY = "array<struct<text:string,start:double,duration:double>>"
TURN_TYPE = "struct<speaker:string,text:string,start:double,end:double>"
SCENE_TYPE = (
    "struct<character:string,speaker:string,in_game:int,background:string,action:string,object:string,"
    f"poses:string,start_time:double,end_time:double,scene_description:string,turns:array<{TURN_TYPE}>>"
)
EPISODE_SCHEMA = f"name string, scenes array<{SCENE_TYPE}>"
VIEWER_SCHEMA = T.StructType([
    T.StructField("episode_name", T.StringType()),
    T.StructField("youtube_id", T.StringType()),
    T.StructField("idx", T.IntegerType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("end", T.DoubleType()),
    T.StructField("scene_id", T.IntegerType()),
    T.StructField("character", T.StringType()),
    T.StructField("in_game", T.IntegerType()),
])


def stem_of(path: Column) -> Column:
    """File stem (name without directory and last extension)."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def split_stem(stem: Column) -> tuple[Column, Column]:
    """``c2e001_<id>`` -> (episode, youtube id); split on the first ``_`` only."""
    parts = F.split(stem, "_", 2)
    return parts[0], F.try_element_at(parts, F.lit(2))


def read_caption_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """One JSON array of captions per file, file order kept as ``idx``.

    Output: stem, episode, youtube_id, idx, text, start, duration.  Each file is
    read whole (one episode transcript per file, as written by the downloader);
    its rows are spread by ``posexplode`` right away.
    """
    raw = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(F.col("value"), F.col("_metadata.file_path").alias("file_path"))
    )
    stem = stem_of(F.col("file_path"))
    ep, yt = split_stem(stem)
    caps = raw.select(
        stem.alias("stem"), ep.alias("episode"), yt.alias("youtube_id"),
        F.posexplode(F.from_json("value", CAPTION_ARRAY)).alias("idx", "c"),
    )
    return caps.select(
        "stem", "episode", "youtube_id", F.col("idx").cast("int").alias("idx"),
        "c.text", "c.start", "c.duration",
    )


def read_scene_files(spark: SparkSession, path: str, glob: str = "*_scenes.json") -> DataFrame:
    """Scene-episode files ``{name, scenes: [...]}`` -> one row per scene.

    ``scene_id`` is the 0-based position in the file's list; ``name`` splits
    into episode_name / youtube_id on its first ``_``.  ``turns`` is dropped.
    """
    raw = (
        spark.read.schema(EPISODE_SCHEMA)
        .option("multiLine", True)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    ep, yt = split_stem(F.col("name"))
    ex = raw.select(ep.alias("episode_name"), yt.alias("youtube_id"), F.posexplode("scenes").alias("scene_id", "scene"))
    return ex.select("episode_name", "youtube_id", F.col("scene_id").cast("int"), "scene.*").drop("turns")


def read_viewer_csv(spark: SparkSession, path: str) -> DataFrame:
    """Aligned-caption CSV with header -> viewer table.

    Renames start/end to start_time/end_time and adds ``scene_name``
    (``scene_`` + zero-padded id, never truncated) and ``mid_point``.
    """
    df = (
        spark.read.schema(VIEWER_SCHEMA)
        .options(**CSV_OPTIONS)
        .csv(path)
    )
    return df.withColumnsRenamed({"start": "start_time", "end": "end_time"}).withColumns({
        "scene_name": F.format_string("scene_%03d", F.col("scene_id")),
        "mid_point": F.col("start_time") + (F.col("end_time") - F.col("start_time")) / 2,
    })


INSTANCE_SCHEMA = T.StructType([
    T.StructField("instance_name", T.StringType(), False),
    T.StructField("instance_data_root", T.StringType(), False),
    T.StructField("instance_prompt", T.StringType(), False),
    T.StructField("instance_urls", T.ArrayType(T.StringType()), False),
    T.StructField("class_data_root", T.StringType(), True),
    T.StructField("class_prompt", T.StringType(), True),
    T.StructField("validation_prompt", T.StringType(), True),
])


def read_instance_config(spark: SparkSession, yaml_path: str) -> DataFrame:
    """Instance configuration (a small YAML list) -> DataFrame.

    The file is a handful of rows, parsed on the driver; unknown keys raise like
    the original dataclass constructor would.
    """
    import yaml

    with open(yaml_path) as f:
        items = yaml.safe_load(f) or []
    names = [f.name for f in INSTANCE_SCHEMA.fields]
    rows = []
    for it in items:
        extra = set(it) - set(names)
        if extra:
            raise TypeError(f"unexpected instance config keys: {sorted(extra)}")
        rows.append(tuple(it.get(n) for n in names))
    return spark.createDataFrame(rows, INSTANCE_SCHEMA)


def read_image_folder(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Files under ``path`` (one sub-folder per instance) as rows.

    Output: folder (parent directory name), path, length (+ content).
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    folder = F.element_at(F.split(F.col("path"), "/"), -2)
    cols = [folder.alias("folder"), "path", "length"] + (["content"] if with_content else [])
    return df.select(*cols)
