import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cuesheet.operators.indexing import global_ordinal
from cuesheet.operators.repair import resolve_responses, scene_rows
from cuesheet.operators.artifacts import artifact_retention, latest_artifact
from cuesheet.operators.extract import ResponseLedger
from cuesheet.operators.scenes import episode_list
from cuesheet.sinks.files import export_aligned, replace_partitions, write_caption_files, write_scene_files, write_table
from cuesheet.sources.files import VIEWER_SCHEMA, read_viewer_csv
from cuesheet.sources.files import read_caption_files, read_image_folder, read_instance_config, read_scene_files


def test_instance_config_yaml(spark):
    d = tempfile.mkdtemp(prefix="cuesheet-yaml-")
    p = os.path.join(d, "inst.yaml")
    with open(p, "w") as f:
        f.write("- instance_name: fjord\n  instance_data_root: data/fjord\n  instance_prompt: a photo\n"
                "  instance_urls: [http://x/a.png, http://x/b.png]\n  class_prompt: a person\n")
    rows = read_instance_config(spark, p).collect()
    assert rows[0].instance_urls == ["http://x/a.png", "http://x/b.png"] and rows[0].validation_prompt is None
    with open(p, "a") as f:
        f.write("- instance_name: beau\n  instance_data_root: r\n  instance_prompt: p\n  instance_urls: []\n  bogus: 1\n")
    with pytest.raises(TypeError):
        read_instance_config(spark, p)


def test_image_folder_and_caption_files(spark):
    d = tempfile.mkdtemp(prefix="cuesheet-files-")
    for inst, n in (("fjord", 3), ("beau", 1)):
        os.makedirs(os.path.join(d, "img", inst))
        for i in range(n):
            with open(os.path.join(d, "img", inst, f"{i}.jpg"), "wb") as f:
                f.write(b"\x00\x01" * (i + 1))
    counts = {r.folder: r.n for r in read_image_folder(spark, os.path.join(d, "img")).groupBy("folder")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"fjord": 3, "beau": 1}
    os.makedirs(os.path.join(d, "cap"))
    caps = [{"text": "MATT: hi", "start": 0.5, "duration": 1.0}, {"text": "more", "start": 1.5, "duration": 2.0}]
    with open(os.path.join(d, "cap", "c2e001_ab_cd.json"), "w") as f:
        json.dump(caps, f, indent=2)
    rows = read_caption_files(spark, os.path.join(d, "cap")).orderBy("idx").collect()
    assert [(r.episode, r.youtube_id, r.idx, r.text) for r in rows] == [("c2e001", "ab_cd", 0, "MATT: hi"),
                                                                         ("c2e001", "ab_cd", 1, "more")]
    os.makedirs(os.path.join(d, "sc"))
    with open(os.path.join(d, "sc", "c2e001_ab_cd_scenes.json"), "w") as f:
        json.dump({"name": "c2e001_ab_cd", "scenes": [
            {"character": "x", "speaker": "s", "in_game": 1, "background": "b", "action": "a", "object": "o",
             "poses": "p", "start_time": 1.0, "end_time": 2.0, "scene_description": "d", "turns": []}] * 2}, f)
    sc = read_scene_files(spark, os.path.join(d, "sc")).collect()
    assert sorted(r.scene_id for r in sc) == [0, 1] and sc[0].youtube_id == "ab_cd" and "turns" not in sc[0]


def test_partition_and_full_overwrite(spark):
    d = tempfile.mkdtemp(prefix="cuesheet-tbl-")
    p = os.path.join(d, "t")
    rows = lambda: sorted((r.inst, r.v) for r in spark.read.parquet(p).collect())
    write_table(spark.createDataFrame([("a", 1), ("b", 2)], "inst string, v int"), p, ["inst"])
    replace_partitions(spark.createDataFrame([("a", 9)], "inst string, v int"), p, ["inst"])
    assert rows() == [("a", 9), ("b", 2)]
    write_table(spark.createDataFrame([("a", 3)], "inst string, v int"), p, ["inst"])
    assert rows() == [("a", 3)]
    spark.createDataFrame([("c", 4)], "inst string, v int").write.mode("overwrite").partitionBy("inst").parquet(p)
    assert rows() == [("c", 4)]  # no session setting is left behind


def test_viewer_csv_keeps_awkward_texts(spark):
    p = os.path.join(tempfile.mkdtemp(prefix="cuesheet-csv-"), "x")
    texts = ["two\nlines", 'a "quoted" word', "", None, "back\\slash, comma", " padded "]
    one = {"speaker": "s", "character": "c", "in_game": 1, "episode_name": "c2e001", "youtube_id": "v"}
    rows = [one | {"text": t, "start": float(i), "end": i + 1.0, "idx": i, "scene_id": i} for i, t in enumerate(texts)]
    rows, spec = [tuple(r[n] for n in VIEWER_SCHEMA.names) for r in rows], VIEWER_SCHEMA
    export_aligned(spark.createDataFrame(rows, spec), p)
    got = read_viewer_csv(spark, f"{p}/all").orderBy("scene_id").collect()
    assert [r.text for r in got] == texts
    assert os.listdir(f"{p}/by_episode") == ["c2e001.csv"]
    each = read_viewer_csv(spark, f"{p}/by_episode/c2e001.csv").orderBy("scene_id").collect()
    assert each == got


def test_episode_files_have_their_names(spark, tmp_path):
    captions = spark.createDataFrame([("c2e001", "x_y", i, t, float(i), 1.0) for i, t in enumerate(["a", "é", ""])], "episode string, youtube_id string, idx int, text string, start double, duration double")
    write_caption_files(captions.repartition(3), f"{tmp_path}/c")
    assert os.listdir(f"{tmp_path}/c") == ["c2e001_x_y.json"]
    got = read_caption_files(spark, f"{tmp_path}/c").orderBy("idx").collect()
    assert [(r.episode, r.youtube_id, r.idx, r.text) for r in got] == [("c2e001", "x_y", 0, "a"), ("c2e001", "x_y", 1, "é"), ("c2e001", "x_y", 2, "")]
    scene = dict(character="c", speaker="s", in_game=1, background="b", action="a", object="o", poses="p", start_time=0.0, end_time=1.0, scene_description="d")
    scenes = spark.createDataFrame([dict(scene, episode=e, youtube_id="v", scene_id=i, action=f"{i}") for e in ("c2e001", "c2e002") for i in range(3)])
    write_scene_files(scenes, f"{tmp_path}/s")
    assert sorted(os.listdir(f"{tmp_path}/s")) == ["c2e001_v_scenes.json", "c2e002_v_scenes.json"]
    assert sorted((r.episode_name, r.scene_id, r.action) for r in read_scene_files(spark, f"{tmp_path}/s").collect()) == [
        (e, i, str(i)) for e in ("c2e001", "c2e002") for i in range(3)
    ]


def test_odd_names_do_not_stop_a_job(spark):
    rows = [("o", "checkpoint-9"), ("o", "checkpoint-10"), ("o", "checkpoint"), ("o", "checkpoint-x"), ("p", "checkpoint"), ("o", "logs")]
    df = spark.createDataFrame(rows, "owner string, path string")
    got = sorted((r.path, r.action) for r in artifact_retention(df, 2).collect())
    assert got == [("checkpoint-10", "keep"), ("checkpoint-9", "remove")]
    assert [(r.owner, r.path, r.global_step) for r in latest_artifact(df, 5).collect()] == [("o", "checkpoint-10", 10)]
    viewer = spark.createDataFrame([("c2e001", "a", 0), ("bonus", "b", 1)], "episode_name string, youtube_id string, idx int")
    assert {r.episode_name: r.label for r in episode_list(viewer).collect()} == {"c2e001": "Campaign 2 Episode 001", "bonus": None}


def test_external_repair_rounds(spark, tmp_path):
    ledger = ResponseLedger(spark, f"{tmp_path}/ledger")
    good = json.dumps({"scenes": [{"character": "x", "speaker": "s", "in_game": 1, "background": "b", "action": "a",
                                   "object": "o", "poses": "p", "start_time": 1.0, "end_time": 2.0,
                                   "scene_description": "d"}]})
    df = spark.createDataFrame([("e", 0, "broken {"), ("e", 1, good), ("e", 2, "never")],
                               "episode string, batch int, text string")

    def fixer(s):  # stands in for a model call: fixes one text on the second try
        return s.map(lambda t: good if t == "broken {{" else (t + "{" if t.startswith("broken") else t + "!"))

    res = {r.batch: (r.status, r.attempt) for r in resolve_responses(df, repair=fixer, external=True, max_retries=4, ledger=ledger).collect()}
    assert res[0] == ("ok", 2) and res[1] == ("ok", 0) and res[2] == ("dead", 3)
    assert scene_rows(resolve_responses(df, repair=fixer, external=True, ledger=ledger)).count() == 2


def test_global_ordinal_over_join(spark):
    a = spark.range(0, 5000).select((F.col("id") % 97).alias("k"), F.col("id"))
    b = spark.range(0, 97).select(F.col("id").alias("k"), (F.col("id") * 3).alias("w"))
    j = a.join(b, "k")
    g = global_ordinal(j, ["k", "id"], num_partitions=7)
    first = g.groupBy("k").agg(F.min("ordinal").alias("o0"))
    r = g.join(first, "k").select((F.col("ordinal") - F.col("o0")).alias("local"))
    assert r.agg(F.min("local")).first()[0] == 0
    assert sorted(x.ordinal for x in g.select("ordinal").collect()) == list(range(5000))
