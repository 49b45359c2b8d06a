from __spark_entry__ import entry, queries

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loop_or_cartesian(spark):
    qs = queries()
    for name in ["align_scenes", "scene_lookup", "nearest_scene", "image_updates", "playback_changes"]:
        p = _plan(qs[name](spark, SF))
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_scan_pruning(spark):
    df = queries()["video_id_extract"](spark, SF)
    p = _plan(df)
    assert "ReadSchema: struct<page_id:bigint,url:string>" in p


def test_no_python_udf_in_native_paths(spark):
    qs = queries()
    for name in ["speaker_turns", "scene_prompts", "response_repair"]:
        p = _plan(qs[name](spark, SF))
        assert not any(n in p for n in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow")), name


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["episode_name", "youtube_id", "idx", "speaker", "text", "start", "end", "scene_id",
                          "character", "in_game"]
