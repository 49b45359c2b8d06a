from cuesheet.operators.artifacts import artifact_retention, latest_artifact
from cuesheet.operators.trainprep import class_pairing, global_index, topup_rows

CFG = ("instance_name string, instance_data_root string, instance_prompt string, class_data_root string, "
       "class_prompt string, validation_prompt string")


def test_retention(spark):
    rows = [("a", f"checkpoint-{n}") for n in (9, 10, 2)] + [("b", "checkpoint-5"), ("b", "checkpoint-6"), ("b", "other"),
                                                            ("c", "checkpoint-1"), ("c", "checkpoint-2")]
    df = spark.createDataFrame(rows, "owner string, path string")
    got = {(r.owner, r.path): r.action for r in artifact_retention(df, 3).collect()}
    # a has 3 >= 3: remove 1 (the lowest number, 2; numeric not lexicographic)
    assert got[("a", "checkpoint-2")] == "remove" and got[("a", "checkpoint-9")] == "keep"
    assert got[("a", "checkpoint-10")] == "keep"
    assert all(v == "keep" for (o, _), v in got.items() if o in ("b", "c"))
    assert ("b", "other") not in got
    lat = {r.owner: (r.path, r.global_step, r.first_epoch) for r in latest_artifact(df, 4).collect()}
    assert lat["a"] == ("checkpoint-10", 10, 2)


def test_topup(spark):
    cfg = spark.createDataFrame([
        ("i0", "r", "p", "c0", "cp", None), ("i1", "r", "p", "c1", "cp", None),
        ("i2", "r", "p", "c2", "cp", None), ("i3", "r", "p", "c3", "cp", None), ("i4", "r", "p", None, None, None),
    ], CFG)
    counts = spark.createDataFrame([("i1", 3), ("i2", 5), ("i3", 9)], "instance_name string, existing long")
    got = topup_rows(cfg, counts, 5).collect()
    by = {}
    for r in got:
        by.setdefault(r.instance_name, []).append((r["index"], r.file_number))
    assert sorted(by["i0"]) == [(i, i) for i in range(5)]
    assert sorted(by["i1"]) == [(0, 3), (1, 4)]
    assert "i2" not in by and "i3" not in by and "i4" not in by


def test_class_pairing(spark):
    inst = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 10 + i) for i in range(2)] + [("z", 99)],
                                 "instance string, id long")
    cls = spark.createDataFrame([("a", 100 + i) for i in range(3)] + [("b", 200 + i) for i in range(6)],
                                "instance string, id long")
    got = {r.id: (r.n_class, r.class_id) for r in class_pairing(inst, cls, 4).collect()}
    assert [got[i][1] for i in range(5)] == [100, 101, 102, 100, 101]
    assert got[10] == (4, 200) and got[11] == (4, 201)
    assert got[99] == (0, None)


def test_global_index(spark):
    im = spark.createDataFrame([("b", 2), ("a", 5), ("a", 1)], "instance string, id long")
    rows = sorted((r.global_idx, r.instance, r.id, r.rep, r.local_idx) for r in global_index(im, 2).collect())
    assert rows == [(0, "a", 1, 0, 0), (1, "a", 1, 1, 1), (2, "a", 5, 0, 2), (3, "a", 5, 1, 3),
                    (4, "b", 2, 0, 0), (5, "b", 2, 1, 1)]


def test_class_pairing_max_length(spark):
    inst = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("b", 6), ("b", 7)], "instance string, id long")
    cls = spark.createDataFrame([("a", 100 + i) for i in range(5)] + [("b", 200)], "instance string, id long")
    got = sorted((r.instance, r.k, r.id, r.class_id) for r in class_pairing(inst, cls, 4, length="max").collect())
    # a: max(2, min(5, 4)) = 4 examples, instance k % 2, class k % 4; b: 3 examples, class k % 1
    assert got == [("a", 0, 1, 100), ("a", 1, 2, 101), ("a", 2, 1, 102), ("a", 3, 2, 103),
                   ("b", 0, 5, 200), ("b", 1, 6, 200), ("b", 2, 7, 200)]


def test_zip_by_position_of_unequal_lists(spark):
    from cuesheet.operators.indexing import zip_by_position

    a = spark.createDataFrame([("p", 3), ("q", 1), ("r", 2)], "prompt string, o int").repartition(3)
    b = spark.createDataFrame([("x", "b"), ("y", "a"), (None, "c"), ("w", "d")], "dir string, k string").repartition(2)
    short = zip_by_position(a, ["o"], b, ["k"]).orderBy("position").collect()
    assert [(r.position, r.prompt, r.dir) for r in short] == [(0, "q", "y"), (1, "r", "x"), (2, "p", None)]
    whole = zip_by_position(a, ["o"], b, ["k"], longest=True).orderBy("position").collect()
    assert [(r.prompt, r.dir) for r in whole] == [("q", "y"), ("r", "x"), ("p", None), (None, "w")]
    assert zip_by_position(a.limit(0), ["o"], b, ["k"]).count() == 0


def test_draws_are_even_and_hang_on_seed_and_id_alone(spark):
    from cuesheet.operators.trainprep import crop_geometry

    images = spark.range(20_000).selectExpr("id", "300 AS height", "260 + int(id % 3) * 100 AS width")
    got = crop_geometry(images.repartition(7), 256, random_flip=True, seed=1).toPandas().set_index("id").sort_index()
    again = crop_geometry(images.coalesce(1), 256, random_flip=True, seed=1).toPandas().set_index("id").sort_index()
    assert (got == again).all().all()
    assert abs(got["flip"].mean() - 0.5) < 0.02
    for side in "yx":
        room = (got["new_h" if side == "y" else "new_w"] - 256)
        assert ((got[f"crop_{side}"] >= 0) & (got[f"crop_{side}"] <= room)).all()
        assert (got.loc[room == 0, f"crop_{side}"] == 0).all()
        wide = room > 20
        assert abs((got.loc[wide, f"crop_{side}"] / room[wide]).mean() - 0.5) < 0.02
    other = crop_geometry(images, 256, random_flip=True, seed=2).toPandas().set_index("id").sort_index()
    assert 0.4 < (other["flip"] != got["flip"]).mean() < 0.6
    center = crop_geometry(images, 256, center_crop=True).collect()
    assert all(not r.flip and (r.crop_y, r.crop_x) == (round((r.new_h - 256) / 2), round((r.new_w - 256) / 2)) for r in center)


def test_batches_hold_sizes_crops_and_class_images(spark):
    from cuesheet.operators.trainprep import class_of, train_batches

    ex = spark.createDataFrame(
        [("a" if i < 5 else "b", i % 5, i, f"p{i}", f"c{i}", (10 + i, 20), (i, 0)) for i in range(9)],
        "instance string, local_idx long, global_idx long, prompt string, class_prompt string, original_size struct<h:int,w:int>, crop_top_left struct<y:int,x:int>",
    )
    classes = spark.createDataFrame([("a", 7), ("a", 5), ("a", 9)], "instance string, id long")
    paired = class_of(ex, classes, 2)
    assert {r.global_idx: r.class_id for r in paired.collect()} == {0: 5, 1: 7, 2: 5, 3: 7, 4: 5, 5: None, 6: None, 7: None, 8: None}
    batches = train_batches(paired, batch_size=4, seed=3).orderBy("batch_id").collect()
    assert [b.n_examples for b in batches] == [4, 4, 1]
    want = {r.global_idx: r for r in paired.collect()}
    for b in batches:
        own = [int(p[1:]) for p in b.prompts[: b.n_examples]]
        assert [s.h for s in b.original_sizes] == [10 + i for i in own] and [c.y for c in b.crop_top_lefts] == own
        assert b.class_ids == [want[i].class_id for i in own if i < 5]
        assert b.prompts[b.n_examples :] == [f"c{i}" for i in own if i < 5]
    assert sorted(int(p[1:]) for b in batches for p in b.prompts[: b.n_examples]) == list(range(9))
    plain = train_batches(paired, batch_size=4, seed=3, prior=False).collect()
    assert all(len(b.prompts) == b.n_examples and b.class_ids == [] for b in plain)


def test_nested_urls(spark):
    from cuesheet.operators.manifest import unnest_urls

    rows = [("a", ["u0", "u1"]), ("b", []), ("c", None), ("d", [None, "v"])]
    got = unnest_urls(spark.createDataFrame(rows, "instance_name string, instance_urls array<string>")).collect()
    assert sorted(map(tuple, got)) == [("a", "u0", 0), ("a", "u1", 1), ("d", "v", 1)]
    rows = [("a", 1, ["u2"]), ("a", 0, ["u0", "u1"]), ("b", 0, ["w"])]
    got = unnest_urls(spark.createDataFrame(rows, "instance_name string, part int, instance_urls array<string>")).collect()
    assert sorted(map(tuple, got)) == [("a", "u0", 0), ("a", "u1", 1), ("a", "u2", 2), ("b", "w", 0)]


def test_episodes_in_order_of_first_appearance(spark):
    from cuesheet.operators.scenes import distinct_in_order, episode_list

    rows = [("c2e003", None, 0), ("c2e001", "v1", 1), ("c2e003", "v3", 2), ("c2e002", "v2", 3), ("c2e001", "late", 4)]
    df = spark.createDataFrame(rows, "episode_name string, youtube_id string, place int").repartition(4)
    got = episode_list(df, "place").orderBy("position").collect()
    assert [(r.episode_name, r.youtube_id) for r in got] == [("c2e003", "v3"), ("c2e001", "v1"), ("c2e002", "v2")]
    odd = spark.createDataFrame([(None, 5), ("b", 4), (None, 1)], "v string, o int")
    assert [(r.v, r.position) for r in distinct_in_order(odd, "v", "o").orderBy("position").collect()] == [(None, 0), ("b", 1)]
