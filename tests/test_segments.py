import random

import pytest
from pyspark.sql import functions as F

from cuesheet.operators.align import align_scenes
from cuesheet.operators.segments import _dyadic, build_segments, locate, nearest, with_bounds

DDL = "k string, idx int, s double, e double, m double, x string"


def segments_of(spark, rows, **more):
    df = spark.createDataFrame(rows, DDL)
    return build_segments(df, ["k"], "m", "idx", ["x"], {"all": F.lit(True), "x": F.col("x") == "x"}, ("s", "e"), **more)


def test_dyadic_nodes_make_up_the_range(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a, 40)] + [(3, 700), (0, 767), (5, 4)]
    df = spark.createDataFrame(pairs, "a int, b int").selectExpr("a", "b", f"{_dyadic('a', 'b')} AS nodes")
    for r in df.collect():
        blocks = [x for n in r.nodes for x in range(n.node << n.level, (n.node + 1) << n.level)]
        assert sorted(blocks) == list(range(r.a, r.b + 1)) and len(r.nodes) <= 20


@pytest.mark.parametrize("block_rows", [1, 4, 128])
def test_segments_are_disjoint_and_hold_the_winner(spark, block_rows):
    rnd = random.Random(block_rows)
    rows = []
    for i in range(150):
        s = float(rnd.choice([0, rnd.randint(0, 60), rnd.randint(0, 400)]))
        e = s + rnd.choice([0, 1, 5, 300, -2])
        rows.append((rnd.choice("ab"), i, s, e, (s + e) / 2, rnd.choice("xy")))
    rows += [("c", 900, None, None, None, "x"), ("c", 901, 5.0, 6.0, 5.5, None), (None, 902, 1.0, 2.0, 1.5, "x")]
    rnd.shuffle(rows)
    seg = segments_of(spark, rows, block_rows=block_rows)
    times = sorted({t for r in rows for t in (r[2], r[3], r[4]) if t is not None} | {-9.0, 999.0, 33.3})
    probes = spark.createDataFrame([(k, t) for k in "abcd" for t in times], "key string, t double")
    found = locate(with_bounds(probes, seg, {"k": "key"}), seg, {"k": "key"}, "t")
    found = found.withColumns({f"n_{k}": nearest(k, F.col("t")) for k in ("all", "x")}).collect()
    assert len(found) == 4 * len(times)  # one segment each
    for r in found:
        mine = [x for x in rows if x[0] == r.key]
        hits = [x for x in mine if x[2] is not None and x[2] <= r.t <= x[3]]
        assert (r.hit and r.hit.idx) == (min(h[1] for h in hits) if hits else None)
        assert r.overlap_count == (len(hits) if mine else None)
        for kind, own in (("n_all", mine), ("n_x", [x for x in mine if x[5] == "x"])):
            best = min(((abs(x[4] - r.t), x[1]) for x in own if x[4] is not None), default=None)
            got = r[kind]
            assert (got and (got.dist, got.a.idx)) == best


def test_nested_intervals_make_linear_segments(spark):
    """n intervals inside each other: at most 3 n + 1 segments and one a block, no block with much more than its share."""
    n = 2000
    rows = [("a", i, float(i), float(4 * n - i), 2.0 * n, "x") for i in range(n)]
    seg = segments_of(spark, rows)
    index = seg.index
    per = [r["count"] for r in index.groupBy("block").count().collect()]
    assert sum(per) <= 3 * n + 1 + len(per) and len(per) > n // 128 and max(per) < 4 * 128
    probes = spark.createDataFrame([("a", 4000.0), ("a", 1000.5), ("a", 7000.0)], "k string, t double")
    found = locate(with_bounds(probes, seg, {"k": "k"}), seg, {"k": "k"}, "t").collect()
    assert {r.t: (r.overlap_count, r.hit.idx) for r in found} == {4000.0: (n, 0), 1000.5: (1001, 0), 7000.0: (1001, 0)}


def test_clustered_times_are_spread_over_blocks(spark):
    """Close scenes and one far away: an average gap would put all of them in one bucket."""
    n = 4000
    scenes = [("e", i, "a", "c", 1, i / 1000) for i in range(n)] + [("e", n, "a", "c", 1, 1e9)]
    df = spark.createDataFrame(scenes, "episode string, scene_id int, speaker string, character string, in_game int, start_time double")
    seg = build_segments(df, ["episode"], "start_time", "scene_id", [])
    assert max(r["count"] for r in seg.index.groupBy("block").count().collect()) < 3 * 128
    turns = [("e", "v", i, "A", "t", i / 1000 + 0.0004, 0.0) for i in range(n)] + [("e", "v", n, "A", "t", 9e8, 0.0)]
    t = spark.createDataFrame(turns, "episode string, youtube_id string, idx int, speaker string, text string, start double, end double")
    got = {r.idx: r.scene_id for r in align_scenes(t, df).collect()}
    assert got == {i: i for i in range(n)} | {n: n - 1}  # the far scene is beyond the tolerance


def test_no_rows(spark):
    seg = segments_of(spark, [])
    probes = spark.createDataFrame([("a", 1.0)], "k string, t double")
    r = locate(with_bounds(probes, seg, {"k": "k"}), seg, {"k": "k"}, "t").first()
    assert r.hit is None and r.overlap_count is None and r.prev_all is None
