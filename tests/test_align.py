import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cuesheet.operators.align import align_scenes


def brute_align(turns, scenes, tol=60.0):
    out = {}
    for ep, idx, spk, start in turns:
        cands = [s for s in scenes if s[0] == ep and s[2].lower() == spk.lower() and s[3] <= start + tol]
        if not cands:
            out[(ep, idx)] = -1
            continue
        best = min(cands, key=lambda s: (abs(s[3] - start), s[1]))
        out[(ep, idx)] = best[1]
    return out


def _run(spark, turns, scenes, block_rows=128):
    t = spark.createDataFrame(
        [(ep, "vid", idx, spk, "x", float(start), float(start) + 1) for ep, idx, spk, start in turns],
        "episode string, youtube_id string, idx int, speaker string, text string, start double, end double")
    s = spark.createDataFrame(
        [(ep, sid, spk, "c", 1, float(st_)) for ep, sid, spk, st_ in scenes],
        "episode string, scene_id int, speaker string, character string, in_game int, start_time double")
    got = align_scenes(t, s, keep_unaligned=True, block_rows=block_rows).collect()
    return {(r.episode_name, r.idx): r.scene_id for r in got}


def test_edges(spark):
    scenes = [("e", 0, "matt", 100.0), ("e", 1, "MATT", 200.0), ("e", 2, "matt", 200.0), ("e", 3, "laura", 50.0)]
    turns = [
        ("e", 0, "SAM", 10.0),       # no scene for speaker
        ("e", 1, "LAURA", 0.0),      # single candidate, ahead by 50
        ("e", 2, "MATT", 40.0),      # scene exactly at +60
        ("e", 3, "MATT", 39.9),      # just past the tolerance
        ("e", 4, "MATT", 150.0),     # equal distance before/after -> lowest id
        ("e", 5, "Matt", 260.0),     # duplicate start times -> lowest id
    ]
    got = _run(spark, turns, scenes)
    assert got == brute_align(turns, scenes)
    assert got[("e", 0)] == -1 and got[("e", 2)] == 0 and got[("e", 3)] == -1
    assert got[("e", 4)] == 0 and got[("e", 5)] == 1


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 10_000))
def test_property(spark, seed):
    rnd = random.Random(seed)
    spk = ["A", "b", "B"]
    scenes = [(rnd.choice("xy"), i, rnd.choice(spk), float(rnd.randint(0, 400))) for i in range(rnd.randint(0, 25))]
    turns = [(rnd.choice("xy"), i, rnd.choice(spk).upper(), rnd.randint(0, 800) / 2) for i in range(40)]
    assert _run(spark, turns, scenes, block_rows=rnd.choice([1, 2, 5, 128])) == brute_align(turns, scenes)
