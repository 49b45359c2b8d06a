from pyspark.sql import functions as F

from cuesheet.operators.turns import speaker_turns


def _caps(spark, episodes):
    rows = []
    for ep, texts in episodes.items():
        t = 0.0
        for i, text in enumerate(texts):
            rows.append((ep, "vid", i, text, t, 1.0))
            t += 1.0
    return spark.createDataFrame(rows, "episode string, youtube_id string, idx int, text string, start double, duration double")


def test_edge_rows(spark):
    # caption -> speaker and text of its turn
    episodes = {
        "e1": [
            ("no colon here", "MATT", "no colon here"), ("LAURA: hi", "LAURA", " hi"),
            ("A AND B: hi", "LAURA", "A AND B: hi"),  # a tag of several words is continuation
            ("SAM:", "SAM", ""), ("MATT: a: b", "MATT", " a: b"), ("plain text", "MATT", "plain text"),
        ],
        "e2": [("foo: bar", "foo", " bar"), ("continued", "foo", "continued")],  # any first caption may name a speaker
    }
    got = speaker_turns(_caps(spark, {e: [c for c, _, _ in rows] for e, rows in episodes.items()})).orderBy("episode", "idx").collect()
    for ep, rows in episodes.items():
        want = [(speaker, text, float(i), i + 1.0) for i, (_, speaker, text) in enumerate(rows)]
        assert [(r.speaker, r.text, r.start, r.end) for r in got if r.episode == ep] == want


def test_forward_fill_crosses_blocks(spark):
    from cuesheet.operators.ordered import forward_fill

    rows = [("k", i, "s" if i in (0, 7) else None) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    out = forward_fill(df, ["k"], "o", "v", "f", block_rows=3).orderBy("o").collect()
    assert [r.f for r in out] == ["s"] * 20
