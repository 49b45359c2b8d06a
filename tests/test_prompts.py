from cuesheet import constants as C
from cuesheet.operators.prompts import scene_prompts

DDL = ("episode_name string, scene_id int, character string, scene_description string, action string, "
       "poses string, background string")


def _run(spark, rows, **kw):
    df = spark.createDataFrame(rows, DDL)
    return {r.scene_id: r for r in scene_prompts(df, **kw).collect()}


def test_rules(spark):
    rows = [
        ("c2e010", 0, "Matt", "A dark hall", "runs", "crouching", "forest"),
        ("c2e096", 1, "Sam as Veth", "x", "a", "p", "b"),
        ("c2e097", 2, "Sam as Veth", "x", "a", "p", "b"),
        ("c2e025", 3, "caduceus", "x", "a", "p", "b"),
        ("c2e026", 4, "caduceus", "x", "a", "p", "b"),
        ("c2e030", 5, "fjord and jester", "x", "a", "p", "b"),
        ("c2e030", 6, "beauregard", "The Monk", "a", "p", "b"),
        ("c2e030", 7, "essek", "A Drow", "a", "p", "b"),
        ("c2e030", 8, "jest", "jester", "a", "p", "b"),
        ("c2e030", 9, "  BEAU  ", "  Desc  ", "a", "p", "b"),
    ]
    r = _run(spark, rows)
    assert r[0].correct_char == C.DM_CHARACTER and r[0].prompt == C.DM_PROMPT_PREFIX + "a dark hall"
    assert r[1].correct_char == "nott" and r[2].correct_char == "veth"
    assert r[3].correct_char == "mollymauk" and r[4].correct_char == "caduceus"
    assert r[5].correct_char == "fjord"
    assert r[6].correct_char == "beauregard" and r[6].prompt.startswith(C.NON_PC_PROMPT_PREFIX + "the monk")
    assert r[7].character_tokens == "[critrole-essek]" and r[7].prompt.startswith(C.NON_PC_PROMPT_PREFIX)
    assert r[8].correct_char == "jester"
    assert r[9].correct_char == "beau"
    assert r[9].prompt == ("a picture of [critrole-beau], " + C.ADDITIONAL_PROMPTS["beau"] + " a, p. (b background)++++,"
                           " fantasy world, " + C.PROMPT_AUGMENTATION)
    assert r[9].negative_prompt == C.ADDITIONAL_NEGATIVE_PROMPTS["beau"] + ", " + C.DEFAULT_NEGATIVE_PROMPT
    assert r[5].negative_prompt == C.DEFAULT_NEGATIVE_PROMPT


def test_mention_fallback(spark):
    rows = [("c2e030", 0, "yasha", "yasha meets caleb", "a", "p", "b"),
            ("c2e030", 1, "cal", "then caleb and yasha", "a", "p", "b")]
    r = _run(spark, rows, mention_fallback=True)
    assert r[0].correct_char == "yasha" and r[1].correct_char == "caleb"
