"""Rule-based prompt enrichment of scenes (native expressions + a broadcast dimension)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet import constants as C
from cuesheet.functions.text import py_strip


def characters_dim(spark: SparkSession) -> DataFrame:
    """Fixed character dimension: name, token, extra prompt, extra negative, is_pc."""
    pcs = C.PLAYER_CHARACTERS
    names = list(dict.fromkeys([*C.CHARACTER_TOKENS, *C.ADDITIONAL_PROMPTS, *C.ADDITIONAL_NEGATIVE_PROMPTS, *pcs]))
    rows = [
        (
            n,
            C.CHARACTER_TOKENS.get(n),
            C.ADDITIONAL_PROMPTS.get(n),
            C.ADDITIONAL_NEGATIVE_PROMPTS.get(n),
            n in pcs,
        )
        for n in names
    ]
    return spark.createDataFrame(rows, "dim_name string, dim_token string, dim_prompt string, dim_neg string, dim_is_pc boolean")


def _in_pcs(c: Column) -> Column:
    return c.isin(*C.PLAYER_CHARACTERS)


def scene_prompts(scenes: DataFrame, episode_col: str = "episode_name", mention_fallback: bool = False) -> DataFrame:
    """Add correct_char, character_tokens, prompt, negative_prompt.

    ``scenes`` needs character, scene_description, action, poses, background
    and the episode name (episode number = digits after its last ``e``).
    ``mention_fallback`` replaces the literal chained membership test with
    "first player character mentioned in the description".
    """
    spark = scenes.sparkSession
    char0 = F.lower(py_strip(F.col("character")))
    desc = F.lower(py_strip(F.col("scene_description")))
    char = F.when(F.instr(char0, " as ") > 0, F.lower(py_strip(F.substring_index(char0, " as ", -1)))).otherwise(char0)
    d = scenes.withColumns({"__char": char, "__desc": desc})
    first = F.split(F.col("__char"), " ", -1)
    several_first_pc = (F.size(first) > 1) & _in_pcs(first[0])
    if mention_fallback:
        # first player character by position of its first mention
        hits = [
            F.when(F.instr(F.col("__desc"), p) > 0, F.struct(F.instr(F.col("__desc"), p).alias("at"), F.lit(p).alias("name")))
            for p in C.PLAYER_CHARACTERS
        ]
        mention = F.least(*hits)["name"]
        chained = F.col("__desc").contains(F.col("__char")) & mention.isNotNull()
        chained_value = mention
    else:
        chained = F.col("__desc").contains(F.col("__char")) & _in_pcs(F.col("__desc"))
        chained_value = F.col("__desc")
    correct = (
        F.when(several_first_pc, first[0])
        .when(chained, chained_value)
        .otherwise(F.col("__char"))
    )
    ep_num = F.substring_index(F.col(episode_col), "e", -1).try_cast("int")
    correct = (
        F.when((correct == "veth") & (ep_num < C.VETH_EPISODE), F.lit("nott"))
        .when((correct == "caduceus") & (ep_num < C.MOLLYMAUK_EPISODE), F.lit("mollymauk"))
        .otherwise(correct)
    )
    d = d.withColumn("__correct", correct)
    dim = F.broadcast(characters_dim(spark))  # fixed constant table: bounded by construction
    d = d.join(dim, F.col("__correct") == F.col("dim_name"), "left")
    token = F.coalesce(F.col("dim_token"), F.col("__correct"))
    extra = F.coalesce(F.col("dim_prompt"), F.lit(""))
    neg = F.coalesce(F.col("dim_neg"), F.lit(""))
    who = F.concat(F.lit(C.CHARACTER_DESC_PREFIX + " "), token)
    who = F.when(extra != "", F.concat(who, F.lit(", "), extra)).otherwise(who)
    pc_prompt = F.concat(
        who, F.lit(" "), F.col("action"), F.lit(", "), F.col("poses"), F.lit(". ("),
        F.col("background"), F.lit(" background)++++, fantasy world, " + C.PROMPT_AUGMENTATION),
    )
    other_prompt = F.concat(F.lit(C.NON_PC_PROMPT_PREFIX), F.col("__desc"), F.lit(", " + C.PROMPT_AUGMENTATION))
    prompt = F.when(_in_pcs(F.col("__correct")), pc_prompt).otherwise(other_prompt)
    negative = F.when(neg != "", F.concat(neg, F.lit(", " + C.DEFAULT_NEGATIVE_PROMPT))).otherwise(
        F.lit(C.DEFAULT_NEGATIVE_PROMPT)
    )
    is_dm = F.col("__char") == "matt"
    out = d.withColumns({
        "correct_char": F.when(is_dm, F.lit(C.DM_CHARACTER)).otherwise(F.col("__correct")),
        "character_tokens": F.when(is_dm, F.lit(C.DM_TOKEN)).otherwise(token),
        "prompt": F.when(is_dm, F.concat(F.lit(C.DM_PROMPT_PREFIX), F.col("__desc"))).otherwise(prompt),
        "negative_prompt": F.when(is_dm, F.lit(C.DEFAULT_NEGATIVE_PROMPT)).otherwise(negative),
    })
    return out.drop("__char", "__desc", "__correct", "dim_name", "dim_token", "dim_prompt", "dim_neg", "dim_is_pc")
