"""Batch collection and extractor prompt text (native expressions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Template text is our own; only its shape (head, one block per turn, tail)
# follows the original tool.
PROMPT_HEAD = (
    "Write descriptive scenes for the dialogue below. Return JSON of the form "
    '{"scenes": [{"character", "speaker", "in_game", "background", "action", '
    '"object", "poses", "start_time", "end_time", "scene_description"}]}.\n\n'
    "Caption Dialogue\n----------------\n\n"
)
PROMPT_TAIL = "\nJson Output\n-----------\n"


def batch_collect(batched: DataFrame) -> DataFrame:
    """One row per (episode, batch) with its turns in caption order.

    A batch is bounded by the text budget, so the collected array is bounded.
    """
    agg = batched.groupBy("episode", "batch").agg(
        F.array_sort(
            F.collect_list(F.struct("idx", "speaker", "text", "start", "end"))
        ).alias("turns")
    )
    return agg.select(
        "episode", "batch",
        F.size("turns").cast("int").alias("n_turns"),
        F.aggregate("turns", F.lit(0), lambda acc, t: acc + F.length(t["text"])).cast("int").alias("n_chars"),
        F.col("turns")[0]["idx"].alias("first_idx"),
        F.element_at("turns", -1)["idx"].alias("last_idx"),
        F.col("turns")[0]["start"].alias("start"),
        F.element_at("turns", -1)["end"].alias("end"),
        "turns",
    )


def batch_prompt(collected: DataFrame) -> DataFrame:
    """Render the extractor prompt of every batch: head + a block per turn + tail."""
    block = lambda t: F.concat(
        F.lit("speaker: "), t["speaker"],
        F.lit("\ntext: "), t["text"],
        F.lit("\nstart_time: "), t["start"].cast("string"),
        F.lit("\nend_time: "), t["end"].cast("string"),
        F.lit("\n"),
    )
    return collected.select(
        "episode", "batch",
        F.concat(F.lit(PROMPT_HEAD), F.array_join(F.transform("turns", block), "\n"), F.lit(PROMPT_TAIL)).alias(
            "prompt"
        ),
    )
