"""Named queries: Spark plan + equivalent DuckDB SQL over the same tables.

``QUERIES[name] = (build(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Every query reads the driver tables (or views Spark derives from them) in
full.  Oracle SQL is written independently of the Spark plan: it uses
brute-force joins and recursive CTEs where the Spark side uses bucketed
joins and streaming scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuesheet.plans.oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = (fn, sql)
        return fn

    return deco


# --------------------------------------------------------------------------
# shared oracle fragments
# --------------------------------------------------------------------------
SPLIT_COND = "(idx = 0 OR regexp_matches(text, '^[A-Z]+:'))"
TURNS_CTE = ("turns_o", f"""
    SELECT episode, youtube_id, idx, start,
           last_value(spk IGNORE NULLS) OVER (PARTITION BY episode ORDER BY idx
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS speaker,
           txt AS text, start + duration AS "end"
    FROM (SELECT *,
                 CASE WHEN {SPLIT_COND} AND strpos(text, ':') > 0 THEN split_part(text, ':', 1)
                      WHEN {SPLIT_COND} THEN 'MATT' END AS spk,
                 CASE WHEN {SPLIT_COND} AND strpos(text, ':') > 0 THEN substr(text, strpos(text, ':') + 1)
                      ELSE text END AS txt
          FROM captions_v)
""")
ALIGNED_CTE = ("aligned_o", """
    SELECT episode AS episode_name, youtube_id, idx, speaker, text, start, "end", scene_id, character, in_game
    FROM (
        SELECT t.*, s.scene_id, s.character, s.in_game,
               row_number() OVER (PARTITION BY t.episode, t.idx
                                  ORDER BY abs(s.start_time - t.start), s.scene_id) AS rn
        FROM turns_o t
        JOIN scenes_v s ON s.episode = t.episode AND lower(s.speaker) = lower(t.speaker)
                       AND s.start_time <= t.start + 60.0
    ) WHERE rn = 1
""")


def _v(sql: str, *views: str, extra=None, recursive: bool = False) -> str:
    return with_views(sql, *views, extra=extra, recursive=recursive)


# --------------------------------------------------------------------------
# transcript -> turns -> alignment
# --------------------------------------------------------------------------
@register("speaker_turns", _v("SELECT * FROM turns_o", "captions_v", extra=[TURNS_CTE]))
def q_speaker_turns(spark, sf_dir):
    from cuesheet.operators.turns import speaker_turns
    from cuesheet.sources.fixtures import captions_view

    return speaker_turns(captions_view(spark, sf_dir))


@register("align_scenes", _v("SELECT * FROM aligned_o", "captions_v", "scenes_v", extra=[TURNS_CTE, ALIGNED_CTE]))
def q_align_scenes(spark, sf_dir):
    from cuesheet.operators.align import align_scenes
    from cuesheet.operators.turns import speaker_turns
    from cuesheet.sources.fixtures import captions_view, scenes_view

    return align_scenes(speaker_turns(captions_view(spark, sf_dir)), scenes_view(spark, sf_dir))


# --------------------------------------------------------------------------
# batching and prompts
# --------------------------------------------------------------------------
def _tb_cte(limit: int) -> list[tuple[str, str]]:
    rec = (f"tb_rec_{limit}", f"""
        SELECT episode, idx, CAST(length(text) AS BIGINT) AS cur, 0 AS b FROM turns_o WHERE idx = 0
        UNION ALL
        SELECT t.episode, t.idx,
               CASE WHEN r.cur + length(t.text) > {limit} THEN length(t.text) ELSE r.cur + length(t.text) END,
               CASE WHEN r.cur + length(t.text) > {limit} THEN r.b + 1 ELSE r.b END
        FROM tb_rec_{limit} r JOIN turns_o t ON t.episode = r.episode AND t.idx = r.idx + 1
    """)
    out = (f"tb_{limit}", f"""
        SELECT t.*, CAST(r.b AS INTEGER) AS batch
        FROM turns_o t JOIN tb_rec_{limit} r ON t.episode = r.episode AND t.idx = r.idx
        WHERE r.b < (SELECT max(b) FROM tb_rec_{limit} r2 WHERE r2.episode = r.episode)
    """)
    return [TURNS_CTE, rec, out]


def _turns(spark, sf_dir):
    from cuesheet.operators.turns import speaker_turns
    from cuesheet.sources.fixtures import captions_view

    return speaker_turns(captions_view(spark, sf_dir))


def _batched(spark, sf_dir, limit):
    from cuesheet.operators.batching import turn_batches

    return turn_batches(_turns(spark, sf_dir), max_text_length=limit)


@register("turn_batches", _v("SELECT * FROM tb_5000", "captions_v", extra=_tb_cte(5000), recursive=True))
def q_turn_batches(spark, sf_dir):
    return _batched(spark, sf_dir, 5000)


@register("turn_batches_1k", _v("SELECT * FROM tb_1000", "captions_v", extra=_tb_cte(1000), recursive=True))
def q_turn_batches_1k(spark, sf_dir):
    return _batched(spark, sf_dir, 1000)


@register("turn_batches_blocked", _v("SELECT * FROM tb_1000", "captions_v", extra=_tb_cte(1000), recursive=True))
def q_turn_batches_blocked(spark, sf_dir):
    """The block-parallel batcher (the form for very large episodes)."""
    from cuesheet.operators.batching import turn_batches

    return turn_batches(_turns(spark, sf_dir), max_text_length=1000, strategy="blocked")


BATCH_COLLECT_SQL = """
    SELECT episode, batch, CAST(count(*) AS INTEGER) AS n_turns, CAST(sum(length(text)) AS INTEGER) AS n_chars,
           min(idx) AS first_idx, max(idx) AS last_idx,
           arg_min(start, idx) AS start, arg_max("end", idx) AS "end",
           string_agg(text, chr(10) ORDER BY idx) AS texts
    FROM tb_1000 GROUP BY episode, batch
"""


@register("batch_collect", _v(BATCH_COLLECT_SQL, "captions_v", extra=_tb_cte(1000), recursive=True))
def q_batch_collect(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.prompting import batch_collect

    c = batch_collect(_batched(spark, sf_dir, 1000))
    return c.select(
        "episode", "batch", "n_turns", "n_chars", "first_idx", "last_idx", "start", "end",
        F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("texts"),
    )


def _prompt_sql() -> str:
    from cuesheet.operators.prompting import PROMPT_HEAD, PROMPT_TAIL
    from cuesheet.plans.oracle_views import sql_str

    return f"""
    SELECT episode, batch,
           {sql_str(PROMPT_HEAD)} || string_agg(
               'speaker: ' || speaker || chr(10) || 'text: ' || text || chr(10)
               || 'start_time: ' || CAST(start AS VARCHAR) || chr(10)
               || 'end_time: ' || CAST("end" AS VARCHAR) || chr(10), chr(10) ORDER BY idx)
           || {sql_str(PROMPT_TAIL)} AS prompt
    FROM tb_1000 GROUP BY episode, batch
    """


@register("batch_prompt", _v(_prompt_sql(), "captions_v", extra=_tb_cte(1000), recursive=True))
def q_batch_prompt(spark, sf_dir):
    from cuesheet.operators.prompting import batch_collect, batch_prompt

    return batch_prompt(batch_collect(_batched(spark, sf_dir, 1000)))


# --------------------------------------------------------------------------
# extractor responses: repair, retry rounds, key repair, validation
# --------------------------------------------------------------------------
def r1_sql(t: str) -> str:
    """DuckDB form of the rule-based response repair, as one expression."""
    d = (
        f"regexp_replace(regexp_replace(regexp_replace({t}, '\\n([a-z_]+)\"?:', chr(10) || chr(9) || '\"\\1\":', 'g'),"
        f" '\\n\"', '\"', 'g'), '(\"scene_description\": \".+)\"(.+)\"(.+\"\\n)', '\\1''\\2''\\3', 'g')"
    )
    lines = f"string_split({d}, chr(10))"
    lo = f"(CASE WHEN starts_with({d}, '```json') THEN 1 ELSE 0 END)"
    hi = f"(CASE WHEN ends_with({d}, '```') THEN len({lines}) - 1 ELSE len({lines}) END)"
    kept = f"list_filter({lines}, lambda x, i: i > {lo} AND i <= {hi})"
    strip_last2 = f"regexp_replace({kept}[len({kept}) - 1], '^\\s+|\\s+$', '', 'g')"
    final = (
        f"(CASE WHEN len({kept}) >= 2 AND {strip_last2} = '...' "
        f"THEN list_filter({kept}, lambda y, j: j <> len({kept}) - 1) ELSE {kept} END)"
    )
    return f"array_to_string({final}, chr(10))"


def status_sql(t: str) -> str:
    v = f"(CASE WHEN json_valid({t}) THEN {t} END)"
    return (
        f"(CASE WHEN json_type({v}, '$.scenes') = 'ARRAY' THEN "
        f"CASE WHEN json_array_length({v}, '$.scenes') = 0 THEN 'empty' ELSE 'ok' END ELSE 'error' END)"
    )


RESOLVED_CTES = [
    ("rr", f"""
        SELECT episode, batch, 0 AS attempt, text, {status_sql('text')} AS st FROM responses_v
        UNION ALL
        SELECT episode, batch, attempt + 1, {r1_sql('text')}, {status_sql(r1_sql('text'))}
        FROM rr WHERE st = 'error' AND {r1_sql('text')} <> text AND attempt + 1 < 10
    """),
    ("resolved_o", """
        SELECT episode, batch, attempt, text, CASE WHEN st = 'error' THEN 'dead' ELSE st END AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY episode, batch ORDER BY attempt DESC) AS rn FROM rr)
        WHERE rn = 1
    """),
]


def _num(s: str, path: str) -> str:
    jt = f"json_type({s}, {path})"
    return (
        f"(CASE WHEN {jt} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST({s} ->> {path} AS DOUBLE) "
        f"WHEN {jt} = 'BOOLEAN' THEN CASE WHEN {s} ->> {path} = 'true' THEN 1.0 ELSE 0.0 END "
        f"WHEN {jt} = 'VARCHAR' THEN TRY_CAST({s} ->> {path} AS DOUBLE) END)"
    )


def _int(s: str, path: str) -> str:
    jt = f"json_type({s}, {path})"
    dv = f"CAST({s} ->> {path} AS DOUBLE)"
    return (
        f"(CASE WHEN {jt} IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND {dv} = floor({dv}) THEN CAST({dv} AS INTEGER) "
        f"WHEN {jt} = 'BOOLEAN' THEN CASE WHEN {s} ->> {path} = 'true' THEN 1 ELSE 0 END "
        f"WHEN {jt} = 'VARCHAR' AND regexp_matches({s} ->> {path}, '^\\s*[-+]?[0-9]+\\s*$') "
        f"THEN CAST(trim({s} ->> {path}) AS INTEGER) END)"
    )


def _str(s: str, path: str) -> str:
    return f"(CASE WHEN json_type({s}, {path}) = 'VARCHAR' THEN {s} ->> {path} END)"


SCENE_FIELDS_SQL = [
    "character", "speaker", "in_game", "background", "action", "object", "poses",
    "start_time", "end_time", "scene_description",
]
_END_KEY = "list_filter(json_keys(s), lambda k: starts_with(k, 'end') AND k <> 'end_time')"
_END_PATH = f"(CASE WHEN len({_END_KEY}) > 0 THEN '$.\"' || {_END_KEY}[-1] || '\"' ELSE '$.end_time' END)"


def _typed_sql() -> str:
    cols = {}
    for f in SCENE_FIELDS_SQL:
        path = f"'$.{f}'"
        if f in ("in_game",):
            cols[f] = _int("s", path)
        elif f == "start_time":
            cols[f] = _num("s", path)
        elif f == "end_time":
            cols[f] = _num("s", _END_PATH)
        else:
            cols[f] = _str("s", path)
    cols["character"] = f"(CASE WHEN list_contains(json_keys(s), 'environment') THEN 'environment' ELSE {cols['character']} END)"
    reason = "CASE " + " ".join(f"WHEN {cols[f]} IS NULL THEN '{f}'" for f in SCENE_FIELDS_SQL) + " END"
    sel = ",\n".join(f"{cols[f]} AS {f}" for f in SCENE_FIELDS_SQL)
    return f"""
        SELECT episode, batch, attempt, scene_idx, {reason} AS reason,
               {sel}
        FROM (SELECT episode, batch, attempt,
                     CAST(generate_subscripts(json_extract(text, '$.scenes[*]'), 1) - 1 AS INTEGER) AS scene_idx,
                     unnest(json_extract(text, '$.scenes[*]')) AS s
              FROM resolved_o WHERE status = 'ok')
    """


SCENE_ROWS_CTES = RESOLVED_CTES + [("scene_rows_o", _typed_sql())]


def _responses(spark, sf_dir):
    from cuesheet.sources.fixtures import responses_view

    return responses_view(spark, sf_dir)


def _resolved(spark, sf_dir):
    from cuesheet.operators.repair import resolve_responses

    return resolve_responses(_responses(spark, sf_dir).drop("attempt"))


def _scene_rows(spark, sf_dir):
    from cuesheet.operators.repair import scene_rows

    return scene_rows(_resolved(spark, sf_dir))


@register("response_repair", _v(f"SELECT episode, batch, {r1_sql('text')} AS text FROM responses_v", "responses_v"))
def q_response_repair(spark, sf_dir):
    from cuesheet.operators.repair import repair_frame

    r = _responses(spark, sf_dir)
    return repair_frame(r.select("episode", "batch", "text"), "text", "text")


@register("response_stats", _v("""
    SELECT episode, batch, attempt, status,
           CAST(CASE WHEN status = 'dead' THEN 0 ELSE json_array_length(text, '$.scenes') END AS INTEGER) AS n_scenes
    FROM resolved_o
""", "responses_v", extra=RESOLVED_CTES, recursive=True))
def q_response_stats(spark, sf_dir):
    from pyspark.sql import functions as F

    r = _resolved(spark, sf_dir)
    return r.select(
        "episode", "batch", "attempt", "status",
        F.when(F.col("status") == "dead", F.lit(0)).otherwise(F.size("parsed.scenes")).cast("int").alias("n_scenes"),
    )


@register("scene_key_repair", _v(f"""
    SELECT episode, batch, scene_idx,
           (CASE WHEN list_contains(json_keys(s), 'environment') THEN 'environment' ELSE {_str('s', "'$.character'")} END) AS character,
           CAST(list_contains(json_keys(s), 'environment') AS INTEGER) AS had_environment,
           (CASE WHEN len({_END_KEY}) > 0 THEN {_END_KEY}[-1] END) AS renamed_key,
           {_num('s', _END_PATH)} AS end_time
    FROM (SELECT episode, batch,
                 CAST(generate_subscripts(json_extract(text, '$.scenes[*]'), 1) - 1 AS INTEGER) AS scene_idx,
                 unnest(json_extract(text, '$.scenes[*]')) AS s
          FROM resolved_o WHERE status = 'ok')
""", "responses_v", extra=RESOLVED_CTES, recursive=True))
def q_scene_key_repair(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.repair import scene_rows

    r = _resolved(spark, sf_dir)
    rows = scene_rows(r)
    keys = r.where(F.col("status") == "ok").select(
        "episode", "batch", F.posexplode("parsed.scenes").alias("scene_idx", "m")
    ).select(
        "episode", "batch", "scene_idx",
        F.map_contains_key("m", "environment").cast("int").alias("had_environment"),
        F.try_element_at(F.filter(F.map_keys("m"), lambda k: k.startswith("end") & (k != "end_time")), F.lit(-1)).alias(
            "renamed_key"
        ),
    )
    return rows.select("episode", "batch", "scene_idx", "character", "end_time").join(
        keys, ["episode", "batch", "scene_idx"]
    )


@register("scene_validate", _v(f"SELECT * EXCLUDE (reason) FROM scene_rows_o WHERE reason IS NULL", "responses_v",
                                 extra=SCENE_ROWS_CTES, recursive=True))
def q_scene_validate(spark, sf_dir):
    from cuesheet.operators.repair import valid_scenes

    return valid_scenes(_scene_rows(spark, sf_dir))


@register("episode_pack", _v(f"""
    SELECT s.episode, CAST(row_number() OVER (PARTITION BY s.episode ORDER BY s.batch, scene_idx) - 1 AS INTEGER) AS scene_id,
           s.batch, character, start_time, end_time, scene_description,
           CAST(coalesce(n_turns, 0) AS INTEGER) AS n_turns, coalesce(texts, '') AS turn_texts
    FROM scene_rows_o s LEFT JOIN ({BATCH_COLLECT_SQL}) b ON b.episode = s.episode AND b.batch = s.batch
    WHERE reason IS NULL
""", "responses_v", "captions_v", extra=[*SCENE_ROWS_CTES, *_tb_cte(1000)], recursive=True))
def q_episode_pack(spark, sf_dir):
    """Valid scenes with the turns of their batch, as an episode file holds them."""
    from pyspark.sql import functions as F

    from cuesheet.operators.prompting import batch_collect
    from cuesheet.operators.repair import valid_scenes
    from cuesheet.operators.scenes import assemble_scenes

    packed = assemble_scenes(valid_scenes(_scene_rows(spark, sf_dir)), batch_collect(_batched(spark, sf_dir, 1000)))
    return packed.select(
        "episode", "scene_id", "batch", "character", "start_time", "end_time", "scene_description",
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("turn_texts"),
    )


@register("scene_rejects", _v("SELECT episode, batch, attempt, scene_idx, reason FROM scene_rows_o WHERE reason IS NOT NULL",
                                "responses_v", extra=SCENE_ROWS_CTES, recursive=True))
def q_scene_rejects(spark, sf_dir):
    from cuesheet.operators.repair import rejected_scenes

    return rejected_scenes(_scene_rows(spark, sf_dir)).select("episode", "batch", "attempt", "scene_idx", "reason")


# --------------------------------------------------------------------------
# files, scene table, viewer table
# --------------------------------------------------------------------------
VIEWER_CTE = ("viewer_o", """
    SELECT episode_name, youtube_id, idx, speaker, text, start AS start_time, "end" AS end_time,
           scene_id, character, in_game, printf('scene_%03d', scene_id) AS scene_name,
           start + ("end" - start) / 2 AS mid_point
    FROM aligned_o
""")
VIEWER_EXTRA = [TURNS_CTE, ALIGNED_CTE, VIEWER_CTE]
DONE_STEMS_SQL = "SELECT DISTINCT printf('c2e%03d', conv_id) || '_vid' || CAST(conv_id AS VARCHAR) AS stem FROM conversations WHERE role = 'system'"


def _aligned(spark, sf_dir):
    return QUERIES["align_scenes"][0](spark, sf_dir)


def _viewer(spark, sf_dir):
    """The aligned table as the viewer reads it: published once (materialized
    in the shared checkpoint folder) and reused by every lookup branch."""
    from pyspark.sql import functions as F

    from cuesheet.sinks.files import materialize

    a = materialize(_aligned(spark, sf_dir), "aligned", key=f"aligned:{sf_dir}")
    return a.withColumnsRenamed({"start": "start_time", "end": "end_time"}).withColumns({
        "scene_name": F.format_string("scene_%03d", F.col("scene_id")),
        "mid_point": F.col("start_time") + (F.col("end_time") - F.col("start_time")) / 2,
    })


def _scenes_with_ids(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.sources.fixtures import scenes_view

    s = scenes_view(spark, sf_dir, keep_keys=True)
    return s.withColumn("youtube_id", F.concat(F.lit("vid"), F.col("conv_id").cast("string"))).drop("turn")


def _done_stems(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.sources.tables import read_table

    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == "system")
    return c.select(
        F.concat(F.format_string("c2e%03d", F.col("conv_id")), F.lit("_vid"), F.col("conv_id").cast("string")).alias("stem")
    ).distinct()


def _caption_stems(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.sources.fixtures import captions_view

    return captions_view(spark, sf_dir).select(F.concat_ws("_", "episode", "youtube_id").alias("stem")).distinct()


@register("caption_scan", _v("SELECT episode || '_' || youtube_id AS stem, episode, youtube_id, idx, text, start, duration FROM captions_v", "captions_v"))
def q_caption_scan(spark, sf_dir):
    from cuesheet.sinks.files import scratch_path, write_caption_files
    from cuesheet.sources.files import read_caption_files
    from cuesheet.sources.fixtures import captions_view

    path = scratch_path(spark, "captions")
    write_caption_files(captions_view(spark, sf_dir), path)
    return read_caption_files(spark, path)


@register("scene_scan", _v("""
    SELECT episode AS episode_name, 'vid' || CAST(conv_id AS VARCHAR) AS youtube_id, scene_id, character, speaker,
           in_game, background, action, object, poses, start_time, end_time, scene_description
    FROM scenes_k
""", "scenes_k"))
def q_scene_scan(spark, sf_dir):
    from cuesheet.sinks.files import scratch_path, write_scene_files
    from cuesheet.sources.files import read_scene_files

    path = scratch_path(spark, "scenes")
    write_scene_files(_scenes_with_ids(spark, sf_dir), path)
    return read_scene_files(spark, path)


@register("scene_flatten", _v("""
    SELECT episode AS episode_name, 'vid' || CAST(conv_id AS VARCHAR) AS youtube_id, scene_id, character, speaker,
           in_game, start_time, end_time
    FROM scenes_k
""", "scenes_k"))
def q_scene_flatten(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.sources.files import split_stem

    s = _scenes_with_ids(spark, sf_dir)
    nested = s.groupBy("episode", "youtube_id").agg(
        F.collect_list(F.struct("scene_id", "character", "speaker", "in_game", "start_time", "end_time")).alias("scenes")
    ).select(F.concat_ws("_", "episode", "youtube_id").alias("name"), F.array_sort("scenes").alias("scenes"))
    ep, yt = split_stem(F.col("name"))
    ex = nested.select(ep.alias("episode_name"), yt.alias("youtube_id"), F.posexplode("scenes").alias("pos", "scene"))
    return ex.select("episode_name", "youtube_id", F.col("pos").cast("int").alias("scene_id"),
                     "scene.character", "scene.speaker", "scene.in_game", "scene.start_time", "scene.end_time")


@register("stem_parse", _v("""
    SELECT DISTINCT episode || '_' || youtube_id AS stem, split_part(episode || '_' || youtube_id, '_', 1) AS episode_name,
           youtube_id
    FROM captions_v
""", "captions_v"))
def q_stem_parse(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.sources.files import split_stem

    ep, yt = split_stem(F.col("stem"))
    return _caption_stems(spark, sf_dir).select("stem", ep.alias("episode_name"), yt.alias("youtube_id"))


@register("viewer_load", _v("SELECT * FROM viewer_o", "captions_v", "scenes_v", extra=VIEWER_EXTRA))
def q_viewer_load(spark, sf_dir):
    from cuesheet.sinks.files import export_aligned, scratch_path
    from cuesheet.sources.files import read_viewer_csv

    path = scratch_path(spark, "aligned")
    export_aligned(_aligned(spark, sf_dir), path)
    return read_viewer_csv(spark, f"{path}/by_episode")


@register("video_id_map", _v("""
    SELECT episode_name, arg_min(youtube_id, idx) AS youtube_id FROM aligned_o
    WHERE youtube_id IS NOT NULL GROUP BY episode_name
""", "captions_v", "scenes_v", extra=[TURNS_CTE, ALIGNED_CTE]))
def q_video_id_map(spark, sf_dir):
    from cuesheet.operators.scenes import video_id_map

    return video_id_map(_aligned(spark, sf_dir))


@register("episode_list", _v("""
    SELECT episode_name, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS position,
           'Campaign 2 Episode ' || split_part(episode_name, 'e', 2) AS label, youtube_id
    FROM (SELECT episode_name, min(place) AS first, arg_min(youtube_id, place) AS youtube_id
          FROM (SELECT *, md5(episode_name || ':' || CAST(idx AS VARCHAR)) AS place FROM aligned_o) GROUP BY episode_name)
""", "captions_v", "scenes_v", extra=[TURNS_CTE, ALIGNED_CTE]))
def q_episode_list(spark, sf_dir):
    """The viewer's rows in an order in which episodes don't ascend by name."""
    from pyspark.sql import functions as F

    from cuesheet.operators.scenes import episode_list

    place = F.md5(F.concat_ws(":", "episode_name", F.col("idx").cast("string")))
    return episode_list(_aligned(spark, sf_dir).withColumn("place", place), "place")


@register("scene_bounds", _v("""
    SELECT episode_name, min(start_time) AS min_start, max(end_time) AS max_end, count(*) AS n_rows
    FROM viewer_o GROUP BY episode_name
""", "captions_v", "scenes_v", extra=VIEWER_EXTRA))
def q_scene_bounds(spark, sf_dir):
    from cuesheet.operators.scenes import scene_bounds

    return scene_bounds(_viewer(spark, sf_dir))


@register("scene_gap", _v("""
    SELECT episode, scene_id, start_time, end_time, prev_end_time, start_time - prev_end_time AS gap,
           CAST(start_time < prev_end_time AS INTEGER) AS overlap
    FROM (SELECT *, lag(end_time) OVER (PARTITION BY episode ORDER BY scene_id) AS prev_end_time FROM scenes_v)
""", "scenes_v"))
def q_scene_gap(spark, sf_dir):
    from cuesheet.operators.scenes import scene_gap
    from cuesheet.sources.fixtures import scenes_view

    return scene_gap(scenes_view(spark, sf_dir))


@register("episode_limit", _v(f"""
    SELECT stem, ordinal FROM (
        SELECT stem, row_number() OVER (ORDER BY stem) AS ordinal
        FROM (SELECT DISTINCT episode || '_' || youtube_id AS stem FROM captions_v))
    WHERE ordinal <= 50 AND stem NOT IN ({DONE_STEMS_SQL})
""", "captions_v"))
def q_episode_limit(spark, sf_dir):
    from cuesheet.operators.scenes import episode_limit

    return episode_limit(_caption_stems(spark, sf_dir), _done_stems(spark, sf_dir), 50)


@register("resume_episodes", _v(f"""
    SELECT DISTINCT episode || '_' || youtube_id AS stem FROM captions_v
    WHERE episode || '_' || youtube_id NOT IN ({DONE_STEMS_SQL})
""", "captions_v"))
def q_resume_episodes(spark, sf_dir):
    from cuesheet.operators.scenes import resume_anti

    return resume_anti(_caption_stems(spark, sf_dir), _done_stems(spark, sf_dir), ["stem"])


@register("resume_scenes", _v("""
    SELECT episode, scene_id FROM scenes_v s
    WHERE NOT EXISTS (SELECT 1 FROM scenes_v d WHERE d.scene_id % 3 = 0 AND d.episode = s.episode AND d.scene_id = s.scene_id)
""", "scenes_v"))
def q_resume_scenes(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.scenes import resume_anti
    from cuesheet.sources.fixtures import scenes_view

    s = scenes_view(spark, sf_dir).select("episode", "scene_id")
    return resume_anti(s, s.where(F.col("scene_id") % 3 == 0), ["episode", "scene_id"])


PAIR_SCENES_SQL = f"""
    SELECT episode || '_vid' || CAST(CAST(substr(episode, 4) AS BIGINT) AS VARCHAR) AS stem, count(*) AS n_scenes
    FROM ({QUERIES["scene_validate"][1]}) GROUP BY 1
"""


def _pair_inputs(spark, sf_dir):
    """All captions, and the scenes that passed validation: episodes without any are the gaps."""
    from pyspark.sql import functions as F

    s = QUERIES["scene_validate"][0](spark, sf_dir).select("episode")
    number = F.substring("episode", 4, 20).cast("long").cast("string")
    return _caption_stems(spark, sf_dir), s.select(F.concat(F.col("episode"), F.lit("_vid"), number).alias("stem"))


@register("episode_pairing", _v(f"""
    SELECT c.stem, p.n_scenes FROM (SELECT DISTINCT episode || '_' || youtube_id AS stem FROM captions_v) c
    JOIN ({PAIR_SCENES_SQL}) p ON c.stem = p.stem WHERE p.n_scenes > 0
""", "scenes_k", "captions_v"))
def q_episode_pairing(spark, sf_dir):
    from cuesheet.operators.scenes import episode_pairing

    return episode_pairing(*_pair_inputs(spark, sf_dir))


@register("episode_pairing_prefix", _v("""
    SELECT c.stem, p.n_scenes FROM pc c JOIN pp p ON c.stem = p.stem, pg g
    WHERE (g.gap IS NULL OR c.stem < g.gap) AND p.n_scenes > 0
""", "scenes_k", "captions_v", extra=[
    ("pc", "SELECT DISTINCT episode || '_' || youtube_id AS stem FROM captions_v"),
    ("pp", PAIR_SCENES_SQL),
    ("pg", "SELECT min(c.stem) AS gap FROM pc c LEFT JOIN pp p ON c.stem = p.stem WHERE p.stem IS NULL"),
]))
def q_episode_pairing_prefix(spark, sf_dir):
    from cuesheet.operators.scenes import episode_pairing

    return episode_pairing(*_pair_inputs(spark, sf_dir), stop_at_gap=True)


@register("video_id_extract", "SELECT page_id, url, string_split(url, 'v=')[-1] AS video_id FROM pages")
def q_video_id_extract(spark, sf_dir):
    from cuesheet.operators.scenes import video_id_extract
    from cuesheet.sources.tables import read_table

    return video_id_extract(read_table(spark, sf_dir, "pages").select("page_id", "url"))


TRANSCRIPTS_SQL = """
    SELECT 'vid' || CAST(doc_id % 97 AS VARCHAR) AS video,
           CASE WHEN lang = 'en' THEN CASE WHEN doc_id % 3 = 0 THEN 'en-US' ELSE 'en' END ELSE lang END AS language,
           n_chars % 4 <> 0 AS is_manual, doc_id AS transcript_id
    FROM documents
"""


@register("transcript_pick", f"""
    SELECT video, arg_min(transcript_id, (rnk, transcript_id)) AS transcript_id,
           arg_min(language, (rnk, transcript_id)) AS language
    FROM (SELECT *, CASE language WHEN 'en-US' THEN 1 WHEN 'en' THEN 2 END AS rnk FROM ({TRANSCRIPTS_SQL}))
    WHERE is_manual AND rnk IS NOT NULL GROUP BY video
""")
def q_transcript_pick(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.scenes import transcript_pick
    from cuesheet.sources.tables import read_table

    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    t = d.select(
        F.concat(F.lit("vid"), (F.col("doc_id") % 97).cast("string")).alias("video"),
        F.when(F.col("lang") == "en", F.when(F.col("doc_id") % 3 == 0, F.lit("en-US")).otherwise(F.lit("en")))
        .otherwise(F.col("lang")).alias("language"),
        (F.col("n_chars") % 4 != 0).alias("is_manual"),
        F.col("doc_id").alias("transcript_id"),
    )
    return transcript_pick(t)


@register("episode_numbering", """
    SELECT page_id, video_id, ordinal, printf('c2e%03d_%s.json', ordinal, video_id) AS file_name
    FROM (SELECT page_id, string_split(url, 'v=')[-1] AS video_id, row_number() OVER (ORDER BY page_id) AS ordinal FROM pages)
""")
def q_episode_numbering(spark, sf_dir):
    from cuesheet.operators.scenes import episode_numbering, video_id_extract
    from cuesheet.sources.tables import read_table

    v = video_id_extract(read_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
    return episode_numbering(v, ["page_id"]).select("page_id", "video_id", "ordinal", "file_name")


def _speaker_map_values() -> str:
    from cuesheet.constants import SPEAKER_MAP

    return ", ".join(f"('{k}', '{v}')" for k, v in SPEAKER_MAP.items())


@register("speaker_check", _v(f"""
    SELECT episode_name, character_key, count(*) AS n_rows,
           CAST(sum(CASE WHEN expected_speaker IS NULL THEN 0 WHEN upper(speaker) = expected_speaker THEN 0 ELSE 1 END) AS BIGINT) AS n_mismatch,
           max(expected_speaker) AS expected_speaker
    FROM (SELECT v.*, lower(trim(v.character)) AS character_key, m.expected_speaker FROM viewer_o v
          LEFT JOIN (VALUES {_speaker_map_values()}) m(character_key, expected_speaker)
            ON lower(trim(v.character)) = m.character_key)
    GROUP BY episode_name, character_key
""", "captions_v", "scenes_v", extra=VIEWER_EXTRA))
def q_speaker_check(spark, sf_dir):
    from cuesheet.operators.scenes import speaker_check

    return speaker_check(_viewer(spark, sf_dir))


# --------------------------------------------------------------------------
# playback lookup
# --------------------------------------------------------------------------
def _meta_values() -> str:
    from cuesheet.constants import EPISODE_META

    return ", ".join(f"('{e}', {g}, {b0}, {b1})" for e, g, b0, b1 in EPISODE_META)


LOOKUP_CTES = VIEWER_EXTRA + [
    ("lk_b", "SELECT episode_name, min(start_time) AS mn, max(end_time) AS mx FROM viewer_o GROUP BY 1"),
    ("lk_e", f"""
        SELECT p.*, CASE WHEN b.mx IS NOT NULL THEN greatest(least(p.position, b.mx), b.mn) END AS t,
               m.game_start, m.break_start, m.break_end
        FROM positions_v p LEFT JOIN lk_b b ON p.episode = b.episode_name
        LEFT JOIN (VALUES {_meta_values()}) m(meta_episode, game_start, break_start, break_end)
          ON p.episode = m.meta_episode
    """),
    ("lk_e2", """
        SELECT *, CASE WHEN t <= game_start THEN 'intro' WHEN t >= break_start AND t <= break_end THEN 'break'
                       ELSE 'scene' END AS mode0 FROM lk_e
    """),
    ("lk_cand", """
        SELECT e.event_id, 0 AS prio, abs(v.mid_point - CASE WHEN e.mode0 = 'intro' THEN e.t ELSE 0.0 END) AS dist,
               v.idx, v.scene_id, v.speaker, v.character, v.scene_name
        FROM lk_e2 e JOIN viewer_o v ON v.episode_name = e.episode AND v.character = 'environment'
        WHERE e.mode0 IN ('intro', 'break')
        UNION ALL
        SELECT e.event_id, 0, 0.0, v.idx, v.scene_id, v.speaker, v.character, v.scene_name
        FROM lk_e2 e JOIN viewer_o v ON v.episode_name = e.episode AND v.start_time <= e.t AND e.t <= v.end_time
        WHERE e.mode0 = 'scene'
        UNION ALL
        SELECT e.event_id, 1, abs(v.mid_point - e.t), v.idx, v.scene_id, v.speaker, v.character, v.scene_name
        FROM lk_e2 e JOIN viewer_o v ON v.episode_name = e.episode
        WHERE e.mode0 = 'scene' AND e.t IS NOT NULL
    """),
    ("lk_best", """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prio, dist, idx) AS rn FROM lk_cand)
        WHERE rn = 1
    """),
    ("lookup_o", """
        SELECT e.event_id, e.session, e.episode, e.position, e.event_type, e.ts, e.t,
               CASE WHEN e.mode0 <> 'scene' THEN e.mode0 WHEN b.prio = 0 THEN 'hit' WHEN b.prio IS NOT NULL THEN 'nearest' END AS mode,
               CASE WHEN e.mode0 = 'scene' AND e.t IS NOT NULL THEN coalesce(o.n, 0) END AS overlap_count,
               b.scene_id, b.speaker, b.character, b.scene_name, b.idx
        FROM lk_e2 e LEFT JOIN lk_best b ON e.event_id = b.event_id
        LEFT JOIN (SELECT event_id, count(*) AS n FROM lk_cand WHERE prio = 0 GROUP BY event_id) o ON o.event_id = e.event_id
    """),
]


def _lookup(spark, sf_dir):
    from cuesheet.operators.lookup import build_lookup_index, lookup_scenes
    from cuesheet.sources.fixtures import positions_view

    segments = build_lookup_index(_viewer(spark, sf_dir))
    return lookup_scenes(positions_view(spark, sf_dir), segments, event_key_map={"episode_name": "episode"})


@register("scene_lookup", _v("SELECT * FROM lookup_o", "captions_v", "scenes_v", "positions_v", extra=LOOKUP_CTES))
def q_scene_lookup(spark, sf_dir):
    return _lookup(spark, sf_dir)


@register("image_url", _v(f"""
    SELECT event_id, session, ts, episode, scene_name,
           CASE WHEN scene_name IS NOT NULL THEN printf('%s/%s/%s_image_%02d.png', '{__import__('cuesheet.constants', fromlist=['x']).DEFAULT_IMAGE_BASE_URL}',
                episode, scene_name, CAST(floor(position * 16) AS BIGINT) % 12) END AS image_url
    FROM lookup_o
""", "captions_v", "scenes_v", "positions_v", extra=LOOKUP_CTES))
def q_image_url(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.lookup import image_url

    r = _lookup(spark, sf_dir)
    return image_url(r, "episode", F.floor(F.col("position") * 16)).select("event_id", "session", "ts", "episode", "scene_name", "image_url")


@register("nearest_scene", _v("""
    SELECT event_id, episode, position, scene_id, idx, distance FROM (
        SELECT p.event_id, p.episode, p.position, v.scene_id, v.idx, abs(v.mid_point - p.position) AS distance,
               row_number() OVER (PARTITION BY p.event_id ORDER BY abs(v.mid_point - p.position), v.idx) AS rn
        FROM positions_v p JOIN viewer_o v ON v.episode_name = p.episode)
    WHERE rn = 1
""", "captions_v", "scenes_v", "positions_v", extra=VIEWER_EXTRA))
def q_nearest_scene(spark, sf_dir):
    from cuesheet.operators.lookup import nearest_scene
    from cuesheet.sources.fixtures import positions_view

    ev = positions_view(spark, sf_dir).select("event_id", "episode", "position")
    return nearest_scene(ev, _viewer(spark, sf_dir))


# --------------------------------------------------------------------------
# prompts and image manifests
# --------------------------------------------------------------------------
def _pcs_sql() -> str:
    from cuesheet.constants import PLAYER_CHARACTERS

    return ", ".join(f"'{p}'" for p in PLAYER_CHARACTERS)


def _dim_values() -> str:
    from cuesheet import constants as C
    from cuesheet.plans.oracle_views import sql_str

    names = list(dict.fromkeys([*C.CHARACTER_TOKENS, *C.ADDITIONAL_PROMPTS, *C.ADDITIONAL_NEGATIVE_PROMPTS,
                                *C.PLAYER_CHARACTERS]))

    def lit(v):
        return "CAST(NULL AS VARCHAR)" if v is None else sql_str(v)

    return ", ".join(
        f"({sql_str(n)}, {lit(C.CHARACTER_TOKENS.get(n))}, {lit(C.ADDITIONAL_PROMPTS.get(n))}, "
        f"{lit(C.ADDITIONAL_NEGATIVE_PROMPTS.get(n))})"
        for n in names
    )


def _prompts_ctes() -> list[tuple[str, str]]:
    from cuesheet import constants as C
    from cuesheet.plans.oracle_views import sql_str

    strip = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    pcs = _pcs_sql()
    aug = sql_str(", " + C.PROMPT_AUGMENTATION)
    dflt = sql_str(C.DEFAULT_NEGATIVE_PROMPT)
    return [
        ("sp0", f"""SELECT episode AS episode_name, *, lower({strip.format('character')}) AS c0,
                           lower({strip.format('scene_description')}) AS dsc FROM scenes_v"""),
        ("sp1", f"""SELECT *, CASE WHEN strpos(c0, ' as ') > 0 THEN lower({strip.format("string_split(c0, ' as ')[-1]")})
                                   ELSE c0 END AS ch FROM sp0"""),
        ("sp2", f"""SELECT *, CASE WHEN len(string_split(ch, ' ')) > 1 AND string_split(ch, ' ')[1] IN ({pcs})
                                        THEN string_split(ch, ' ')[1]
                                   WHEN contains(dsc, ch) AND dsc IN ({pcs}) THEN dsc ELSE ch END AS cc0,
                           TRY_CAST(string_split(episode_name, 'e')[-1] AS INTEGER) AS epn FROM sp1"""),
        ("sp3", f"""SELECT *, CASE WHEN cc0 = 'veth' AND epn < {C.VETH_EPISODE} THEN 'nott'
                                   WHEN cc0 = 'caduceus' AND epn < {C.MOLLYMAUK_EPISODE} THEN 'mollymauk'
                                   ELSE cc0 END AS cc FROM sp2"""),
        ("sp4", f"""SELECT sp3.*, coalesce(d.tok, cc) AS tok, coalesce(d.pr, '') AS pr, coalesce(d.ng, '') AS ng
                    FROM sp3 LEFT JOIN (VALUES {_dim_values()}) d(nm, tok, pr, ng) ON sp3.cc = d.nm"""),
        ("prompts_o", f"""
            SELECT episode_name, scene_id,
                   CASE WHEN ch = 'matt' THEN {sql_str(C.DM_CHARACTER)} ELSE cc END AS correct_char,
                   CASE WHEN ch = 'matt' THEN {sql_str(C.DM_TOKEN)} ELSE tok END AS character_tokens,
                   CASE WHEN ch = 'matt' THEN {sql_str(C.DM_PROMPT_PREFIX)} || dsc
                        WHEN cc IN ({pcs}) THEN {sql_str(C.CHARACTER_DESC_PREFIX + ' ')} || tok
                             || CASE WHEN pr <> '' THEN ', ' || pr ELSE '' END
                             || ' ' || action || ', ' || poses || '. (' || background || ' background)++++, fantasy world'
                             || {aug}
                        ELSE {sql_str(C.NON_PC_PROMPT_PREFIX)} || dsc || {aug} END AS prompt,
                   CASE WHEN ch = 'matt' THEN {dflt} WHEN ng <> '' THEN ng || ', ' || {dflt} ELSE {dflt} END AS negative_prompt
            FROM sp4"""),
    ]


def _prompted(spark, sf_dir):
    from cuesheet.operators.prompts import scene_prompts
    from cuesheet.sources.fixtures import scenes_view

    return scene_prompts(scenes_view(spark, sf_dir).withColumnRenamed("episode", "episode_name"))


@register("scene_prompts", _v("SELECT * FROM prompts_o", "scenes_v", extra=_prompts_ctes()))
def q_scene_prompts(spark, sf_dir):
    return _prompted(spark, sf_dir).select(
        "episode_name", "scene_id", "correct_char", "character_tokens", "prompt", "negative_prompt"
    )


RUN_METADATA = {"dataset_id": "scenes-v1", "lora_model_id": "lora-v1", "refiner_model_id": None}


@register("scene_metadata_json", _v("""
    SELECT p.episode_name, p.scene_id, printf('scene_%03d_metadata.json', p.scene_id) AS metadata_file,
           'scenes-v1' AS j_dataset_id, CAST(NULL AS VARCHAR) AS j_refiner_model_id, p.correct_char AS j_correct_char,
           p.prompt AS j_prompt, CAST(s.start_time AS VARCHAR) AS j_start_time, 19 AS j_n_keys
    FROM prompts_o p JOIN scenes_v s ON s.episode = p.episode_name AND s.scene_id = p.scene_id
""", "scenes_v", extra=_prompts_ctes()))
def q_scene_metadata_json(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.manifest import scene_metadata

    fields = ["episode_name", "scene_id", "speaker", "character", "in_game", "background", "action", "object", "poses",
              "start_time", "end_time", "scene_description", "correct_char", "character_tokens", "prompt",
              "negative_prompt"]
    m = scene_metadata(_prompted(spark, sf_dir), RUN_METADATA, fields)
    j = F.col("metadata_json")
    return m.select(
        "episode_name", "scene_id", "metadata_file",
        F.get_json_object(j, "$.dataset_id").alias("j_dataset_id"),
        F.get_json_object(j, "$.refiner_model_id").alias("j_refiner_model_id"),
        F.get_json_object(j, "$.correct_char").alias("j_correct_char"),
        F.get_json_object(j, "$.prompt").alias("j_prompt"),
        F.get_json_object(j, "$.start_time").alias("j_start_time"),
        F.size(F.json_object_keys(j)).alias("j_n_keys"),
    )


IMAGE_MANIFEST_SQL = """
    SELECT s.episode AS episode_name, s.scene_id, CAST(n.image_num AS INTEGER) AS image_num,
           printf('%s/scene_%03d_image_%02d.png', s.episode, s.scene_id, n.image_num) AS image_path
    FROM scenes_v s, range(8) n(image_num)
    WHERE s.scene_id % 3 <> 0
"""


def _image_manifest(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.manifest import image_manifest

    p = _prompted(spark, sf_dir)
    done = p.where(F.col("scene_id") % 3 == 0).select("episode_name", "scene_id")
    return image_manifest(p, done)


@register("image_manifest", _v(IMAGE_MANIFEST_SQL, "scenes_v"))
def q_image_manifest(spark, sf_dir):
    return _image_manifest(spark, sf_dir).select("episode_name", "scene_id", "image_num", "image_path")


@register("episode_change", _v("""
    SELECT ordinal, episode_name, scene_id,
           coalesce(lag(episode_name) OVER w <> episode_name, true) AS is_first,
           coalesce(lead(episode_name) OVER w <> episode_name, true) AS upload_after
    FROM (SELECT *, row_number() OVER (ORDER BY episode_name, scene_id) - 1 AS ordinal
          FROM (SELECT DISTINCT episode AS episode_name, scene_id FROM scenes_v WHERE scene_id % 3 <> 0))
    WINDOW w AS (ORDER BY ordinal)
""", "scenes_v"))
def q_episode_change(spark, sf_dir):
    from cuesheet.operators.manifest import upload_points

    gen = _image_manifest(spark, sf_dir).select("episode_name", "scene_id").distinct()
    return upload_points(gen)


@register("content_name", _v("""
    SELECT i.instance, i.id,
           printf('%d-%s.jpg', row_number() OVER (PARTITION BY i.instance ORDER BY i.id) - 1 + coalesce(e.n_existing, 0),
                  sha1(i.content)) AS file_name
    FROM images_v i LEFT JOIN (SELECT instance, count(*) AS n_existing FROM images_v WHERE id % 5 = 0 GROUP BY 1) e
      ON i.instance = e.instance
""", "images_v"))
def q_content_name(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.manifest import content_names
    from cuesheet.sources.fixtures import images_view

    im = images_view(spark, sf_dir)
    existing = im.where(F.col("id") % 5 == 0).groupBy("instance").agg(F.count(F.lit(1)).alias("n_existing"))
    return content_names(im, existing)


INSTANCE_URLS_SQL = """
    SELECT instance_name, url, row_number() OVER (PARTITION BY instance_name ORDER BY pos) - 1 AS pos FROM instances_v
"""


def _nested_config(spark, sf_dir):
    """Config rows with lists of URLs, a hundred at most in a row."""
    from pyspark.sql import functions as F

    from cuesheet.sources.fixtures import instances_view

    d = instances_view(spark, sf_dir).withColumn("part", F.floor(F.col("pos") / 1100))
    lists = F.array_sort(F.collect_list(F.struct("pos", "url")))
    return d.groupBy("instance_name", "part").agg(lists.alias("l")).select("instance_name", "part", F.col("l.url").alias("instance_urls"))


@register("instance_urls", _v(INSTANCE_URLS_SQL, "instances_v"))
def q_instance_urls(spark, sf_dir):
    from cuesheet.operators.manifest import unnest_urls

    return unnest_urls(_nested_config(spark, sf_dir))


@register("download_manifest", _v(f"""
    SELECT instance_name, file_name, instance_name || '/' || file_name AS target,
           arg_max(url, pos) AS url, max(pos) AS pos, count(*) AS n_urls
    FROM (SELECT *, string_split(url, '/')[-1] AS file_name FROM ({INSTANCE_URLS_SQL}))
    GROUP BY instance_name, file_name
""", "instances_v"))
def q_download_manifest(spark, sf_dir):
    from cuesheet.operators.manifest import download_manifest, unnest_urls

    return download_manifest(unnest_urls(_nested_config(spark, sf_dir)))


# --------------------------------------------------------------------------
# playback change detection and image updates
# --------------------------------------------------------------------------
_EM = ("((e.position - r.last > 5 OR e.position = 0) AND "
       "(r.s_ch IS DISTINCT FROM e.character OR r.s_sid IS DISTINCT FROM e.scene_id))")
PLAYBACK_CTES = LOOKUP_CTES + [
    ("pc_ev", """SELECT event_id, session, ts, episode, position, event_type, speaker, character, scene_id,
                        row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS rn FROM lookup_o"""),
    ("pc_rec", f"""
        SELECT DISTINCT session, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS episode,
               CAST(NULL AS DOUBLE) AS position, CAST(0.0 AS DOUBLE) AS last, CAST(NULL AS VARCHAR) AS s_spk,
               CAST(NULL AS VARCHAR) AS s_ch, CAST(NULL AS INTEGER) AS s_sid, false AS emit
        FROM pc_ev
        UNION ALL
        SELECT e.session, e.rn, e.event_id, e.ts, e.episode, e.position,
               CASE WHEN e.event_type = 1 THEN 0.0 WHEN e.position - r.last > 5 THEN e.position ELSE r.last END,
               CASE WHEN {_EM} THEN e.speaker ELSE r.s_spk END,
               CASE WHEN {_EM} THEN e.character ELSE r.s_ch END,
               CASE WHEN {_EM} THEN e.scene_id ELSE r.s_sid END,
               {_EM}
        FROM pc_rec r JOIN pc_ev e ON e.session = r.session AND e.rn = r.rn + 1
    """),
    ("pc_out", """SELECT event_id, session, ts, episode, position, s_spk AS speaker, s_ch AS character, s_sid AS scene_id
                  FROM pc_rec WHERE emit"""),
]


def _filtered_lookup_ctes() -> list[tuple[str, str]]:
    filt = "AND v.speaker = e.speaker AND v.character = e.character"
    return [
        ("fl_b", f"""SELECT e.event_id, min(v.start_time) AS mn, max(v.end_time) AS mx
                     FROM pc_out e JOIN viewer_o v ON v.episode_name = e.episode {filt} GROUP BY e.event_id"""),
        ("fl_e", f"""
            SELECT p.*, CASE WHEN b.mx IS NOT NULL THEN greatest(least(p.position, b.mx), b.mn) END AS t,
                   m.game_start, m.break_start, m.break_end
            FROM pc_out p LEFT JOIN fl_b b ON p.event_id = b.event_id
            LEFT JOIN (VALUES {_meta_values()}) m(meta_episode, game_start, break_start, break_end)
              ON p.episode = m.meta_episode"""),
        ("fl_e2", """SELECT *, CASE WHEN t <= game_start THEN 'intro' WHEN t >= break_start AND t <= break_end THEN 'break'
                                    ELSE 'scene' END AS mode0 FROM fl_e"""),
        ("fl_cand", f"""
            SELECT e.event_id, 0 AS prio, abs(v.mid_point - CASE WHEN e.mode0 = 'intro' THEN e.t ELSE 0.0 END) AS dist,
                   v.idx, v.scene_name
            FROM fl_e2 e JOIN viewer_o v ON v.episode_name = e.episode {filt} AND v.character = 'environment'
            WHERE e.mode0 IN ('intro', 'break')
            UNION ALL
            SELECT e.event_id, 0, 0.0, v.idx, v.scene_name
            FROM fl_e2 e JOIN viewer_o v ON v.episode_name = e.episode {filt} AND v.start_time <= e.t AND e.t <= v.end_time
            WHERE e.mode0 = 'scene'
            UNION ALL
            SELECT e.event_id, 1, abs(v.mid_point - e.t), v.idx, v.scene_name
            FROM fl_e2 e JOIN viewer_o v ON v.episode_name = e.episode {filt}
            WHERE e.mode0 = 'scene' AND e.t IS NOT NULL"""),
        ("fl_best", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prio, dist, idx) AS rn
                       FROM fl_cand) WHERE rn = 1"""),
    ]


def _playback(spark, sf_dir):
    from cuesheet.streaming.playback import playback_changes

    return playback_changes(_lookup(spark, sf_dir))


@register("playback_changes", _v("SELECT * FROM pc_out", "captions_v", "scenes_v", "positions_v",
                                   extra=PLAYBACK_CTES, recursive=True))
def q_playback_changes(spark, sf_dir):
    return _playback(spark, sf_dir)


@register("playback_changes_blocked", _v("SELECT * FROM pc_out", "captions_v", "scenes_v", "positions_v",
                                           extra=PLAYBACK_CTES, recursive=True))
def q_playback_changes_blocked(spark, sf_dir):
    """The same with blocks so small that sessions span many of them."""
    from cuesheet.streaming.playback import playback_changes

    return playback_changes(_lookup(spark, sf_dir), block_rows=16)


@register("image_updates", _v(f"""
    SELECT e.event_id, e.session, e.ts, e.episode, e.speaker, e.character, b.scene_name,
           CASE WHEN b.scene_name IS NOT NULL THEN printf('%s/%s/%s_image_%02d.png',
                '{__import__('cuesheet.constants', fromlist=['x']).DEFAULT_IMAGE_BASE_URL}',
                e.episode, b.scene_name, CAST(floor(e.position * 16) AS BIGINT) % 12) END AS image_url
    FROM pc_out e LEFT JOIN fl_best b ON e.event_id = b.event_id
""", "captions_v", "scenes_v", "positions_v", extra=PLAYBACK_CTES + _filtered_lookup_ctes(), recursive=True))
def q_image_updates(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.lookup import build_lookup_index, image_url, lookup_scenes

    keys = ["episode_name", "speaker", "character"]
    segments = build_lookup_index(_viewer(spark, sf_dir), keys)
    r = lookup_scenes(_playback(spark, sf_dir), segments, event_key_map={"episode_name": "episode"})
    return image_url(r, "episode", F.floor(F.col("position") * 16)).select(
        "event_id", "session", "ts", "episode", "speaker", "character", "scene_name", "image_url"
    )


# --------------------------------------------------------------------------
# training-data preparation and artifacts
# --------------------------------------------------------------------------
def _cfg(spark, sf_dir):
    from cuesheet.sources.fixtures import instance_config_view

    return instance_config_view(spark, sf_dir)


def _images(spark, sf_dir):
    from cuesheet.sources.fixtures import images_view

    return images_view(spark, sf_dir)


def _inst_images(spark, sf_dir):
    from pyspark.sql import functions as F

    return _images(spark, sf_dir).where(F.col("width") >= 600)


def _class_images(spark, sf_dir):
    from pyspark.sql import functions as F

    cfg = _cfg(spark, sf_dir).where(F.col("class_data_root").isNotNull()).select(F.col("instance_name").alias("instance"))
    return _images(spark, sf_dir).where(F.col("width") < 600).join(cfg, "instance", "left_semi")


CAPTION_RULE_SQL = "CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN NULL ELSE content END"


def _caption_rule():
    from pyspark.sql import functions as F

    return (F.when(F.col("id") % 3 == 0, F.lit("")).when(F.col("id") % 3 == 1, F.lit(None).cast("string"))
            .otherwise(F.col("content")))


@register("instance_subset", _v("""
    SELECT instance_name, instance_prompt FROM instcfg_v WHERE instance_name IN ('inst01', 'inst04', 'inst09')
""", "instcfg_v"))
def q_instance_subset(spark, sf_dir):
    from cuesheet.operators.trainprep import instance_subset

    return instance_subset(_cfg(spark, sf_dir), ["inst01", "inst04", "inst09"]).select("instance_name", "instance_prompt")


@register("instance_paths", _v("""
    SELECT instance_name, '/data/' || instance_data_root AS instance_path,
           CASE WHEN class_data_root IS NOT NULL THEN '/data/' || class_data_root END AS class_path
    FROM instcfg_v
""", "instcfg_v"))
def q_instance_paths(spark, sf_dir):
    from cuesheet.operators.trainprep import instance_paths

    return instance_paths(_cfg(spark, sf_dir), "/data")


@register("example_prompts", _v(f"""
    SELECT i.id, i.instance, coalesce(nullif({CAPTION_RULE_SQL}, ''), c.instance_prompt) AS prompt
    FROM images_v i LEFT JOIN instcfg_v c ON c.instance_name = i.instance WHERE i.width >= 600
""", "images_v", "instcfg_v"))
def q_example_prompts(spark, sf_dir):
    from cuesheet.operators.trainprep import example_prompts

    im = _inst_images(spark, sf_dir).withColumn("caption", _caption_rule())
    return example_prompts(im, _cfg(spark, sf_dir)).select("id", "instance", "prompt")


FOLDER_COUNTS_SQL = """
    SELECT c.instance_name, coalesce(ic.n, 0) AS n_instance_images,
           CASE WHEN c.class_data_root IS NULL THEN NULL ELSE coalesce(cc.n, 0) END AS n_class_images
    FROM instcfg_v c
    LEFT JOIN (SELECT instance, count(*) AS n FROM images_v WHERE width >= 600 GROUP BY 1) ic ON ic.instance = c.instance_name
    LEFT JOIN (SELECT instance, count(*) AS n FROM images_v WHERE width < 600 GROUP BY 1) cc ON cc.instance = c.instance_name
"""


def _folder_counts(spark, sf_dir):
    from cuesheet.operators.trainprep import folder_counts

    return folder_counts(_cfg(spark, sf_dir), _inst_images(spark, sf_dir), _class_images(spark, sf_dir))


@register("folder_counts", _v(FOLDER_COUNTS_SQL, "images_v", "instcfg_v"))
def q_folder_counts(spark, sf_dir):
    return _folder_counts(spark, sf_dir)


@register("instance_counts", _v(f"""
    SELECT instance_name, n_instance_images * 2 AS n_examples,
           greatest(n_instance_images * 2, coalesce(n_class_images, 0)) AS n_examples_max
    FROM ({FOLDER_COUNTS_SQL})
""", "images_v", "instcfg_v"))
def q_instance_counts(spark, sf_dir):
    from pyspark.sql import functions as F

    c = _folder_counts(spark, sf_dir)
    n = F.col("n_instance_images") * 2
    return c.select("instance_name", n.alias("n_examples"),
                    F.greatest(n, F.coalesce("n_class_images", F.lit(0))).alias("n_examples_max"))


CLASS_IMAGES_CTE = ("ci_o", """
    SELECT i.instance, i.id AS class_id, row_number() OVER (PARTITION BY i.instance ORDER BY i.id) - 1 AS class_idx
    FROM images_v i JOIN instcfg_v c ON c.instance_name = i.instance AND c.class_data_root IS NOT NULL
    WHERE i.width < 600
""")


@register("class_pairing", _v("""
    SELECT ii.instance, ii.id, ii.inst_idx, coalesce(nc.n_class, 0) AS n_class, ci.class_id
    FROM (SELECT instance, id, row_number() OVER (PARTITION BY instance ORDER BY id) - 1 AS inst_idx
          FROM images_v WHERE width >= 600) ii
    LEFT JOIN (SELECT instance, least(count(*), 10) AS n_class FROM ci_o GROUP BY 1) nc ON nc.instance = ii.instance
    LEFT JOIN ci_o ci ON ci.instance = ii.instance AND ci.class_idx = ii.inst_idx % nc.n_class
""", "images_v", "instcfg_v", extra=[CLASS_IMAGES_CTE]))
def q_class_pairing(spark, sf_dir):
    from cuesheet.operators.trainprep import class_pairing

    return class_pairing(_inst_images(spark, sf_dir), _class_images(spark, sf_dir), 10).drop("k")


CLASS_MAX_SQL = """
    SELECT s.instance, CAST(k AS BIGINT) AS k, ii.id, CAST(k % s.n_inst AS BIGINT) AS inst_idx, s.n_class, ci.class_id
    FROM (SELECT instance, n_inst, n_class, unnest(range(greatest(n_inst, n_class))) AS k FROM cm_sizes WHERE n_inst > 0) s
    JOIN cm_ii ii ON ii.instance = s.instance AND ii.inst_idx = s.k % s.n_inst
    LEFT JOIN cm_ci ci ON ci.instance = s.instance AND ci.class_idx = CASE WHEN s.n_class > 0 THEN s.k % s.n_class END
"""
CLASS_MAX_CTES = [
    ("cm_ii", """SELECT instance, id, row_number() OVER (PARTITION BY instance ORDER BY id) - 1 AS inst_idx
                 FROM images_v WHERE width >= 600"""),
    ("cm_ci", """SELECT i.instance, i.id AS class_id, row_number() OVER (PARTITION BY i.instance ORDER BY i.id) - 1 AS class_idx
                 FROM images_v i JOIN instcfg_v c ON c.instance_name = i.instance AND c.class_data_root IS NOT NULL
                 WHERE i.width < 600"""),
    ("cm_sizes", """SELECT coalesce(a.instance, b.instance) AS instance, coalesce(a.n, 0) AS n_inst,
                           coalesce(b.n, 0) AS n_class
                    FROM (SELECT instance, count(*) AS n FROM cm_ii GROUP BY 1) a
                    FULL JOIN (SELECT instance, least(count(*), 150) AS n FROM cm_ci GROUP BY 1) b
                      ON a.instance = b.instance"""),
]


@register("class_pairing_max", _v(CLASS_MAX_SQL, "images_v", "instcfg_v", extra=CLASS_MAX_CTES))
def q_class_pairing_max(spark, sf_dir):
    from cuesheet.operators.trainprep import class_pairing

    return class_pairing(_inst_images(spark, sf_dir), _class_images(spark, sf_dir), 150, length="max")


GLOBAL_INDEX_SQL = """
    SELECT instance, id, CAST(rep AS INTEGER) AS rep,
           row_number() OVER (ORDER BY instance, id, rep) - 1 AS global_idx,
           row_number() OVER (PARTITION BY instance ORDER BY id, rep) - 1 AS local_idx
    FROM images_v, range(2) r(rep) WHERE width >= 600
"""


@register("global_index", _v(GLOBAL_INDEX_SQL, "images_v"))
def q_global_index(spark, sf_dir):
    from cuesheet.operators.trainprep import global_index

    return global_index(_inst_images(spark, sf_dir), repeats=2).select("instance", "id", "rep", "global_idx", "local_idx")


@register("prompt_dir_zip", _v("""
    SELECT p.position, p.id, p.instance, d.page_id, d.class_dir
    FROM (SELECT id, instance, row_number() OVER (ORDER BY height DESC, id) - 1 AS position FROM images_v) p
    JOIN (SELECT page_id, string_split(url, '/')[-1] AS class_dir, row_number() OVER (ORDER BY md5(url), page_id) - 1 AS position FROM pages) d
      ON d.position = p.position
    WHERE d.class_dir <> ''
""", "images_v"))
def q_prompt_dir_zip(spark, sf_dir):
    """Prompts and folders are two lists of different length and order; a missing folder skips its pair."""
    from pyspark.sql import functions as F

    from cuesheet.operators.indexing import zip_by_position
    from cuesheet.sources.tables import read_table

    prompts = _images(spark, sf_dir).select("id", "instance", "height")
    dirs = read_table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "/", -1).alias("class_dir"), F.md5("url").alias("k"))
    z = zip_by_position(prompts, [F.desc("height"), "id"], dirs, ["k", "page_id"])
    return z.where(F.col("class_dir") != "").select("position", "id", "instance", "page_id", "class_dir")


@register("validation_prompts", _v("""
    SELECT row_number() OVER (ORDER BY instance_name, j) - 1 AS pos, instance_name, prompt FROM (
        SELECT instance_name, 0 AS j, validation_prompt AS prompt FROM instcfg_v
        UNION ALL SELECT instance_name, 1, class_prompt FROM instcfg_v) WHERE prompt IS NOT NULL
""", "instcfg_v"))
def q_validation_prompts(spark, sf_dir):
    from cuesheet.operators.trainprep import validation_prompts

    return validation_prompts(_cfg(spark, sf_dir))


@register("repeat_rows", _v("SELECT id, instance, CAST(rep AS INTEGER) AS rep FROM images_v, range(3) r(rep)", "images_v"))
def q_repeat_rows(spark, sf_dir):
    from cuesheet.operators.trainprep import repeat_rows

    return repeat_rows(_images(spark, sf_dir).select("id", "instance"), 3)


@register("topup_rows", _v("""
    SELECT instance_name, class_data_root, prompt, index, index + existing AS file_number FROM (
        SELECT instance_name, class_data_root, class_prompt AS prompt, existing,
               unnest(range(greatest(200 - existing, 0))) AS index
        FROM (SELECT c.*, coalesce(cc.n, 0) AS existing FROM instcfg_v c
              LEFT JOIN (SELECT instance, count(*) AS n FROM images_v WHERE width < 600 GROUP BY 1) cc
                ON cc.instance = c.instance_name
              WHERE c.class_data_root IS NOT NULL))
""", "images_v", "instcfg_v"))
def q_topup_rows(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.trainprep import topup_rows

    counts = _class_images(spark, sf_dir).groupBy(F.col("instance").alias("instance_name")).agg(
        F.count(F.lit(1)).alias("existing"))
    return topup_rows(_cfg(spark, sf_dir), counts, 200)


def _draw_sql(number: int) -> str:
    return f"CAST('0x' || substr(md5('42:' || CAST(id AS VARCHAR) || ':{number}'), 1, 13) AS BIGINT) / 4503599627370496.0"


def _crop_sql(center: bool) -> str:
    y, x = (
        [f"greatest(0, CAST(round_even((new_{s} - 256) / 2.0, 0) AS INTEGER))" for s in "hw"]
        if center
        else [f"CAST(floor({_draw_sql(n)} * (new_{s} - 256 + 1)) AS INTEGER)" for n, s in ((1, "h"), (2, "w"))]
    )
    flip = "false" if center else f"{_draw_sql(0)} < 0.5"
    return f"""
    SELECT *, {y} AS crop_y, {x} AS crop_x, {flip} AS flip
    FROM (SELECT id, height AS orig_h, width AS orig_w,
                 CAST(CASE WHEN width <= height THEN floor(256 * height / width) ELSE 256 END AS INTEGER) AS new_h,
                 CAST(CASE WHEN width <= height THEN 256 ELSE floor(256 * width / height) END AS INTEGER) AS new_w
          FROM images_v)
"""


TRAIN_BATCHES_SQL = f"""
    SELECT CAST(floor(rn / 4) AS BIGINT) AS batch_id, CAST(count(*) AS INTEGER) AS n_examples,
           list_concat(list(prompt ORDER BY rn), coalesce(list(class_prompt ORDER BY rn) FILTER (WHERE class_id IS NOT NULL), [])) AS prompts,
           list(orig_h ORDER BY rn) AS original_h, list(orig_w ORDER BY rn) AS original_w,
           list(crop_y ORDER BY rn) AS crop_y, list(crop_x ORDER BY rn) AS crop_x,
           coalesce(list(class_id ORDER BY rn) FILTER (WHERE class_id IS NOT NULL), []) AS class_ids
    FROM (SELECT g.*, coalesce(nullif({CAPTION_RULE_SQL.replace('content', 'i.content').replace('id %', 'g.id %')}, ''), c.instance_prompt) AS prompt,
                 c.class_prompt, k.orig_h, k.orig_w, k.crop_y, k.crop_x, ci.class_id,
                 row_number() OVER (ORDER BY md5('42:' || CAST(g.global_idx AS VARCHAR))) - 1 AS rn
          FROM ({GLOBAL_INDEX_SQL}) g JOIN images_v i ON i.id = g.id
          JOIN ({_crop_sql(center=False)}) k ON k.id = g.id
          LEFT JOIN instcfg_v c ON c.instance_name = g.instance
          LEFT JOIN (SELECT instance, least(count(*), 10) AS n_class FROM ci_o GROUP BY 1) nc ON nc.instance = g.instance
          LEFT JOIN ci_o ci ON ci.instance = g.instance AND ci.class_idx = g.local_idx % nc.n_class)
    GROUP BY 1
"""


def _train_batches(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.trainprep import class_of, crop_geometry, global_index, train_batches

    im = _inst_images(spark, sf_dir)
    g = global_index(im, repeats=2)
    crops = crop_geometry(im, 256, random_flip=True).select(
        "id", F.struct(F.col("orig_h").alias("h"), F.col("orig_w").alias("w")).alias("original_size"),
        F.struct(F.col("crop_y").alias("y"), F.col("crop_x").alias("x")).alias("crop_top_left"),
    )
    cap = im.select("id", _caption_rule().alias("caption"))
    cfg = _cfg(spark, sf_dir).select("instance_name", "instance_prompt", "class_prompt")
    ex = g.join(cap, "id").join(crops, "id").join(cfg, g["instance"] == cfg["instance_name"], "left").withColumn(
        "prompt", F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.col("instance_prompt")))
    return train_batches(class_of(ex, _class_images(spark, sf_dir), 10), batch_size=4, seed=42, prior=True)


@register("train_batches", _v(TRAIN_BATCHES_SQL, "images_v", "instcfg_v", extra=[CLASS_IMAGES_CTE]))
def q_train_batches(spark, sf_dir):
    b = _train_batches(spark, sf_dir)
    return b.selectExpr("batch_id", "n_examples", "prompts", "original_sizes.h AS original_h", "original_sizes.w AS original_w",
                        "crop_top_lefts.y AS crop_y", "crop_top_lefts.x AS crop_x", "class_ids")


@register("epoch_plan", _v(f"""
    SELECT n_batches, CAST(ceil(n_batches / 2) AS BIGINT) AS updates_per_epoch,
           CAST(ceil(n_batches / 2) * 3 AS BIGINT) AS max_train_steps,
           CAST(ceil(ceil(n_batches / 2) * 3 / ceil(n_batches / 2)) AS BIGINT) AS num_epochs,
           8 AS total_batch_size
    FROM (SELECT count(*) AS n_batches FROM ({TRAIN_BATCHES_SQL}))
""", "images_v", "instcfg_v", extra=[CLASS_IMAGES_CTE]))
def q_epoch_plan(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.trainprep import epoch_plan

    n = _train_batches(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_batches"))
    return epoch_plan(n, accum=2, epochs=3, max_steps=None, batch_size=4)


@register("crop_geometry", _v(_crop_sql(center=False), "images_v"))
def q_crop_geometry(spark, sf_dir):
    """Random crops and flips."""
    from cuesheet.operators.trainprep import crop_geometry

    return crop_geometry(_images(spark, sf_dir), 256, random_flip=True)


@register("crop_geometry_center", _v(_crop_sql(center=True), "images_v"))
def q_crop_geometry_center(spark, sf_dir):
    from cuesheet.operators.trainprep import crop_geometry

    return crop_geometry(_images(spark, sf_dir), 256, center_crop=True)


@register("time_ids", _v(f"SELECT id, [orig_h, orig_w, crop_y, crop_x, 256, 256] AS time_ids FROM ({_crop_sql(center=True)})", "images_v"))
def q_time_ids(spark, sf_dir):
    from cuesheet.operators.trainprep import crop_geometry, time_ids

    return time_ids(crop_geometry(_images(spark, sf_dir), 256, center_crop=True), 256)


@register("scale_vectors", _v("SELECT id, list_transform(v, lambda x: (CAST(x AS DOUBLE) - 0.5) / 0.5) AS scaled FROM vectors_v", "vectors_v"))
def q_scale_vectors(spark, sf_dir):
    from cuesheet.operators.trainprep import scale_vectors
    from cuesheet.sources.fixtures import vectors_view

    return scale_vectors(vectors_view(spark, sf_dir))


@register("pad_vectors", _v("""
    SELECT r.id, list_resize(r.v, len(f.v), CAST(0.0 AS FLOAT)) AS padded, CAST(len(f.v) - len(r.v) AS INTEGER) AS n_pad
    FROM ragged_v r JOIN vectors_v f ON f.id = r.id
""", "vectors_v", "ragged_v"))
def q_pad_vectors(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.operators.trainprep import pad_pair
    from cuesheet.sources.fixtures import vectors_view

    r = vectors_view(spark, sf_dir, ragged=True).select("id", F.col("v").alias("r"))
    f = vectors_view(spark, sf_dir).select("id", "v")
    j = r.join(f, "id")
    return j.select("id", pad_pair(F.col("r"), F.col("v")).alias("padded"),
                    (F.size("v") - F.size("r")).cast("int").alias("n_pad"))


@register("concat_vectors", _v("""
    SELECT f.id, list_concat(f.v, r.v) AS joined, CAST(len(f.v) + len(r.v) AS INTEGER) AS n
    FROM vectors_v f JOIN ragged_v r ON f.id = r.id
""", "vectors_v", "ragged_v"))
def q_concat_vectors(spark, sf_dir):
    from pyspark.sql import functions as F

    from cuesheet.sources.fixtures import vectors_view

    r = vectors_view(spark, sf_dir, ragged=True).select("id", F.col("v").alias("r"))
    f = vectors_view(spark, sf_dir).select("id", "v")
    j = f.join(r, "id")
    return j.select("id", F.concat("v", "r").alias("joined"), (F.size("v") + F.size("r")).cast("int").alias("n"))


@register("encode_distinct", _v("""
    SELECT episode_name, scene_id, CAST(length(prompt) AS BIGINT) AS n_chars,
           CAST(len(regexp_split_to_array(trim(prompt), '\\s+')) AS BIGINT) AS n_words
    FROM prompts_o
""", "scenes_v", extra=_prompts_ctes()))
def q_encode_distinct(spark, sf_dir):
    from cuesheet.operators.trainprep import encode_distinct, length_encoder

    p = _prompted(spark, sf_dir).select("episode_name", "scene_id", "prompt")
    return encode_distinct(p, "prompt", length_encoder, "n_chars long, n_words long").select(
        "episode_name", "scene_id", "n_chars", "n_words")


@register("artifact_retention", _v("""
    SELECT owner, path, step, CASE WHEN n >= 3 AND rnk < n - 3 + 1 THEN 'remove' ELSE 'keep' END AS action
    FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY step, path) - 1 AS rnk,
                 count(*) OVER (PARTITION BY owner) AS n
          FROM (SELECT owner, path, TRY_CAST(split_part(path, '-', 2) AS BIGINT) AS step FROM artifacts_v
                WHERE starts_with(path, 'checkpoint')))
""", "artifacts_v"))
def q_artifact_retention(spark, sf_dir):
    from cuesheet.operators.artifacts import artifact_retention
    from cuesheet.sources.fixtures import artifacts_view

    return artifact_retention(artifacts_view(spark, sf_dir), 3)


@register("latest_artifact", _v("""
    SELECT owner, arg_max(path, step) AS path, max(step) AS global_step, CAST(floor(max(step) / 7) AS BIGINT) AS first_epoch
    FROM (SELECT owner, path, TRY_CAST(split_part(path, '-', 2) AS BIGINT) AS step FROM artifacts_v
          WHERE starts_with(path, 'checkpoint'))
    GROUP BY owner
""", "artifacts_v"))
def q_latest_artifact(spark, sf_dir):
    from cuesheet.operators.artifacts import latest_artifact
    from cuesheet.sources.fixtures import artifacts_view

    return latest_artifact(artifacts_view(spark, sf_dir), 7)


@register("resolve_columns", "SELECT doc_id AS image, source AS caption FROM documents")
def q_resolve_columns(spark, sf_dir):
    from cuesheet.operators.trainprep import resolve_columns
    from cuesheet.sources.tables import read_table

    return resolve_columns(read_table(spark, sf_dir, "documents"), None, "source", "a photo")
