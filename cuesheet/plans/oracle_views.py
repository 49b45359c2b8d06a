"""DuckDB definitions of the derived views (oracle side).

Each entry is a CTE body over the pre-registered driver tables; ``with_views``
prefixes a query with the CTEs it needs (dependencies first).  The rules are
the ones in :mod:`cuesheet.sources.fixtures`.
"""

from __future__ import annotations

import re

_FREE = "CASE conv_id % 5 WHEN 0 THEN 'Fjord and Jester' WHEN 1 THEN 'beauregard' WHEN 2 THEN 'essek' WHEN 3 THEN ' Caleb ' ELSE 'jest' END"

VIEWS: dict[str, tuple[list[str], str]] = {
    "captions_k": ([], """
        SELECT printf('c2e%03d', conv_id) AS episode, 'vid' || CAST(conv_id AS VARCHAR) AS youtube_id,
               CAST(row_number() OVER w - 1 AS INTEGER) AS idx, line AS text,
               CAST(coalesce(sum(length(line)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / 16 AS start,
               CAST(length(line) AS DOUBLE) / 16 AS duration,
               conv_id, turn
        FROM (
            SELECT conv_id, turn, p - 1 AS pos,
                   CASE WHEN p = 1 THEN upper(role) || ': ' || l ELSE l END AS line
            FROM (SELECT conv_id, turn, role,
                         unnest(string_split(text, chr(10))) AS l,
                         generate_subscripts(string_split(text, chr(10)), 1) AS p
                  FROM conversations)
        )
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn, pos)
    """),
    "captions_v": (["captions_k"], """
        SELECT episode, youtube_id, idx, text, start, duration FROM captions_k
    """),
    "scenes_k": (["captions_k"], f"""
        SELECT printf('c2e%03d', c.conv_id) AS episode,
               CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS INTEGER) AS scene_id,
               CASE WHEN c.turn % 2 = 0 THEN lower(c.role) ELSE upper(c.role) END AS speaker,
               CASE WHEN c.role = 'system' THEN 'environment'
                    WHEN c.role = 'user' THEN CASE WHEN c.conv_id % 2 = 0 THEN 'fjord' ELSE 'Sam as Veth' END
                    WHEN c.turn % 3 = 0 THEN 'caduceus'
                    WHEN c.turn % 3 = 1 THEN 'matt'
                    ELSE {_FREE.replace('conv_id', 'c.conv_id')} END AS character,
               CAST(CASE WHEN c.role = 'system' THEN 0 ELSE 1 END AS INTEGER) AS in_game,
               substr(c.line, 1, c.part) AS background,
               substr(c.line, c.part + 1, c.part) AS action,
               substr(c.line, 2 * c.part + 1, c.part) AS object,
               substr(c.line, 3 * c.part + 1, c.part) AS poses,
               t.t0 + CAST((c.turn + 1) % 4 AS DOUBLE) * 40.0 AS start_time,
               t.t1 + CAST((c.turn + 1) % 4 AS DOUBLE) * 40.0 AS end_time,
               CASE WHEN c.turn % 5 = 3 THEN 'jester' WHEN c.turn % 5 = 4 THEN ' JESTER '
                    ELSE c.line END AS scene_description,
               c.conv_id, c.turn
        FROM (SELECT conv_id, turn, role, replace(text, chr(10), ' ') AS line, (length(text) + 3) // 4 AS part FROM conversations) c
        JOIN (SELECT conv_id, turn, min(start) AS t0, max(start + duration) AS t1
              FROM captions_k GROUP BY conv_id, turn) t
          ON c.conv_id = t.conv_id AND c.turn = t.turn
    """),
    "scenes_v": (["scenes_k"], """
        SELECT episode, scene_id, speaker, character, in_game, background, action, object, poses,
               start_time, end_time, scene_description FROM scenes_k
    """),
    "responses_v": (["scenes_k"], """
        SELECT episode, batch, 0 AS attempt,
               CASE WHEN v = 1 THEN '```json' || chr(10) || body || chr(10) || '```'
                    WHEN v = 2 THEN '{"scenes": [' || chr(10) || lines || chr(10) || '...' || chr(10) || ']}'
                    WHEN v = 6 THEN substr(body, 1, CAST(floor(length(body) / 2) AS INTEGER))
                    ELSE body END AS text
        FROM (
            SELECT episode, batch, v, lines, '{"scenes": [' || chr(10) || lines || chr(10) || ']}' AS body
            FROM (
                SELECT episode, conv_id, batch, (conv_id + batch) % 7 AS v,
                       string_agg(line, ',' || chr(10) ORDER BY scene_id) AS lines
                FROM (
                    SELECT episode, conv_id, batch, scene_id,
                           CASE WHEN v = 3 THEN '{' || chr(10) || 'character": '
                                WHEN v = 5 THEN '{"environment": "yes", "character": '
                                ELSE '{"character": ' END
                           || CASE WHEN scene_id % 7 = 6 THEN CAST(scene_id AS VARCHAR)
                                   ELSE '"' || esc(character) || '"' END
                           || ', "speaker": "' || esc(speaker)
                           || '", "in_game": ' || CASE WHEN scene_id % 5 = 2 THEN '"' || CAST(in_game AS VARCHAR) || '"'
                                                      WHEN scene_id % 5 = 4 THEN CAST(in_game AS VARCHAR) || '.5'
                                                      ELSE CAST(in_game AS VARCHAR) END
                           || ', "background": "' || esc(background)
                           || '", "action": "' || esc(action)
                           || '", "object": "' || esc(object)
                           || '", "poses": "' || esc(poses)
                           || '", "start_time": ' || CAST(start_time AS VARCHAR)
                           || ', ' || CASE WHEN v = 4 THEN '"endtime"' ELSE '"end_time"' END
                           || ': ' || CAST(end_time AS VARCHAR)
                           || ', "scene_description": "' || esc(scene_description) || '"}' AS line
                    FROM (SELECT *, CAST(floor(scene_id / 3) AS INTEGER) AS batch,
                                 (conv_id + CAST(floor(scene_id / 3) AS INTEGER)) % 7 AS v
                          FROM scenes_k)
                )
                GROUP BY episode, conv_id, batch
            )
        )
    """),
    "positions_v": ([], """
        SELECT event_id, user_id AS session,
               printf('c2e%03d', user_id % (SELECT count(DISTINCT conv_id) FROM conversations)) AS episode,
               value AS position,
               CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS INTEGER) AS event_type,
               CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts
        FROM events
    """),
    "instances_v": ([], """
        SELECT printf('inst%02d', page_id % 11) AS instance_name, url, page_id AS pos FROM pages
    """),
    "images_v": ([], """
        SELECT doc_id AS id, printf('inst%02d', doc_id % 11) AS instance,
               CAST(256 + n_chars % 700 AS INTEGER) AS height,
               CAST(256 + (n_chars * 7) % 900 AS INTEGER) AS width,
               text AS content
        FROM documents
    """),
    "vectors_v": ([], """
        SELECT vec_id AS id, label, embedding AS v FROM embeddings
    """),
    "ragged_v": ([], """
        SELECT vec_id AS id, label, embedding[1:64 - label] AS v FROM embeddings
    """),
    "instcfg_v": (["instances_v"], """
        SELECT instance_name, 'instances/' || instance_name AS instance_data_root,
               'a photo of ' || instance_name AS instance_prompt,
               CASE WHEN CAST(substr(instance_name, 5, 2) AS INTEGER) % 2 = 0 THEN 'class/' || instance_name END AS class_data_root,
               CASE WHEN CAST(substr(instance_name, 5, 2) AS INTEGER) % 2 = 0 THEN 'a photo of a person' END AS class_prompt,
               CASE WHEN CAST(substr(instance_name, 5, 2) AS INTEGER) % 3 <> 0 THEN 'a picture of ' || instance_name END AS validation_prompt
        FROM (SELECT DISTINCT instance_name FROM instances_v)
    """),
    "artifacts_v": ([], """
        SELECT o_custkey AS owner, 'checkpoint-' || CAST(o_orderkey AS VARCHAR) AS path FROM orders
    """),
}



def _inline_esc(sql: str) -> str:
    # JSON string escaping for the hand-built responses (backslash, quote)
    return re.sub(r"esc\((\w+)\)", lambda m: f"replace(replace({m[1]}, '\\', '\\\\'), '\"', '\\\"')", sql)


VIEWS = {k: (deps, _inline_esc(body)) for k, (deps, body) in VIEWS.items()}


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in VIEWS[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql_str(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def with_views(
    sql: str, *names: str, extra: list[tuple[str, str]] | None = None, recursive: bool = False
) -> str:
    """Prefix ``sql`` with the CTEs for ``names`` (and their dependencies)."""
    ctes = [f"{n} AS ({VIEWS[n][1].strip()})" for n in _order(list(names))]
    ctes += [f"{n} AS ({body.strip()})" for n, body in (extra or [])]
    if not ctes:
        return sql.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + sql.strip()
