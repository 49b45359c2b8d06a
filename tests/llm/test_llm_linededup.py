import random

import pytest

from cuesheet.llm import linededup


def brute(rows, least):
    """Delete, line by line, what lies in a run of ``least`` words or more that occurs earlier and apart."""
    docs = []
    for d, t in rows:
        lines = (t or "").split("\n")
        norm = [" ".join(linededup.line_words(x.encode()) and [w.decode() for w in linededup.line_words(x.encode())]) for x in lines]
        docs.append((d, lines, [(i, n) for i, n in enumerate(norm) if n]))
    first, gone = {}, [set() for _ in docs]
    runs = []
    for k, (_, _, own) in enumerate(docs):
        for a in range(len(own)):
            for b in range(a, len(own)):
                run = tuple(n for _, n in own[a : b + 1])
                if sum(len(n.split()) for n in run) >= least:
                    runs.append((k, own[a][0], own[b][0], run))
    for k, a, b, run in runs:
        first.setdefault(run, (k, a, b))
    for k, a, b, run in runs:
        fk, _, fb = first[run]
        if k > fk or a > fb:
            gone[k].update(range(a, b + 1))
    return [None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in g) for (_, t), (_, lines, _), g in zip(rows, docs, gone, strict=True)]


def run(spark, rows, least):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, a int, key string")
    out = linededup.dedup_lines(df, least)
    assert out.columns == ["doc_id", "text", "a", "key", "removed"]
    return out.collect()


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices(["a", "B", "cé", "dd"], k=rng.randint(0, 6))) for _ in range(14)] + ["", "  ", "\ta  b "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, rows[3][1]), (53, rows[3][1].upper())]
    got = {r.doc_id: r.text for r in run(spark, rows, 9)}
    assert [got[d] for d, _ in rows] == brute(rows, 9)


def test_runs_spans_and_repeats(spark):
    shared = "\n".join(f"line {i} of a long passage with words" for i in range(8))  # 64 words
    rows = [
        (1, f"own start\n{shared}\nown end"), (2, f"other\n\n{shared}"), (3, shared.replace("line 4", "Line  4")),
        (4, "line 0 of a long passage with words"), (4, "line 0 of a long passage with words"),  # too short to go
        (5, f"{shared}\n{shared}"), (None, shared), (9, f"a {shared}"), (1, f"own start\n{shared}\nown end"),
    ]
    got = run(spark, rows, 50)
    texts = sorted((str(r.doc_id), r.text) for r in got)
    assert texts == sorted([
        ("1", rows[0][1]), ("1", rows[0][1]), ("2", "other\n"), ("3", ""), ("4", rows[3][1]), ("4", rows[3][1]),
        ("5", ""), ("None", ""), ("9", "a line 0 of a long passage with words"),
    ])
    spans = {r.doc_id: [(s["first"], s["last"]) for s in r.removed] for r in got}
    assert spans[2] == [(2, 9)] and spans[1] == [] and spans[5] == [(0, 15)] and spans[9] == [(1, 7)]


def test_periodic_lines_keep_their_first_run(spark):
    (r,) = run(spark, [(1, "\n".join(["ten words " * 5] * 7))], 20)
    assert r.text.count("\n") == 1 and [tuple(s) for s in r.removed] == [(2, 6)]


def test_empty_table_and_long_text(spark):
    assert run(spark, [], 50) == []
    text = "\n".join(f"w{i} x y" for i in range(30_000))
    got = run(spark, [(1, text), (2, text)], 50)
    assert {r.doc_id: len(r.text) for r in got} == {1: len(text), 2: 0}
