import random

import numpy as np
import pytest

from cuesheet.llm import decontam
from cuesheet.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def brute(text, item):
    """Whether a piece of the item occurs in the text within its edit budget, by full dynamic programming."""
    codes, own = decontam.normalised(text), decontam.normalised(item)
    if len(own) < decontam.MIN_CHARS:
        return False
    for a, b in decontam.pieces(len(own)):
        budget = min(int(decontam.EDITS * (b - a)), (b - a) // decontam.Q - 1)
        row = np.zeros(len(codes) + 1, np.int64)
        for i, c in enumerate(own[a:b]):
            step = np.concatenate([[i + 1], np.minimum(row[:-1] + (codes != c), row[1:] + 1)])
            at = np.arange(len(step))
            row = np.minimum.accumulate(step - at) + at
        if row.min() <= budget:
            return True
    return False


def damaged(rng, text, rate):
    out = list(text)
    for _ in range(int(len(text) * rate)):
        j, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.33:
            out[j] = rng.choice("abcdet é")
        elif kind < 0.66:
            out.insert(j, rng.choice("abcdet é"))
        elif len(out) > 1:
            out.pop(j)
    return "".join(out)


@pytest.fixture(scope="module")
def tables(spark):
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").orderBy("item_id").collect()]
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()]
    return items, docs


def test_against_brute_force(tables):
    items, docs = tables
    rng, index, hits = random.Random(4), decontam.Index(items), 0
    for trial in range(120):
        item_id, text = rng.choice(items)
        if trial % 2:
            a = rng.randrange(len(text) // 2)
            text = text[a : a + rng.randint(60, 160)]
        text = damaged(rng, text, rng.choice([0, 0.02, 0.05, 0.08, 0.12]))
        doc = rng.choice(docs)[1][:500] + " " + text.upper() + "\n\n" + rng.choice(docs)[1][:300]
        found = {x["item_id"]: x for x in index.search(doc)}
        want = brute(doc, dict(items)[item_id])
        hits += want
        assert (item_id in found) == want
        if want:
            assert 0 <= found[item_id]["first"] < found[item_id]["last"] <= len(decontam.normalised(doc))
    assert 20 < hits < 110


def test_chunks_find_what_the_whole_text_holds(tables, monkeypatch):
    items, docs = tables
    index = decontam.Index(items)
    doc = " ".join(t for _, t in docs[:10]) + " " + items[7][1] + " " + docs[11][1]
    whole = index.search(doc)
    monkeypatch.setattr(decontam, "CHUNK_CHARS", 97)
    assert {x["item_id"] for x in index.search(doc)} == {x["item_id"] for x in whole} and len(whole) >= 1


@pytest.mark.parametrize("block_chars", [500, 1 << 21])
def test_documents(spark, tables, monkeypatch, block_chars):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block_chars)  # several blocks, on the driver
    items, _ = tables
    bench = [*items[:12], (None, items[20][1]), (900, None), (901, "short"), (902, "sixteen letters!"), (3, items[3][1])]
    rows = [(1, items[3][1] + " tail"), (1, items[3][1] + " tail"), (2, None), (3, ""), (4, "sixteen  LETTERS! " * 3), (None, items[5][1]), (6, "nothing here"), (7, items[20][1])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, item_id long")
    b = spark.createDataFrame([(*r, "x") for r in bench], "item_id long, text string, doc_id string")
    out = decontam.find_leaks(df, b)
    assert out.columns == ["doc_id", "text", "item_id", "leaks"]
    got = [(r.doc_id, sorted(x["item_id"] for x in r.leaks)) for r in out.collect()]
    assert got == [(1, [3]), (1, [3]), (2, []), (3, []), (4, [902]), (None, [5]), (6, []), (7, [])]


def test_empty_tables(spark, tables):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(df, none).first().leaks == []
    assert decontam.find_leaks(df.limit(0), spark.createDataFrame(tables[0], "item_id long, text string")).count() == 0
