import random
import re
import tracemalloc

import numpy as np
import pytest

from cuesheet.llm import shingles, triejoin


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [word_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd EF gh ij kl é ñu".split()) + str(rng.randint(0, 30))
    common = [word() for _ in range(30)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(3, 90))]
        if g % 3 == 0:
            base += common  # a passage that many documents share
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            rows.append(rng.choice([" ", "\t", "\n  "]).join(own))
    rows += ["", None, " \t ", "one two", "ONE two", "one two three", rows[0].upper(), rows[0], "x " * 5000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("stars", [1])
def test_against_brute_force(spark, monkeypatch, stars):
    monkeypatch.setattr(triejoin, "GROUP", 3)  # many blocks; driver side
    rows = corpus(stars)
    rows += [rows[4], (None, rows[5][1]), (None, "only without an id"), (7000, "only without an id, not"), (4, rows[9][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, sig long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in triejoin.jaccard_components(df, stars).collect()), key=str)
    assert got == brute(rows)


def test_one_document_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (1, base + " x"), (2, "other words are here now"), (5, None), (6, ""), (2, "other words are here now"), (9, base)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    kept = triejoin.keep_first(df)
    assert kept.columns == ["doc_id", "text", "key"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 5, 6]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert triejoin.jaccard_components(df).count() == 0


def test_tree_walk_finds_the_linked_sets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        hub = np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64))
        sets = []
        for _ in range(rng.integers(0, 12)):
            s = hub if rng.random() < 0.7 else rng.integers(0, 60, 30).astype(np.uint64)
            s = np.setdiff1d(s, rng.choice(hub, rng.integers(0, 4)))
            s = np.union1d(s, rng.integers(0, 60, rng.integers(0, 4)).astype(np.uint64))
            if len(s):
                sets.append(s)
        want = [i for i, s in enumerate(sets) if triejoin.linked(len(np.intersect1d(s, hub)), len(s), len(hub))]
        assert sorted(triejoin.tree_links(hub, sets)) == want


def test_bitmap_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
        b = np.union1d(a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 90)).astype(np.uint64))
        if len(b):
            assert triejoin._distance(triejoin._bitmap(a), triejoin._bitmap(b)) <= len(np.setxor1d(a, b))


def test_words_of_long_texts_are_cut_between_words(monkeypatch):
    text = "Alpha beta  gamma\tdelta é " * 300
    (whole,) = shingles.word_hashes([text])
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 50)
    (pieces,) = shingles.word_hashes([text])
    assert (whole == pieces).all() and len(whole) == 1500
    a, b, c = shingles.word_hashes(["ab", None, "AB ab"])
    assert len(b) == 0 and (c == a[0]).all()


def test_one_row_stays_of_a_group_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " and one more"
    rows = [(None, text, "a"), (None, text, "b"), (None, near, "c"), (None, "", "d"), (None, None, "e"), (None, "", "f"), (7, "quite another text of its own", "g")]
    rows += [(None, "a second group " + text[:80], "h"), (3, "a second group " + text[:80], "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = triejoin.keep_first(df)
    assert got.columns == df.columns
    kept = sorted(r.source for r in got.collect())
    assert [s for s in kept if s in "defghi"] == ["d", "e", "f", "g", "i"]
    assert len([s for s in kept if s in "abc"]) == 1


def test_meeting_rows_are_those_of_two_nodes_or_more(spark):
    rng = np.random.default_rng(5)
    rows = [(int(t), int(s)) for t, s in zip(rng.integers(-40, 40, 300), rng.integers(0, 25, 300), strict=True)]
    rows += [(1000, 7)] * 9 + [(1001, s % 2) for s in range(9)] + [(1002 + i, 3) for i in range(12)]
    who = {t: {s for u, s in rows if u == t} for t, _ in rows}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # groups go over batches
    try:
        got = sorted(map(tuple, triejoin.meeting(spark.createDataFrame(rows, "token long, sig long")).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == sorted((t, s) for t, w in who.items() if len(w) > 1 for s in w)


@pytest.mark.parametrize("size", [3, 512])
def test_pairs_of_leading_groups_are_all_pairs_that_meet(spark, monkeypatch, size):
    """Groups within others go, and of the groups that a pair shares, its first one lists it: no pair is lost."""
    monkeypatch.setattr(triejoin, "GROUP", size)
    monkeypatch.setattr(triejoin, "NAMED", 3)
    rng = np.random.default_rng(6)
    who = {t: sorted({int(s) for s in rng.integers(0, 30, rng.integers(2, 14))}) for t in range(40)}
    who |= {100: list(range(50, 70)), 101: [50, 51], 102: list(range(52, 69))}
    who = {t: w for t, w in who.items() if len(w) > 1}
    nodes = [(s, 5, s, bytes(8)) for s in {s for w in who.values() for s in w}]
    nodes = spark.createDataFrame(nodes, "sig long, n long, rep long, bitmap binary")
    groups = spark.createDataFrame([(t, s, len(w)) for t, w in who.items() for s in w], "token long, sig long, nodes long")
    left, named = triejoin.leading(groups)
    assert not {101, 102} & {r.token for r in left.select("token").distinct().collect()}
    rows = left.selectExpr("*", "sig % 7 AS label")
    got = [(r.hub, r.sig) for r in triejoin.close_pairs(rows, nodes, named).collect()]
    want = {(a, b) for w in who.values() for a in w for b in w if a < b and a % 7 != b % 7}
    assert {(min(p), max(p)) for p in got} == want and len(got) == len(want)
    # the nearest rounds: a row per node at most
    near = [r.sig for r in triejoin.close_pairs(rows, nodes).collect()]
    assert len(near) == len(set(near)) and near


def test_bitmaps_rule_out_sets_that_are_far_from_linked():
    rng = np.random.default_rng(7)
    for _ in range(50):
        x = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        a, b = np.unique(x[:100]), np.unique(x[20:])  # 2 / 3 alike
        far = triejoin._distance(triejoin._bitmap(a), triejoin._bitmap(b))
        assert far * (triejoin.DEN + triejoin.NUM) > (len(a) + len(b)) * (triejoin.DEN - triejoin.NUM)


def test_shingling_holds_a_bounded_stretch_of_the_texts():
    texts = (" ".join(f"{w}x{i}" for w in range(1500)) for i in range(400))
    shingles._powers.cache_clear()
    tracemalloc.start()
    n = sum(len(s) for s in shingles.shingle_sets(texts))
    peak, _ = tracemalloc.get_traced_memory()[1], tracemalloc.stop()
    assert n == 400 * 1496 and peak < 20 << 20
