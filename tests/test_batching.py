from hypothesis import given, settings
from hypothesis import strategies as st

from cuesheet.operators.batching import turn_batches


def assert_greedy(lens, batches, limit, emit_tail):
    """Batches number consecutive rows from 0; each fits (or is one row) and none could take its next row."""
    kept = [batches[i] for i in range(len(batches))]
    assert kept == sorted(kept) and set(kept) == set(range(len(set(kept))))
    groups = [[i for i, b in enumerate(kept) if b == n] for n in range(len(set(kept)))]
    for g in groups:
        size = sum(lens[i] for i in g)
        assert size <= limit or len(g) == 1 or size - lens[g[-1]] == 0
        if g[-1] + 1 < len(lens):
            assert size + lens[g[-1] + 1] > limit
    if emit_tail:
        assert len(kept) == len(lens)
    else:  # what is left out is the open batch
        tail = lens[len(kept) :]
        assert tail and (sum(tail) <= limit or len(tail) == 1 or sum(tail[:-1]) == 0)


def _run(spark, episodes, limit, emit_tail=False):
    rows = [(ep, i, "x" * n) for ep, lens in episodes.items() for i, n in enumerate(lens)]
    df = spark.createDataFrame(rows, "episode string, idx int, text string")
    got = turn_batches(df, limit, emit_tail=emit_tail).collect()
    return {(r.episode, r.idx): r.batch for r in got}


def test_edges(spark):
    episodes = {
        "over_first": [12, 3, 4, 5],
        "over_middle": [3, 4, 20, 2, 2],
        "over_last": [3, 4, 30],
        "exact_fit": [5, 5, 10, 1],
        "one_row": [3],
        "zero_len": [0, 0, 11, 0],
    }
    closed = {
        "over_first": [0, 1, 1], "over_middle": [0, 0, 1], "over_last": [0, 0], "exact_fit": [0, 0, 1], "one_row": [], "zero_len": [0, 0, 1],
    }  # the rows after these form the open batch
    for tail in (False, True):
        got = _run(spark, episodes, 10, tail)
        for ep, lens in episodes.items():
            own = {i: b for (e, i), b in got.items() if e == ep}
            assert_greedy(lens, own, 10, tail)
            assert [own[i] for i in range(len(closed[ep]))] == closed[ep] and (tail or len(own) == len(closed[ep]))


def test_empty_input(spark):
    df = spark.createDataFrame([], "episode string, idx int, text string")
    assert turn_batches(df, 10).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.sampled_from(list("abcd")), st.lists(st.integers(0, 15), min_size=1, max_size=40), min_size=1),
       st.integers(1, 30))
def test_property(spark, episodes, limit):
    got = _run(spark, episodes, limit)
    for ep, lens in episodes.items():
        assert_greedy(lens, {i: b for (e, i), b in got.items() if e == ep}, limit, False)


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.sampled_from(list("abc")), st.lists(st.integers(0, 15), min_size=1, max_size=40), min_size=1),
       st.integers(1, 30), st.sampled_from([1, 2, 3, 7, 1000]), st.booleans())
def test_blocked_is_greedy(spark, episodes, limit, block_rows, tail):
    from cuesheet.operators.batching import turn_batches_blocked

    rows = [(ep, i, "x" * n) for ep, lens in episodes.items() for i, n in enumerate(lens)]
    df = spark.createDataFrame(rows, "episode string, idx int, text string")
    got = {(r.episode, r.idx): r.batch for r in turn_batches_blocked(df, limit, tail, block_rows=block_rows).collect()}
    for ep, lens in episodes.items():
        assert_greedy(lens, {i: b for (e, i), b in got.items() if e == ep}, limit, tail)


def test_strategies_agree(spark):
    episodes = {"a": [3, 9, 4, 12, 1, 1, 8, 2, 7, 5, 0, 6], "b": [20, 0, 5]}  # a > 4*block_rows: blocked under auto
    rows = [(ep, i, "x" * n) for ep, lens in episodes.items() for i, n in enumerate(lens)]
    df = spark.createDataFrame(rows, "episode string, idx int, text string")
    res = {}
    for strat in ("scan", "blocked", "auto"):
        res[strat] = sorted((r.episode, r.idx, r.batch) for r in turn_batches(df, 10, strategy=strat, block_rows=2).collect())
    assert res["scan"] == res["blocked"] == res["auto"]
