import math
import random
from collections import Counter

import pytest

from cuesheet.llm import lmscore
from cuesheet.llm.queries import op4_cross_entropy_difference

DOCS = [
    (1, "the cat sat on the mat"), (2, "The cat ate the rat"), (3, "stock prices fell on monday"), (4, "prices of stock rose"),
    (5, None), (6, ""), (7, " \t\n"), (8, "the cat " * 3000), (9, "zebra"), (None, "the rat sat"), (4, "prices of stock rose"),
]


def brute(docs, targets, size):
    words = [(d, (t or "").lower().split()) for d, t in docs]
    counts = Counter(w for _, ws in words for w in ws)
    vocab = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:size]]

    def model(rows, scale):
        pairs = Counter()
        for ws in rows:
            coded = [w if w in vocab else "?" for w in ws]
            pairs.update(zip(["^", *coded], coded, strict=False))
        pairs = {k: n * scale for k, n in pairs.items()}
        uni, prev, total = Counter(), Counter(), sum(pairs.values())
        for (v, w), n in pairs.items():
            uni[w] += n
            prev[v] += n

        def loss(v, w):
            p = (uni[w] + 1) / (total + len(vocab) + 1)
            return -math.log((pairs.get((v, w), 0) + 16 * p) / (prev[v] + 16))

        return loss

    target = [ws for d, ws in words if d in targets]
    everything = [ws for _, ws in words]
    t = model(target, 1.0)
    b = model(everything, sum(map(len, target)) / sum(map(len, everything)))
    out = []
    for d, ws in words:
        coded = [w if w in vocab else "?" for w in ws]
        steps = list(zip(["^", *coded], coded, strict=False))
        mean = lambda f: sum(f(*s) for s in steps) / len(steps) if steps else None  # noqa: B023, E731
        out.append((d, len(ws), mean(t), mean(b)))
    return out


@pytest.mark.parametrize(("size", "targets"), [(5, {1, 2}), (1000, {3, 4}), (6, {77})])
def test_against_brute_force(spark, size, targets):
    df = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, difference int")
    ids = spark.createDataFrame([(i, "x") for i in [*targets, *targets, None]], "doc_id long, text string")
    got = lmscore.score(df, lmscore.fit(df, ids, size))
    assert got.columns == ["doc_id", "text", "n_tokens", "target_loss", "background_loss", "difference"]
    key = lambda r: (str(r[0]), r[1])
    rows = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.difference) for r in got.collect()), key=key)
    for r, w in zip(rows, sorted(brute(DOCS, targets, size), key=key), strict=True):
        assert r[:2] == w[:2]
        if w[2] is None:
            assert r[2:] == (None, None, None)
        else:
            assert r[2] == pytest.approx(w[2]) and r[3] == pytest.approx(w[3]) and r[4] == pytest.approx(w[2] - w[3])


def test_the_score_tells_the_target_apart(spark):
    df = spark.createDataFrame(DOCS[:4], "doc_id long, text string")
    models = lmscore.fit(df, df.where("doc_id = 1"))
    got = {r.doc_id: r.difference for r in lmscore.score(df, models).collect()}
    assert got[1] < got[2] < min(got[3], got[4])


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lmscore.score(df, lmscore.fit(df, df)).count() == 0


def test_the_query_knows_every_word(spark, tmp_path):
    rng = random.Random(6)
    common, rare = [f"c{i}" for i in range(1023)], [f"r{i}" for i in range(1500)]
    docs = [(i, " ".join(common)) for i in range(4)]
    docs += [(10 + i, " ".join(rng.choices(common, k=20) + rng.choices(rare, k=rng.randint(0, 15)) + ["R7", "c3", "r7"] * (i % 3))) for i in range(60)]
    docs += [(90, "only"), (90, "only"), (91, "r1 r1 r1 r1"), (92, None), (93, " "), (None, "r1 c1 r2"), (94, "r2 c5")]
    targets = {i for i in range(10, 95) if i % 4 == 0}
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1) for i in targets] + [(11, 0)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    key = lambda r: tuple(map(str, r[:2])) + (r[2] or 0,)
    got = sorted((tuple(r) for r in op4_cross_entropy_difference(spark, str(tmp_path)).collect()), key=key)
    for r, w in zip(got, sorted(brute(docs, targets, 10**9), key=key), strict=True):
        assert r[:2] == w[:2]
        assert r[2:] == ((None,) * 3 if w[2] is None else pytest.approx((w[2], w[3], w[2] - w[3]), abs=2e-6))


@pytest.mark.parametrize(("frequent", "targets"), [(0, {1, 2}), (3, {4}), (1023, {77})])
def test_every_word_at_any_number_of_frequent_ones(spark, frequent, targets):
    df = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, difference int")
    ids = spark.createDataFrame([(i, "x") for i in [*targets, None]], "doc_id long, text string")
    got = lmscore.score_corpus(df, ids, frequent=frequent)
    assert got.columns == ["doc_id", "text", "n_tokens", "target_loss", "background_loss", "difference"]
    key = lambda r: (str(r[0]), r[1], r[2] or 0)
    rows = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got.collect()), key=key)
    for r, w in zip(rows, sorted(brute(DOCS, targets, 10**9), key=key), strict=True):
        assert r[:2] == w[:2] and r[2:] == (w[2:] if w[2] is None else pytest.approx(w[2:]))


def test_every_word_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lmscore.score_corpus(df, df).count() == 0
