import numpy as np
import pytest

from cuesheet.llm import whitening
from cuesheet.llm.queries import op11_bitsliced_whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in rows], SCHEMA)


def brute(rows, k=16):
    """The contract, row by row, in Python integers and numpy."""
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if usable(v)]
    fit = [list(x) for x in {tuple(x) for _, x in kept}]
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[n * x[j] - sums[j] for j in range(d)] for x in fit], object)
    cov = ((centred.T @ centred) / n**3).astype(float)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    out = {}
    for i, x in kept:
        off = np.array([n * x[j] - sums[j] for j in range(d)], object)
        out.setdefault(i, []).append((int((off**2).sum()), (off.astype(float) / n) @ vectors[:, order] / np.sqrt(values[order])))
    return n, out, values[order] / np.trace(cov)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)


def test_sums_of_bit_planes_are_exact():
    rng = np.random.default_rng(3)
    for low, high, shape in ((-40, 40, (500, 9)), (-(2**40), 2**40, (70, 3)), (5, 6, (3, 2)), (0, 2, (64, 4)), (-1, 1, (1, 5))):
        z = rng.integers(low, high, shape)
        sums, products = whitening.block_sums(z)
        exact = z.astype(object)
        assert (sums == exact.sum(axis=0)).all() and (products == exact.T @ exact).all()


def test_equals_brute_force_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(7, rows[3][1]), (7, rows[4][1])]
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 20), (2003, [None] + [0.5] * 19), (2004, [float("inf")] * 20), (None, rows[5][1])]
    rows.append((2005, [0.25] * 3))  # of another length than most
    df = frame(spark, rows).repartition(5)
    model = whitening.fit(df)
    n, want, explained = brute([r for r in rows if r[0] != 2005])
    assert model.n == n == 200 and model.identity_error < 1e-9
    assert np.allclose(model.explained, explained, rtol=1e-9)
    got = whitening.whiten(df, model)
    assert got.columns == ["vec_id", "embedding", "component", "n", "deviation", "whitened", "explained"]
    found = {}
    for r in got.collect():
        assert r.n == n and abs(r.explained - explained[r.component - 1]) < 1e-9
        found.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r.whitened)
    assert {k for k, _ in found} == set(want) and sum(len(x[1]) for x in found.values()) == 506 - 3
    sign = None
    for (i, deviation), parts in found.items():
        w = next(w for d, w in want[i] if d == deviation)
        mine = np.array([parts[c][0] for c in range(1, 17)])
        sign = np.sign(mine * w) if sign is None else sign
        assert np.allclose(mine, sign * w, atol=1e-8)


def test_no_variance_and_no_rows(spark):
    same = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    got = whitening.whiten(same, whitening.fit(same)).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation) for r in got] == [(c, None, None, 0) for c in (1, 2)] * 2
    line = frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])])
    got = whitening.whiten(line, whitening.fit(line)).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in got] == [False, True] * 2 and abs(abs(got[0].whitened) - 1) < 1e-12
    empty = frame(spark, [(1, None)])
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).count() == 0
    with pytest.raises(Exception, match="too large"):
        whitening.fit(frame(spark, [(1, [1e30])]))


def test_query_over_the_whole_table(spark):
    got = op11_bitsliced_whitening(spark, "/root/testdata/sf0.001").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    n, want, explained = brute([(r.vec_id, r.embedding) for r in rows])
    assert len(got) == 16 * len(rows) and set(got.n) == {n} and got.identity_error.max() < 1e-4
    one = got[got.vec_id == rows[3].vec_id].sort_values("component")
    deviation, whitened = want[rows[3].vec_id][0]
    assert set(one.deviation) == {deviation} and np.allclose(np.abs(one.whitened), np.abs(whitened), atol=1e-7)
    assert np.allclose(one.explained, explained, rtol=1e-6)
