import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import topk


def brute(rows, k, is_query):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            seen[(i, tuple(math.floor(1024 * x) for x in v))] = None
    out = set()
    for q, a in seen:
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in seen if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def run(spark, rows, k=3, lists=2, block=16, mod=5):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, q int, score double")
    got = topk.top_k(df, F.col("vec_id") % mod == 0, k, lists, block).collect()
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in got}


@pytest.mark.parametrize("lists", [2, 3])
def test_against_brute_force(spark, lists):
    rng = np.random.default_rng(lists)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(12)]  # copies: ties go to smaller ids
    rows += [(200, None), (201, [None] * 8), (205, [float("nan")] * 8), (210, [float("inf")] + [0.0] * 7), (None, rows[0][1])]
    rows += [rows[5], (300, []), (305, [1.0, 2.0])]  # repeated, empty and short
    assert run(spark, rows, lists=lists) == brute(rows, 3, lambda i: i % 5 == 0)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.5])]
    assert run(spark, rows, k=10) == brute(rows, 10, lambda i: i % 5 == 0)
    assert run(spark, [(1, [1.0])]) == set()
    assert run(spark, []) == set()


def test_scores_beyond_doubles(spark):
    rows = [(0, [2.0**19, 1.0]), (1, [2.0**19, 2.0]), (2, [2.0**19, 3.0]), (5, [-(2.0**20), 1.0])]
    assert run(spark, rows, k=2) == brute(rows, 2, lambda i: i % 5 == 0)


def test_distinct_vectors_keep_k_plus_one_ids(spark):
    df = spark.createDataFrame([(i, [1.0]) for i in range(50)], "vec_id long, v array<double>")
    assert topk.distinct_vectors(df, 3).first().ids == [0, 1, 2, 3]


def test_one_id_with_several_vectors(spark):
    """Vectors of one id aren't added up."""
    rows = [(0, [1.0, 1.0]), (5, [100.0, 0.0]), (5, [0.0, 100.0]), (6, [60.0, 60.0]), (0, [3.0, 0.0]), (7, [0.0, 100.0])]
    for k in (1, 2, 5):
        assert run(spark, rows, k=k) == brute(rows, k, lambda i: i % 5 == 0)
    rng = np.random.default_rng(9)
    rows = [(i % 12, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(60)]
    assert run(spark, rows, k=4) == brute(rows, 4, lambda i: i % 5 == 0)
