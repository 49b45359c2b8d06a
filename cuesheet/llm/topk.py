"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's score against a query is the sum of partial scores over ``lists``
blocks of its components.  Each node (a Spark task over one stretch of the
vectors) works on these partial score lists:

1. every node sends its best partial scores per query and list; the exact
   scores of what was sent give each query a safe cutoff, its k-th best score
   so far;
2. the cutoff goes out, and nodes send every entry with a partial score of at
   least cutoff / lists.  A vector that reaches the cutoff has such an entry,
   for otherwise its parts would sum to less;
3. what was sent gives lower and upper bounds; vectors whose upper bound
   reaches the k-th best lower bound get their exact scores.

Queries are taken in blocks of bounded size; a block is what is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.sinks.files import materialize

SCALE = 1024
QUERY_BLOCK = 1024
EXACT = 2.0**53


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: components floor(scale * x) as whole doubles.

    Rows without a vec_id, with a null vector, or with a null or non-finite
    component take no part.  Equal rows count once.
    """
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("double"))
    finite: Column = F.forall(
        "embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf")))
    )
    return (
        vectors.select(F.col("vec_id").cast("long"), "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
        .select("vec_id", x.alias("v"))
    )


def distinct_vectors(base: DataFrame, k: int) -> DataFrame:
    """``vid, ids, v``: each distinct vector, numbered (for good once the result is written), with its k + 1 smallest ids.

    Ties go to smaller ids and a query leaves out only itself, so no further id
    of the same vector can be in a result; large groups of copies shrink to
    k + 1 ids before the shuffle (the rank limit runs on the map side first).
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = base.distinct().withColumn("rank", rank).where(F.col("rank") <= k + 1)
    ids = kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return ids.select(F.monotonically_increasing_id().alias("vid"), "ids", "v")


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array, padded with zeros or cut to ``width``."""
    lengths = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    at = 0
    for i, n in enumerate(lengths):
        out[i, : min(n, width)] = flat[at : at + min(n, width)]
        at += n
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """queries x rows inner products: doubles while exact, else Python integers."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)))
    if np.abs(queries).max() * np.abs(rows).max() * queries.shape[1] < EXACT:
        return queries @ rows.T
    whole = np.vectorize(int, otypes=[object])
    return whole(queries) @ whole(rows).T


def _long(scores: np.ndarray) -> np.ndarray:
    top = 2**63 - 1
    if scores.dtype == object:
        return np.array([max(-top, min(top, int(x))) for x in scores], dtype=np.int64)
    return scores.astype(np.int64)


ENTRIES = "q int, vid long, list int, score long"


def _entries(q, vid, which, score) -> pa.RecordBatch:
    cols = [pa.array(q, pa.int32()), pa.array(vid, pa.int64()), pa.array(which, pa.int32()), pa.array(score, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["q", "vid", "list", "score"])


def _parts(width: int, lists: int) -> list[slice]:
    cuts = [round(i * width / lists) for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def local_tops(vectors: DataFrame, queries, lists: int, k: int) -> DataFrame:
    """Phase 1 at the nodes: the k best entries per query and list that a task has seen."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        parts = _parts(q.shape[1], lists)
        best: list = [None] * lists
        for batch in batches:
            vid, rows = batch.column(0).to_numpy(), _matrix(batch.column(1), q.shape[1])
            for j, part in enumerate(parts):
                score = _products(q[:, part], rows[:, part])
                ids = np.broadcast_to(vid, score.shape)
                if best[j] is not None:
                    ids, score = np.hstack([best[j][0], ids]), np.hstack([best[j][1], score])
                if score.shape[1] > k:
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    ids, score = np.take_along_axis(ids, top, 1), np.take_along_axis(score, top, 1)
                best[j] = (ids, score)
        for j, held in enumerate(best):
            if held is not None:
                ids, score = held
                n, m = score.shape
                yield _entries(np.repeat(np.arange(n), m), ids.ravel(), np.full(n * m, j), _long(score.ravel()))

    return vectors.select("vid", "v").mapInArrow(run, ENTRIES)


def entries_above(vectors: DataFrame, queries, cutoff: np.ndarray, lists: int) -> DataFrame:
    """Phase 2 at the nodes: every entry with lists * partial score >= the query's cutoff."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, cutoff))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, low = shared.value
        for batch in batches:
            vid, rows = batch.column(0).to_numpy(), _matrix(batch.column(1), q.shape[1])
            for j, part in enumerate(_parts(q.shape[1], lists)):
                score = _products(q[:, part], rows[:, part])
                at, row = np.nonzero(score * lists >= low[:, None])
                yield _entries(at, vid[row], np.full(len(at), j), _long(score[at, row]))

    return vectors.select("vid", "v").mapInArrow(run, ENTRIES)


def _exact(pairs: DataFrame, vectors: DataFrame, queries: np.ndarray) -> DataFrame:
    """``q, vid, ids, score``: exact scores of (q, vid) pairs."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            at, rows = batch.column(0).to_numpy(), _matrix(batch.column(3), q.shape[1])
            own = q[at]
            if own.size and np.abs(own).max() * np.abs(rows).max() * q.shape[1] >= EXACT:
                score = np.array([_products(a[None], b[None])[0, 0] for a, b in zip(own, rows, strict=True)], dtype=object)
            else:
                score = (own * rows).sum(axis=1)
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(_long(score), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["q", "vid", "ids", "score"])

    joined = pairs.join(vectors, "vid").select("q", "vid", "ids", "v")
    return joined.mapInArrow(run, "q int, vid long, ids array<long>, score long")


def _ranked(scored: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """Best k rows per query of ``q, ids, score``, ties to smaller ids, the query itself left out."""
    each = (
        scored.join(F.broadcast(names), "q")  # one row per query of the block
        .select("q", "query_id", F.explode("ids").alias("vec_id"), "score")
        .where(F.col("vec_id") != F.col("query_id"))
    )
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


def _floor_of(ranked: DataFrame, n: int, k: int) -> np.ndarray:
    """Per query of a block its k-th score, or minus infinity; a row per query comes to the driver."""
    low = np.full(n, -np.inf)
    for r in ranked.where(F.col("rank") == k).select("q", "score").collect():
        low[r["q"]] = float(r["score"]) if abs(r["score"]) < EXACT else np.nextafter(float(r["score"]), -np.inf)
    return low


def search_block(vectors: DataFrame, block: list, k: int, lists: int) -> DataFrame:
    """The three phases for one block of (query_id, components)."""
    spark = vectors.sparkSession
    width = max(len(v) for _, v in block)
    queries = np.zeros((len(block), width))
    for i, (_, v) in enumerate(block):
        queries[i, : len(v)] = v
    names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], "q int, query_id long")

    # Phase 1.  k + 1 entries a list, as one may be the query itself.
    order = Window.partitionBy("q", "list").orderBy(F.col("score").desc(), "vid")
    tops = local_tops(vectors, queries, lists, k + 1).withColumn("rank", F.row_number().over(order))
    sent = tops.where(F.col("rank") <= k + 1).select("q", "vid").distinct()
    first = _ranked(_exact(sent, vectors, queries), names, k)
    cutoff = _floor_of(first, len(block), k)

    # Phase 2.  Parts that a node hasn't sent are below cutoff / lists.
    seen = entries_above(vectors, queries, cutoff, lists)
    summed = seen.groupBy("q", "vid").agg(F.sum(F.col("score").cast("decimal(20,0)")).alias("part"), F.count(F.lit(1)).alias("lists_seen"))
    sums = materialize(summed, "sums")

    # Phase 3.  A sum over all lists is an exact score, so these raise the cutoff.
    order = Window.partitionBy("q").orderBy(F.col("part").desc(), "vid")
    # A vector under a query's own id may have no other id, so it doesn't count here.
    own = vectors.select("vid", F.explode("ids").alias("query_id")).join(F.broadcast(names), "query_id").select("q", "vid")
    whole = sums.where(F.col("lists_seen") == lists).join(own, ["q", "vid"], "left_anti")
    again = _floor_of(whole.withColumn("rank", F.row_number().over(order)).withColumnRenamed("part", "score"), len(block), k)
    bounds = [(i, *(None if math.isinf(x) else float(x) for x in pair)) for i, pair in enumerate(zip(cutoff, np.fmax(cutoff, again)))]
    low = spark.createDataFrame(bounds, "q int, sent double, low double")
    upper = F.col("part") + (F.lit(lists) - F.col("lists_seen")) * F.col("sent") / F.lit(lists)
    open_ = sums.join(F.broadcast(low), "q").where(F.col("low").isNull() | (upper >= F.col("low"))).select("q", "vid")
    return _ranked(_exact(open_, vectors, queries), names, k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, lists: int = 2, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best other vectors.

    ``vectors``: vec_id, embedding (other columns are ignored); ``is_query``
    selects the queries by vec_id.  Scores are inner products of the scaled
    whole components; a shorter vector counts as padded with zeros; scores
    beyond a long are held at its ends.  Ties go to the smaller vec_id.  A
    repeated row counts once; rows of one vec_id with different vectors are
    candidates (and queries) each.  Fewer than k other vectors: all of them.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    base = quantized(vectors)
    table = materialize(distinct_vectors(base, k), "vectors")
    asked = materialize(base.where(is_query).distinct(), "queries")
    blocks = max(1, math.ceil(asked.count() / query_block))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if block:
            part = search_block(table, [(r["vec_id"], r["v"]) for r in sorted(block)], k, lists)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found
