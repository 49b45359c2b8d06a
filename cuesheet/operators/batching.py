"""Greedy size-bounded batching of turns (sequential per episode).

The batch a turn lands in depends on every earlier turn of its episode, so
the work is a scan: rows are hash-partitioned by episode, sorted inside the
partition, and streamed through ``mapInPandas`` chunk by chunk.  Only the
open batch is buffered (bounded by the text budget), never a whole episode.
Inside a chunk the loop runs once per *batch* using prefix sums and
``searchsorted``, not once per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.constants import DEFAULT_MAX_TEXT_LENGTH


def _assign(lens: np.ndarray, cur: int, cnt: int, b: int, limit: int):
    """Batch ids for one run of rows of a single episode, continuing state."""
    n = len(lens)
    out = np.empty(n, dtype=np.int32)
    csum = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    pos = 0
    while pos < n:
        # first row j >= pos whose addition overflows the open batch
        j = pos + int(np.searchsorted(csum[pos + 1:], limit - cur + csum[pos], side="right"))
        if j >= n:
            out[pos:] = b
            cur += int(csum[n] - csum[pos])
            cnt += n - pos
            break
        if j > pos:
            out[pos:j] = b
            cnt += j - pos
            cur += int(csum[j] - csum[pos])
        # row j overflows: close the open batch when it holds rows
        if cnt > 0:
            b += 1
            cur, cnt = 0, 0
            pos = j
            continue
        # empty batch and row j alone is over budget: it forms its own batch
        out[j] = b
        cur, cnt = int(lens[j]), 1
        pos = j + 1
    return out, cur, cnt, b


def _batcher(limit: int, emit_tail: bool, ep: str, len_col: str):
    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state_ep, cur, cnt, b = None, 0, 0, 0
        pending: list[pd.DataFrame] = []  # rows of the open batch of state_ep

        def flush_tail():
            if emit_tail and pending:
                yield pd.concat(pending, ignore_index=True)

        for chunk in chunks:
            if chunk.empty:
                continue
            eps = chunk[ep].to_numpy()
            cuts = np.flatnonzero(eps[1:] != eps[:-1]) + 1
            starts = np.concatenate([[0], cuts])
            ends = np.concatenate([cuts, [len(chunk)]])
            for s, e in zip(starts, ends):
                seg = chunk.iloc[s:e]
                if seg[ep].iat[0] != state_ep:
                    yield from flush_tail()
                    pending = []
                    state_ep, cur, cnt, b = seg[ep].iat[0], 0, 0, 0
                open_before = b
                ids, cur, cnt, b = _assign(seg[len_col].to_numpy(dtype=np.int64), cur, cnt, b, limit)
                seg = seg.drop(columns=[len_col]).assign(batch=ids)
                if b > open_before and pending:
                    # the batch that was open before this run is now closed
                    yield pd.concat(pending, ignore_index=True)
                    pending = []
                closed = seg[seg["batch"] < b]
                if len(closed):
                    yield closed
                pending.append(seg[seg["batch"] == b])
        yield from flush_tail()

    return run


def turn_batches(
    turns: DataFrame,
    max_text_length: int = DEFAULT_MAX_TEXT_LENGTH,
    emit_tail: bool = False,
    episode_col: str = "episode",
    idx_col: str = "idx",
    text_col: str = "text",
    num_partitions: int | None = None,
    strategy: str = "scan",
    block_rows: int = 1 << 16,
) -> DataFrame:
    """Add ``batch`` (0-based, dense per episode) to every turn kept.

    ``strategy``: ``"scan"`` streams each episode through one task (cheapest
    for ordinary episodes); ``"blocked"`` is the block-parallel form for very
    large episodes; ``"auto"`` decides per episode: episodes with more than
    ``4 * block_rows`` rows go the blocked way, the rest are scanned (the set
    of such episodes is tiny, so the semi/anti joins against it are cheap).

    Running text length per batch; a turn that would push the batch over
    ``max_text_length`` closes the batch first (an over-budget turn alone
    forms its own batch; no empty batch is produced).  The last, still open
    batch of each episode is dropped unless ``emit_tail``.
    """
    if strategy == "auto":
        big = turns.groupBy(episode_col).count().where(F.col("count") > 4 * block_rows).select(episode_col)
        small = turn_batches(turns.join(big, episode_col, "left_anti"), max_text_length, emit_tail, episode_col,
                             idx_col, text_col, num_partitions, "scan")
        large = turn_batches_blocked(turns.join(big, episode_col, "left_semi"), max_text_length, emit_tail,
                                     episode_col, idx_col, text_col, block_rows)
        return small.unionByName(large)
    if strategy == "blocked":
        return turn_batches_blocked(turns, max_text_length, emit_tail, episode_col, idx_col, text_col, block_rows)
    if strategy != "scan":
        raise ValueError("strategy must be 'scan', 'blocked' or 'auto'")
    len_col = "__len"
    d = turns.withColumn(len_col, F.length(text_col).cast("long"))
    # key-only repartition: AQE may coalesce small partitions
    d = d.repartition(num_partitions, episode_col) if num_partitions else d.repartition(episode_col)
    d = d.sortWithinPartitions(episode_col, idx_col)
    schema = T.StructType([f for f in turns.schema.fields] + [T.StructField("batch", T.IntegerType())])
    return d.mapInPandas(_batcher(int(max_text_length), emit_tail, episode_col, len_col), schema)


# ---------------------------------------------------------------------------
# Block-parallel form: exact, and parallel inside one large episode.
#
# After an episode's first row the batcher state is the open batch's running
# length ``cur``.  A block's outcome depends on its entry ``cur`` only through
# the row where its first close happens: the first row j with
# ``cur + P_j > limit`` (P = prefix length inside the block).  Per block we
# tabulate, for every candidate first-close row (one per distinct P value up to
# the budget, so at most limit + 1 entries), the exit state and the number of
# closes; a streaming pass over these small tables in block order yields every
# block's entry state; a last parallel pass assigns batch ids inside blocks.
# ---------------------------------------------------------------------------

_SUMMARY_SCHEMA = (
    "episode string, block long, total long, first_exit long, first_closes long, "
    "cand_p array<long>, cand_exit array<long>, cand_closes array<long>"
)
_ENTRY_SCHEMA = "episode string, block long, in_cur long, in_batch long, in_started boolean"


def _chain_table(lens: np.ndarray, limit: int):
    """Memoized (exit cur, closes to block end) for rows taken as batch starts."""
    n = len(lens)
    csum = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    exit_cur = np.full(n, -1, dtype=np.int64)
    closes = np.zeros(n, dtype=np.int64)

    def nxt(r: int) -> int:
        # first row k > r with csum[k + 1] - csum[r] > limit (n when none)
        return r + 1 + int(np.searchsorted(csum[r + 2:], csum[r] + limit, side="right"))

    def solve(r: int) -> None:
        path = []
        while r < n and exit_cur[r] < 0:
            k = nxt(r)
            if k >= n:
                exit_cur[r] = csum[n] - csum[r]
                closes[r] = 0
                break
            path.append((r, k))
            r = k
        for p, k in reversed(path):
            exit_cur[p] = exit_cur[k]
            closes[p] = closes[k] + 1

    return solve, exit_cur, closes, csum


def _block_summary(limit: int):
    def run(key, g):
        g = g.sort_values("__idx")
        lens = g["__len"].to_numpy(dtype=np.int64)
        solve, exit_cur, closes, csum = _chain_table(lens, limit)
        p = csum[1:]
        # candidate first-close rows: the first row of each distinct prefix value,
        # up to the first row whose prefix exceeds the budget
        last = min(int(np.searchsorted(p, limit, side="right")), len(lens) - 1)
        cand = [j for j in range(last + 1) if j == 0 or p[j] > p[j - 1]]
        for j in [0, *cand]:
            solve(j)
        return pd.DataFrame([{
            "episode": key[0], "block": int(key[1]), "total": int(csum[-1]),
            "first_exit": int(exit_cur[0]), "first_closes": int(closes[0]),
            "cand_p": [int(p[j]) for j in cand], "cand_exit": [int(exit_cur[j]) for j in cand],
            "cand_closes": [int(closes[j]) for j in cand],
        }])
    return run


def _block_entries(limit: int):
    """Stream block tables in (episode, block) order; emit each block's entry
    state and, per episode, a block ``-1`` row holding the final open batch."""
    def run(it):
        ep_cur, cur, b, started = None, 0, 0, False
        for pdf in it:
            rows = []
            for ep, blk, total, fexit, fcl, cp, cx, cc in pdf[
                ["episode", "block", "total", "first_exit", "first_closes", "cand_p", "cand_exit", "cand_closes"]
            ].itertuples(index=False):
                if ep != ep_cur:
                    if ep_cur is not None:
                        rows.append((ep_cur, -1, cur, b, True))
                    ep_cur, cur, b, started = ep, 0, 0, False
                rows.append((ep, int(blk), int(cur), int(b), started))
                if not started:
                    cur, b, started = int(fexit), b + int(fcl), True
                elif cur + int(total) <= limit:
                    cur += int(total)
                else:
                    k = int(np.searchsorted(np.asarray(cp, dtype=np.int64), limit - cur, side="right"))
                    cur, b = int(cx[k]), b + 1 + int(cc[k])
            if rows:
                yield pd.DataFrame(rows, columns=["episode", "block", "in_cur", "in_batch", "in_started"])
        if ep_cur is not None:
            yield pd.DataFrame([(ep_cur, -1, cur, b, True)],
                               columns=["episode", "block", "in_cur", "in_batch", "in_started"])
    return run


def _block_assign(limit: int, cols: list[str], emit_tail: bool):
    def run(key, g):
        g = g.sort_values("__idx")
        cnt = 1 if bool(g["in_started"].iat[0]) else 0
        ids, _, _, _ = _assign(g["__len"].to_numpy(dtype=np.int64), int(g["in_cur"].iat[0]), cnt,
                               int(g["in_batch"].iat[0]), limit)
        out = g[cols].assign(batch=ids)
        if not emit_tail:
            out = out[out["batch"] < int(g["tail"].iat[0])]
        return out
    return run


def turn_batches_blocked(
    turns: DataFrame,
    max_text_length: int = DEFAULT_MAX_TEXT_LENGTH,
    emit_tail: bool = False,
    episode_col: str = "episode",
    idx_col: str = "idx",
    text_col: str = "text",
    block_rows: int = 1 << 16,
) -> DataFrame:
    """Same result as :func:`turn_batches`, computed block-parallel.

    Rows are ordered by ``idx`` inside an episode; blocks are
    ``idx // block_rows``, so one block (and one pandas group) is bounded by
    ``block_rows``.  Block tables carry at most ``max_text_length + 1``
    entries and are streamed in block order; a hot episode is spread over its
    blocks in the two heavy passes.
    """
    limit = int(max_text_length)
    cols = turns.columns
    d = turns.select(
        "*",
        F.col(episode_col).alias("__ep"), F.col(idx_col).alias("__idx"),
        F.floor(F.col(idx_col) / F.lit(block_rows)).alias("__blk"),
        F.length(text_col).cast("long").alias("__len"),
    )
    summ = d.select("__ep", "__blk", "__idx", "__len").groupBy("__ep", "__blk").applyInPandas(
        _block_summary(limit), _SUMMARY_SCHEMA
    )
    entries = summ.repartition("episode").sortWithinPartitions("episode", "block").mapInPandas(
        _block_entries(limit), _ENTRY_SCHEMA
    )
    tails = entries.where(F.col("block") == -1).select(F.col("episode").alias("__ep"), F.col("in_batch").alias("tail"))
    starts = entries.where(F.col("block") >= 0).select(
        F.col("episode").alias("__ep"), F.col("block").alias("__blk"), "in_cur", "in_batch", "in_started"
    )
    rows = d.join(starts, ["__ep", "__blk"]).join(tails, "__ep")
    schema = T.StructType([f for f in turns.schema.fields] + [T.StructField("batch", T.IntegerType())])
    return rows.groupBy("__ep", "__blk").applyInPandas(_block_assign(limit, cols, emit_tail), schema)
