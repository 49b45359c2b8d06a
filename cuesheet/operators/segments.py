"""Lookups by time as one equi-join against disjoint winning segments.

Spark has no as-of or range join.  Rows with an interval and an anchor time are
turned into segments that never overlap: between two neighbouring ends or
anchors of a key, the intervals that hold a time and the anchors next to it
stay the same.  A segment carries the winner (the interval of lowest rank that
holds it), how many intervals hold it, and, per kind of anchor, the last one
before and the first one after.  A probe meets exactly one segment, so a lookup
needs no candidate list and no aggregation afterwards.

Keys are cut into blocks at quantiles of their own starts, ends and anchors
(equi-depth: dense stretches get narrow blocks, an outlier changes nothing).
An interval is listed in the blocks where it begins and ends; the blocks between
get its rank from a dyadic decomposition (two nodes a level at most, reduced by
minimum before they are dealt out), so n nested intervals make at most 3 n + 1
segments, and one a block.  A sweep then walks each block on its own, with the
anchors beyond its borders carried in from a table of one row a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.sinks.files import materialize

BLOCK_ROWS = 128
PIECES = 256  # a key has at most 3 * PIECES blocks; beyond that they grow with its rows
_LEVELS = (3 * PIECES).bit_length()
# order of the rows of one place in the sweep
_BLOCK, _START, _END, _ANCHOR, _NEXT = range(5)


@dataclass
class Segments:
    """``index``: keys, block, lo, lo_open, hi, hi_closed, hit, overlap_count and, by anchor kind, prev_/next_ (t, a).

    ``bounds``: a row a key with its ``cuts`` and, of the intervals, ``first_start`` and ``last_end``.
    """

    index: DataFrame
    bounds: DataFrame
    keys: list[str]


def block_of(cuts: Column, t: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= t))


def _bounds(rows: DataFrame, keys: list[str], times: list[str], block_rows: int) -> DataFrame:
    shares = ", ".join(f"{i / PIECES}D" for i in range(1, PIECES))
    # a key of few rows gets few of the quantiles, one that fits a block none
    step = f"greatest(1, floor({PIECES * block_rows} / n))"
    some = ", ".join(f"filter(q_{t}, (_, i) -> (i + 1) % {step} = 0)" for t in times)
    first, last = (times[1], times[2]) if len(times) > 1 else (times[0], times[0])
    none = "cast(array() AS array<double>)"
    quantiles = [f"coalesce(percentile_approx(cast({t} AS double), array({shares})), {none}) AS q_{t}" for t in times]
    counts = ["count(1) AS n", f"min({first}) AS first_start", f"max({last}) AS last_end"]
    per = rows.groupBy(*keys).agg(*map(F.expr, counts + quantiles))
    cuts = f"CASE WHEN n > {block_rows} THEN array_sort(array_distinct(concat({some}))) ELSE {none} END AS cuts"
    return per.selectExpr(*map(_name, keys), "first_start", "last_end", cuts)


def _name(column: str) -> str:
    return f"`{column}`"


def _dyadic(first: str, last: str) -> str:
    """The fewest (level, node) whose blocks, 2^level from node * 2^level on, make up first..last."""
    none = "cast(array() AS array<struct<level:int,node:int>>)"
    odd, even = "(s.lo <= s.hi AND s.lo % 2 = 1)", "(s.lo <= s.hi AND s.hi % 2 = 0)"
    more = (
        f"CASE WHEN {odd} THEN array(struct(k AS level, s.lo AS node)) ELSE {none} END, "
        f"CASE WHEN {even} THEN array(struct(k AS level, s.hi AS node)) ELSE {none} END"
    )
    # an odd lo stands alone at its level, and so does an even hi; the rest is halved, and nothing stays nothing
    lo = f"if(s.lo > s.hi, s.lo, shiftright(s.lo + if({odd}, 1, 0), 1)) AS lo"
    hi = f"if(s.lo > s.hi, s.hi, shiftright(s.hi - if({even}, 1, 0), 1)) AS hi"
    start = f"struct(int({first}) AS lo, int({last}) AS hi, {none} AS nodes)"
    return f"aggregate(sequence(0, {_LEVELS}), {start}, (s, k) -> struct({lo}, {hi}, concat(s.nodes, {more}) AS nodes)).nodes"


def build_segments(
    rows: DataFrame,
    keys: Sequence[str],
    anchor: str,
    rank: str,
    payload: Sequence[str],
    kinds: dict[str, Column] | None = None,
    interval: tuple[str, str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> Segments:
    """The segments of ``rows``: see the module.

    ``anchor`` is the time column of the nearest-anchor lookups, ``kinds`` the
    rows that each kind of anchor stands for (default: ``all`` rows).  Of rows
    with one time the lowest ``rank`` counts.  Rows without a key, and
    intervals or anchors without a time, can't be met.
    """
    keys, kinds = list(keys), kinds or {"all": F.lit(True)}
    times = [anchor, *(interval or [])]
    a = F.struct(rank, *[p for p in payload if p != rank]).alias("a")
    # quantiles, blocks, ends and sweep all read the rows
    rows = materialize(rows.dropna(subset=keys), "rows")
    # a row a key: written, so the planner knows their size and broadcasts them if they are small
    bounds = materialize(_bounds(rows, keys, times, block_rows), "bounds")
    blocked = rows.join(bounds.select(*keys, "cuts"), keys)
    quoted = [*map(_name, keys)]
    spots = {"at": F.col(anchor)} | {f"is_{k}": c for k, c in kinds.items()}
    if interval:
        spots |= {"start": F.col(interval[0]), "end": F.col(interval[1])}
    own = blocked.select(*keys, "cuts", a, *(c.alias(n) for n, c in spots.items()))
    own = own.selectExpr("*", *(f"size(filter(cuts, c -> c <= `{n}`)) AS b_{n}" for n in ("at", "start", "end") if n in spots))
    row = own.schema["a"].dataType.simpleString()

    def event(block: str, t: str, after: int, kind: int, name: str = "NULL", at: str = "NULL", n: str = "NULL", a: str = "NULL") -> str:
        return (
            f"struct(int({block}) AS block, double({t}) AS t, {after} AS after, {kind} AS kind, string({name}) AS name, "
            f"double({at}) AS at, bigint({n}) AS n, cast({a} AS {row}) AS a)"
        )

    def dealt(source: DataFrame, events: list[str]) -> DataFrame:
        return source.selectExpr(*quoted, f"inline(array_compact(array({', '.join(events)})))")

    low, high = "'-Infinity'", "'Infinity'"
    blocks = bounds.selectExpr(*quoted, "cuts", "explode(sequence(0, size(cuts))) AS block")
    found = [f"CASE WHEN is_{k} AND at IS NOT NULL THEN {event('b_at', 'at', 0, _ANCHOR, repr(k), 'at', a='a')} END" for k in kinds]
    if interval:
        found += [
            f"CASE WHEN start <= `end` THEN {event('b_start', 'start', 0, _START, at='`end`', n='1', a='a')} END",
            f"CASE WHEN start <= `end` AND b_start < b_end THEN {event('b_end', low, 0, _START, at='`end`', n='1', a='a')} END",
            f"CASE WHEN start <= `end` THEN {event('b_end', '`end`', 1, _END, n='1')} END",
        ]
    parts = [dealt(blocks, [event("block", low, 0, _BLOCK)]), dealt(own, found)]

    # what reaches into a block from beyond its borders, for keys with several blocks
    own, blocks = own.where("size(cuts) > 0"), blocks.where("size(cuts) > 0").drop("cuts")
    named = ", ".join(f"CASE WHEN is_{k} THEN '{k}' END" for k in kinds)
    anchors = own.where("at IS NOT NULL").selectExpr(*quoted, "b_at AS block", "at", "a", f"explode(array_compact(array({named}))) AS name")
    # the anchors next to a block: from one row a block and kind
    ends = [f"min(struct(at, a.`{rank}` AS rank, a)) AS first", f"max(struct(at, -a.`{rank}` AS rank, a)) AS last"]
    ends = anchors.groupBy(*keys, "name", "block").agg(*map(F.expr, ends))
    grid = blocks.selectExpr("*", f"explode(array({', '.join(map(repr, kinds))})) AS name").join(ends, [*keys, "name", "block"], "left")
    over = f"OVER (PARTITION BY {', '.join(quoted)}, name ORDER BY block ROWS BETWEEN"
    around = grid.selectExpr(
        "*",
        f"last(last, true) {over} UNBOUNDED PRECEDING AND 1 PRECEDING) AS before",
        f"first(first, true) {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next",
    )
    sides = [
        f"CASE WHEN {side} IS NOT NULL THEN {event('block', low, 0, kind, 'name', f'{side}.at', a=f'{side}.a')} END"
        for side, kind in (("before", _ANCHOR), ("next", _NEXT))
    ]
    parts.append(dealt(around, sides))
    if interval:
        whole = own.where("start <= `end` AND b_start + 1 < b_end")
        covers = whole.selectExpr(*quoted, "a", f"inline({_dyadic('b_start + 1', 'b_end - 1')})")
        covers = covers.groupBy(*keys, "level", "node").agg(F.expr("min(a) AS a"), F.expr("count(1) AS n"))
        up = f"inline(transform(sequence(0, {_LEVELS}), k -> struct(k AS level, shiftright(block, k) AS node)))"
        within = blocks.selectExpr(*quoted, "block", up)
        covered = within.join(covers, [*keys, "level", "node"]).groupBy(*keys, "block").agg(F.expr("min(a) AS a"), F.expr("sum(n) AS n"))
        parts.append(dealt(covered, [event("block", low, 0, _START, at=high, n="n", a="a")]))
    events = parts[0]
    for more in parts[1:]:
        events = events.unionByName(more)
    order = [*keys, "block", "t", "after", "kind", F.col(f"a.{rank}")]  # of anchors of one time the lowest rank comes first
    events = events.repartition(*keys, "block").sortWithinPartitions(*order)
    spot = f"struct<t:double,a:{row}>"
    typed = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    beside = ", ".join(f"prev_{k} {spot}, next_{k} {spot}" for k in kinds)
    spec = f"{typed}, block int, lo double, lo_open boolean, hi double, hi_closed boolean, hit {row}, overlap_count long, {beside}"
    return Segments(events.mapInArrow(_sweep(len(keys), list(kinds), rank), spec), bounds, keys)


def _sweep(n_keys: int, kinds: list[str], rank: str):
    """Walks the sorted rows of each (keys, block) and puts out its segments; holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = None, None
        group, done, open_ = None, [], None
        active: list = []  # heap of (rank, number, end, row)
        held = number = 0
        prev: dict = {}
        later: dict = {}
        waiting: dict = {}  # segments that don't know their next anchor yet

        def close(hi: float, closed: bool) -> None:
            nonlocal open_
            if open_ is None:
                return
            lo, lo_open = open_
            while active and (active[0][2] < lo or (active[0][2] == lo and lo_open)):
                heapq.heappop(active)
            segment = {"lo": lo, "lo_open": lo_open, "hi": hi, "hi_closed": closed, "hit": active[0][3] if active else None, "overlap_count": held}
            for k in kinds:
                segment[f"prev_{k}"] = prev.get(k)
                waiting[k].append(segment)
            done.append((group, segment))
            open_ = None

        def finish() -> None:
            close(inf, False)
            for k in kinds:
                for segment in waiting[k]:
                    segment[f"next_{k}"] = later.get(k)

        def flush() -> pa.RecordBatch:
            columns = [pa.array([g[i] for g, _ in done], types[i]) for i in range(n_keys + 1)]
            columns += [pa.array([s[c] for _, s in done], t) for c, t in zip(names[n_keys + 1 :], types[n_keys + 1 :], strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            if names is None:
                row = batch.schema.field("a").type
                spot = pa.struct([("t", pa.float64()), ("a", row)])
                names = [*batch.schema.names[: n_keys + 1], "lo", "lo_open", "hi", "hi_closed", "hit", "overlap_count"]
                names += [f"{side}_{k}" for k in kinds for side in ("prev", "next")]
                types = [batch.schema.field(i).type for i in range(n_keys + 1)]
                types += [pa.float64(), pa.bool_(), pa.float64(), pa.bool_(), row, pa.int64(), *[spot] * (2 * len(kinds))]
            columns = [c.to_pylist() for c in batch.columns]
            own = zip(*columns[: n_keys + 1], strict=True)
            for key, t, after, kind, name, at, n, a in zip(own, *columns[n_keys + 1 :], strict=True):
                if key != group:
                    if group is not None:
                        finish()
                        if len(done) > 4096:
                            yield flush()
                    group, open_, held, prev, later, waiting = key, None, 0, {}, {}, {k: [] for k in kinds}
                    active.clear()
                if open_ is None:
                    open_ = (t, after == 1)
                elif open_ != (t, after == 1):
                    close(t, after == 1)
                    open_ = (t, after == 1)
                if kind == _START:
                    number += 1
                    heapq.heappush(active, (a[rank], number, at, a))
                    held += n
                elif kind == _END:
                    held -= n
                elif kind == _NEXT:
                    later[name] = {"t": at, "a": a}
                elif kind == _ANCHOR:
                    spot_ = {"t": at, "a": a}
                    for segment in waiting[name]:
                        segment[f"next_{name}"] = spot_
                    waiting[name] = []
                    if name not in prev or prev[name]["t"] != at:
                        prev[name] = spot_
        if group is not None:
            finish()
            yield flush()

    return run


def locate(probes: DataFrame, segments: Segments, on: dict[str, str], t: str, cuts: str = "cuts") -> DataFrame:
    """``probes`` with the fields of the one segment that holds their time ``t``; nulls if their key is unknown.

    ``on`` maps the segments' keys to columns of ``probes``, which have the
    ``cuts`` of their key (joined from ``bounds``).  Works on a stream, too.
    """
    names = {k: f"__{k}" for k in segments.keys}
    index = segments.index.withColumnsRenamed(names).withColumnRenamed("block", "__block")
    held = (F.col("lo") < F.col(t)) | ((F.col("lo") == F.col(t)) & ~F.col("lo_open"))
    held &= (F.col(t) < F.col("hi")) | ((F.col(t) == F.col("hi")) & F.col("hi_closed"))
    same = [F.col(on[k]) == F.col(names[k]) for k in segments.keys]
    probes = probes.withColumn("__at", block_of(F.col(cuts), F.col(t)))
    found = probes.join(index, [*same, F.col("__at") == F.col("__block"), held], "left")
    return found.drop("__at", "__block", "lo", "lo_open", "hi", "hi_closed", *names.values())


def with_bounds(probes: DataFrame, segments: Segments, on: dict[str, str]) -> DataFrame:
    """``probes`` with the ``cuts``, ``first_start`` and ``last_end`` of their key."""
    names = {k: f"__{k}" for k in segments.keys}
    bounds = segments.bounds.withColumnsRenamed(names)
    return probes.join(bounds, [F.col(on[k]) == F.col(names[k]) for k in segments.keys], "left").drop(*names.values())


def nearest(kind: str, t: Column, limit: Column | None = None) -> Column:
    """(dist, a) of the anchor of a kind nearest to ``t``, ties by rank; one after ``limit`` doesn't count."""

    def spot(side: str) -> Column:
        s = F.col(f"{side}_{kind}")
        ok = s.isNotNull() if limit is None else s["t"] <= limit
        return F.when(ok, F.struct(F.abs(s["t"] - t).alias("dist"), s["a"].alias("a")))

    return F.array_min(F.array_compact(F.array(spot("prev"), spot("next"))))
