"""Exact n-gram Jaccard join with prefix trees.

Sets of five-word shingles are ordered globally, frequent shingles first.
Similar sets share a shingle among their rarest ones (the end of that order),
so only sets that meet there are compared.  Equal sets are one node from the
start, and nodes that are already connected aren't compared again:

* first every node is compared with one hub among the nodes that it meets
  (a star instead of all pairs of a group);
* then, twice, with the node nearest to it, by its bitmap, among those that it
  isn't connected with and that it meets in its largest group;
* then all remaining pairs of nodes that meet but aren't connected, block by
  block, each pair in the first group that both nodes name.

A group is left out if all its nodes meet in one larger group.

A pair first passes two bounds that never lose a link: set sizes, and the
Hamming distance of parity bitmaps, which is at most the symmetric difference.
What is left is compared in prefix trees: the sets to compare with one hub are
stored as a tree, and the hub walks it, adding up partial overlaps once for all
sets below and leaving out subtrees whose remaining lengths can't reach the
overlap needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.common import give_back, most_frequent
from cuesheet.llm.components import components
from cuesheet.llm.shingles import shingle_sets
from cuesheet.sinks.files import materialize

FREQUENT = 1 << 19
COUNTED = 1 << 21
TREE_TOKENS = 1 << 20
NUM, DEN = 80, 100
LIGHT = np.uint64(1 << 63)
BROADCAST_ROWS = 1 << 22
GROUP = 512
WIDE_BITS = 1 << 12
SEEN = 1 << 18
NAMED = 8


def linked(shared: int, n: int, m: int) -> bool:
    """100 * intersection >= 80 * union."""
    return DEN * shared >= NUM * (n + m - shared)


def _signature(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens by their lowest bits, about a bit per token (64 at least), up to WIDE_BITS four."""
    power = (len(tokens) - 1).bit_length()
    bits = max(1 << max(6, power), min(1 << power + 2, WIDE_BITS))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two bitmaps, the longer folded to the shorter's length."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def document_key() -> Column:
    """One key for a document wherever it is read: rows that share doc_id and text are one document."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))


def members(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n, sig, bitmap`` per document: set size, 64-bit signature and parity bitmap of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, bits = [], [], []
            for s in shingle_sets(t.as_py() for t in batch.column(2)):
                n.append(len(s))
                sig.append(_signature(s))
                bits.append(_bitmap(s) if len(s) else None)
            cols = [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "n", "sig", "bitmap"])
        give_back()

    rows = docs.select("doc_id", document_key().alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, n long, sig long, bitmap binary")


def frequent_shingles(docs: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """Shingles that recur, most frequent first, ``most`` at most.

    Any order is right for the join; this one keeps common passages out of the
    rare ends.  Tasks count stretches of distinct sets and send what recurs
    within one, and the sums are ranked, so the list covers all documents and
    its size is bounded by ``most``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def flush() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            seen.clear()
            cols = [pa.array(tokens[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))]
            return pa.RecordBatch.from_arrays(cols, ["token", "n"])

        for batch in batches:
            for s in shingle_sets(t.as_py() for t in batch.column(0)):
                if len(s) and (sig := _signature(s)) not in seen:
                    seen.add(sig)
                    held.append(s)
                    size += len(s)
                if size >= COUNTED:
                    yield flush()
                    size = 0
        yield flush()
        give_back()

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = most_frequent(counts, most).select("token", "n").toPandas().sort_values(["n", "token"], ascending=[False, True])
    return top["token"].to_numpy(np.int64).view(np.uint64)


class Order:
    """Global order: the frequent shingles by rank, then all others by hash."""

    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent).astype(np.uint64)
        self.tokens = frequent[self.rank.astype(np.int64)]

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """The set as ascending keys of the order."""
        out = tokens | LIGHT
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            hit = self.tokens[at] == tokens
            out[hit] = self.rank[at[hit]]
        return np.unique(out)


def rare_ends(docs: DataFrame, order: Order) -> DataFrame:
    """``token, sig``: the n - ceil(0.8 n) + 1 rarest shingles of each set; sets 0.8 alike share one of them.

    A task leaves out most repetitions of a set, within a bound.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)  # FREQUENT shingles at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            token, sig = [], []
            if len(seen) > SEEN:
                seen.clear()
            for s in shingle_sets(t.as_py() for t in batch.column(0)):
                if len(s) and (own := _signature(s)) not in seen:
                    seen.add(own)
                    keys = shared.value.keys(s)
                    end = keys[-(len(s) - -(-NUM * len(s) // DEN) + 1) :]
                    token.append(end.view(np.int64))
                    sig.append(np.full(len(end), own, np.int64))
            if token:
                cols = [pa.array(np.concatenate(x)) for x in (token, sig)]
                yield pa.RecordBatch.from_arrays(cols, ["token", "sig"])
        seen.clear()
        give_back()

    return docs.select("text").mapInArrow(run, "token long, sig long")


def meeting(ends: DataFrame) -> DataFrame:
    """The distinct rows of ``ends`` whose token has two nodes or more, found in one pass over the sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = np.zeros((2, 0), np.int64), False  # the last row, and whether the one before has its token
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            rows = rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))]
            same = rows[0, 1:] == rows[0, :-1]
            before, after = np.append(met, same), same
            keep = before[:-1] | after
            held, met = rows[:, -1:], bool(before[-1])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, :-1][:, keep]], ["token", "sig"])
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["token", "sig"])

    return ends.repartition("token").sortWithinPartitions("token", "sig").mapInArrow(run, "token long, sig long")


def within_bounds(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``hub, sig`` pairs that sizes and bitmaps don't rule out, with both sizes and documents."""
    side = lambda name: nodes.select(
        F.col("sig").alias(name), F.col("n").alias(f"{name}_n"), F.col("rep").alias(f"{name}_rep"), F.col("bitmap").alias(f"{name}_map")
    )
    full = pairs.join(side("hub"), "hub").join(side("sig"), "sig")
    full = full.where((NUM * F.greatest("hub_n", "sig_n") <= DEN * F.least("hub_n", "sig_n")))
    names = ["hub", "sig", "hub_n", "sig_n", "hub_rep", "sig_rep"]
    full = full.select(*names, "hub_map", "sig_map")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            far = np.array([_distance(a.as_py(), b.as_py()) for a, b in zip(batch.column(6), batch.column(7), strict=True)])
            # linked sets differ in (n + m) * (1 - t) / (1 + t) shingles at most
            keep = pa.array(far.reshape(-1) * (DEN + NUM) <= n * (DEN - NUM))
            yield batch.filter(keep).select(names)

    return full.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _words(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps folded to ``size`` bytes, as rows of 64-bit words."""
    out = np.empty((len(maps), size), np.uint8)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, np.uint8)
        out[i] = x if len(x) == size else np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)
    return out.view(np.uint64)


def close_pairs(rows: DataFrame, nodes: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """All pairs of ``rows`` (token, sig, nodes, label) that share a token, have different labels and pass the bounds.

    ``named`` (sig, named) holds tokens of each node in one order for all: a
    pair that has some in common comes out at the first of them only.  Without
    it, only the pair of each node with the smallest distance of bitmaps among
    those of its largest group: a row per node at most.

    Groups are cut into blocks of about GROUP nodes; a pair of blocks is one
    row, and the pairs within are compared by their bitmaps without being
    listed, so only those that pass come out.
    """
    closest = named is None
    if closest:
        asked = rows.groupBy("sig").agg(F.max(F.struct("nodes", "token"))["token"].alias("asked"))
        rows = rows.join(asked, "sig").join(asked.select(F.col("asked").alias("token")).distinct(), "token")
        rows = rows.withColumn("named", F.when(F.col("asked") == F.col("token"), F.array("token"))).drop("asked")
    else:
        rows = rows.join(named, "sig")
    rows = rows.join(nodes.select("sig", "n", "rep", "bitmap"), "sig")
    blocks = F.ceil(F.col("nodes") / GROUP)

    def packed(rows: DataFrame) -> DataFrame:
        own = F.collect_list(F.struct("sig", "n", "label", "rep", "bitmap", "named")).alias("own")
        return rows.withColumn("block", F.pmod(F.xxhash64("sig"), blocks)).groupBy("token", "block").agg(own)

    one = packed(rows)
    one = one.select("token", "own", F.lit(None).cast(one.schema["own"].dataType).alias("other"))
    large = packed(rows.where(F.col("nodes") > GROUP))
    other = large.select("token", F.col("block").alias("b"), F.col("own").alias("other"))
    two = large.join(other, "token").where("block < b").select("token", "own", "other")
    names = ["hub", "sig", "hub_n", "sig_n", "hub_rep", "sig_rep"]

    def columns(group: pa.Array) -> tuple:
        flat = group.flatten()
        sig, n, label, rep, maps, named = (flat.field(i) for i in range(6))
        return (*(c.to_numpy(zero_copy_only=False) for c in (sig, n, label, rep)), maps.to_pylist(), named.to_pylist())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                token, same = batch.column(0)[i].as_py(), not batch.column(2)[i].is_valid
                left = columns(batch.column(1).slice(i, 1))
                right = left if same else columns(batch.column(2).slice(i, 1))
                found, step = {}, 0 if same else len(left[0])
                asks = [np.array([x is not None for x in side[5]], bool) for side in (left, right)]
                # equal lengths together; a shorter bitmap folds a longer one, which keeps the bound
                for width in sorted({len(m) for m in left[4]} | {len(m) for m in right[4]}):
                    a = np.array([k for k, m in enumerate(left[4]) if width <= len(m) <= 2 * width], np.int64)
                    b = np.array([k for k, m in enumerate(right[4]) if width <= len(m) <= 2 * width], np.int64)
                    if not len(a) or not len(b):
                        continue
                    x, y = _words([left[4][k] for k in a], width), _words([right[4][k] for k in b], width)
                    for k in range(len(a)):
                        n, m = left[1][a[k]], right[1][b]
                        keep = (right[2][b] != left[2][a[k]]) & (NUM * np.maximum(n, m) <= DEN * np.minimum(n, m))
                        keep &= (right[0][b] > left[0][a[k]]) if same else True
                        keep &= asks[0][a[k]] | asks[1][b]
                        at = np.nonzero(keep)[0]
                        far = np.bitwise_count(y[at] ^ x[k]).sum(axis=1, dtype=np.int64)
                        near = far * (DEN + NUM) <= (n + m[at]) * (DEN - NUM)
                        found.update(((int(a[k]), int(b[j]) + step), int(f)) for j, f in zip(at[near], far[near], strict=True))
                both = left if same else [np.concatenate([x, y]) for x, y in zip(left[:4], right[:4], strict=True)]
                who = left[5] if same else left[5] + right[5]
                if not closest:
                    sets = [set(x) for x in who]
                    found = {(p, q): f for (p, q), f in found.items() if next((t for t in who[p] if t in sets[q]), token) == token}
                pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
                if closest:  # of each node that asks, as the second of a pair
                    far = np.array([found[tuple(x)] for x in pairs.tolist()], np.int64)
                    pairs, far = np.concatenate([pairs, pairs[:, ::-1]]), np.concatenate([far, far])
                    ask = np.array([x is not None for x in who], bool)[pairs[:, 1]]
                    pairs, far = pairs[ask], far[ask]
                    order = np.lexsort((far, pairs[:, 1]))
                    order = order[np.unique(pairs[order, 1], return_index=True)[1]]
                    pairs, far = pairs[order], far[order]
                else:  # the smaller first, whichever blocks they are in
                    far = np.zeros(len(pairs), np.int64)
                    turned = both[0][pairs[:, 0]] > both[0][pairs[:, 1]]
                    pairs[turned] = pairs[turned][:, ::-1]
                p, q = pairs[:, 0], pairs[:, 1]
                cols = [both[0][p], both[0][q], both[1][p], both[1][q], both[3][p], both[3][q], far]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], [*names, "far"])

    found = one.unionByName(two).mapInArrow(compare, ", ".join(f"{c} long" for c in [*names, "far"]))
    if not closest:
        return found.select(*names).distinct()
    best = found.groupBy("sig").agg(F.min(F.struct("far", *(c for c in names if c != "sig"))).alias("best"))
    return best.select("sig", "best.*").select(*names)


def leading(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``groups`` (token, sig, nodes) without those whose nodes all meet in one larger group, and ``sig, named``.

    ``named``: the NAMED largest groups of each node, largest first.  Those
    whose nodes all have another group as their largest hold no pair that isn't
    in that one.
    """
    size = F.struct((-F.col("nodes")).alias("size"), "token")
    named = groups.groupBy("sig").agg(F.slice(F.array_sort(F.collect_list(size)), 1, NAMED)["token"].alias("named"))
    named = materialize(named, "named")
    first = groups.join(named.select("sig", F.col("named")[0].alias("first")), "sig")
    ends = first.groupBy("token").agg(F.min("first").alias("a"), F.max("first").alias("b"))
    return groups.join(ends.where("a <> b OR a = token").select("token"), "token"), named


def tree_links(hub: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Indices of the sets that link with ``hub``, by a walk over their prefix tree.

    The sets are sorted by their keys, so a node of the tree is a stretch of
    sets with a common prefix; equal stretches of keys are counted once.
    """
    place = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    rows = [sets[i] for i in place]
    found, todo = [], [(0, len(rows), 0, 0)] if rows else []
    while todo:
        a, b, depth, shared = todo.pop()
        first, last = rows[a], rows[b - 1]
        k = min(len(first), len(last))
        other = np.nonzero(first[depth:k] != last[depth:k])[0]
        end = depth + int(other[0]) if len(other) else k
        part = first[depth:end]
        if len(part):
            at = np.minimum(np.searchsorted(hub, part), len(hub) - 1)
            shared += int((hub[at] == part).sum())
        # the length below that could share most: all that is left of the hub and nothing else
        left = len(hub) - int(np.searchsorted(hub, first[end - 1], side="right")) if end else len(hub)
        sizes = [len(r) for r in rows[a:b]]
        best = min(max(end + left, min(sizes)), max(sizes))
        if not linked(shared + min(left, best - end), len(hub), best):
            continue
        while a < b and len(rows[a]) == end:  # sets that end at this node
            if linked(shared, len(hub), end):
                found.append(place[a])
            a += 1
        while a < b:
            c, key = a + 1, rows[a][end]
            while c < b and rows[c][end] == key:
                c += 1
            todo.append((a, c, end, shared))
            a = c
    return found


def verified(docs: DataFrame, pairs: DataFrame, order: Order) -> DataFrame:
    """``u, v`` of the pairs (as from ``within_bounds``) whose sets link.

    The sets of one hub are split into trees of about TREE_TOKENS shingles, so
    a task never holds more than one tree and one hub.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(order)
    trees = F.ceil(F.sum("sig_n") / F.lit(TREE_TOKENS)).cast("long").alias("trees")
    parts = pairs.groupBy("hub", "hub_rep").agg(trees)
    put = pairs.join(parts.drop("hub_rep"), "hub").withColumn("tree", F.pmod(F.xxhash64("sig"), F.col("trees")))
    asked = put.select("hub", "tree", F.lit(1).alias("kind"), F.col("sig").alias("node"), F.col("sig_rep").alias("rep"))
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("tree"), F.lit(0).alias("kind"), F.col("hub").alias("node"), F.col("hub_rep").alias("rep"))
    wanted = materialize(asked.unionByName(hubs), "wanted")
    reps = wanted.select(F.col("rep").alias("key"), "node").distinct()
    # a small list goes to the texts; a long one is joined by shuffling both
    texts = docs.select(document_key().alias("key"), "text")
    texts = texts.join(F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps, "key")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(1).to_pylist()
            out = []
            for node, s in zip(nodes, shingle_sets(t.as_py() for t in batch.column(0)), strict=True):
                if _signature(s) == node:
                    out.append({"node": node, "keys": shared.value.keys(s).tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("node", pa.int64()), ("keys", pa.binary())]))
        give_back()

    sets = texts.select("text", "node").mapInArrow(as_sets, "node long, keys binary").dropDuplicates(["node"])
    rows = (
        wanted.join(sets, "node")
        .select("hub", "tree", "kind", "node", "keys")
        .repartition("hub", "tree")
        .sortWithinPartitions("hub", "tree", "kind")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub, nodes, sets = None, None, [], []

        def done() -> pa.RecordBatch:
            hit = tree_links(hub, sets)
            cols = [pa.array([at[0]] * len(hit), pa.int64()), pa.array([nodes[i] for i in hit], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["u", "v"])

        for batch in batches:
            for h, t, kind, node, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if sets:
                        yield done()
                    at, hub, nodes, sets = (h, t), np.frombuffer(keys, np.uint64), [], []
                else:
                    nodes.append(node)
                    sets.append(np.frombuffer(keys, np.uint64))
        if sets:
            yield done()

    return rows.mapInArrow(walk, "u long, v long")


def jaccard_components(docs: DataFrame, stars: int = 1, nearest: int = 2) -> DataFrame:
    """``doc_id, key, n_shingles, component_id`` per row of ``docs`` (doc_id, text; others are ignored).

    Two documents link when their sets of five-word shingles are 0.8 alike;
    component_id is the smallest doc_id reachable by links.  A null or empty
    text, or one without words, has an empty set and is linked with nothing: its
    component is its own doc_id.  Rows without a doc_id link like others but
    never name a component.  Repeated rows are linked to one another.
    """
    return _labelled_rows(docs, stars, nearest).drop("label")


def _labelled_rows(docs: DataFrame, stars: int = 1, nearest: int = 2) -> DataFrame:
    """The result of ``jaccard_components`` with the ``label`` of each component, which those without an id have, too."""
    all_ = materialize(members(docs.select(F.col("doc_id").cast("long"), "text")), "members")
    some = all_.where("n > 0")
    nodes = materialize(
        some.groupBy("sig").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")),
        "nodes",
    )
    order = Order(frequent_shingles(docs))
    met = materialize(meeting(rare_ends(docs, order)), "met")

    # shingles that the same nodes share say the same: one of them is enough
    who = [F.bit_xor(F.xxhash64("sig", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    alike = met.groupBy("token").agg(*who, F.count(F.lit(1)).alias("nodes")).groupBy("x0", "x1", "nodes")
    one = alike.agg(F.min("token").alias("token")).select("token", "nodes")
    met, named = leading(materialize(met.join(one, "token").select("token", "sig", "nodes"), "alike"))
    met = materialize(met, "groups")

    roots = None

    def labelled() -> DataFrame:
        if roots is None:
            return met.withColumn("label", F.col("sig"))
        names = roots.select(F.col("node").alias("sig"), "root")
        return met.join(names, "sig", "left").withColumn("label", F.coalesce("root", "sig")).drop("root")

    def apart(rows: DataFrame) -> DataFrame:
        """Shingles whose nodes aren't all connected."""
        ends = rows.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"))
        return ends.where("a <> b").select("token")

    for turn in range(stars + nearest + 1):
        rows = labelled()
        if turn:
            rows = materialize(rows.join(apart(rows), "token"), "apart")
            if rows.isEmpty():
                break
        if turn < stars:
            draw = F.xxhash64("sig", F.lit(turn))
            hubs = rows.groupBy("token").agg(F.min(F.struct(draw.alias("draw"), F.col("sig").alias("hub"), F.col("label").alias("hub_label"))).alias("h"))
            met_hub = rows.join(hubs, "token").where("label <> h.hub_label")
            pairs = met_hub.groupBy("sig").agg(F.min("h").alias("h")).select("sig", "h.hub")
            close = within_bounds(pairs, nodes)
        else:
            close = close_pairs(rows, nodes, None if turn < stars + nearest else named)
        close = materialize(close, "close")
        if roots is not None and close.isEmpty():
            continue
        new = materialize(verified(docs, close, order), "verified")
        if roots is not None:
            if new.isEmpty():
                continue
            new = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new)
        roots = components(new)

    labels = all_.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left")
    labels = labels.select("doc_id", "key", "n", F.coalesce("root", "sig").alias("label"))
    least = labels.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return labels.join(least, "label", "left").select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        "label",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; one document of each group stays.

    Documents with empty sets stay.  Rows that share the kept doc_id are one
    document and stay together.  Of a group in which no row has an id one row
    stays: one of those with the smallest hash of their text.
    """
    found = materialize(_labelled_rows(docs), "components")
    nameless = found.where("n_shingles > 0 AND component_id IS NULL").groupBy("label").agg(F.min("key").alias("__one"))
    gone = found.join(nameless, "label", "left").where(
        F.when(F.col("__one").isNotNull(), F.col("key") != F.col("__one")).otherwise(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
    kept = docs.withColumn("__key", document_key()).join(gone.select(F.col("key").alias("__key")).distinct(), "__key", "left_anti")
    # copies of the row that stays for a group without ids have its key
    kept = kept.join(nameless.select(F.col("__one").alias("__key"), F.lit(True).alias("__lone")), "__key", "left")
    alone = kept.where("__lone").dropDuplicates(["__key"])
    return kept.where("__lone IS NULL").unionByName(alone).select(*docs.columns)
