"""Merkle manifest of a dataset, with a proof for every row.

Rows are the leaves of a tree per group (ascending by key, runs of eight become
their parent); the groups' subroots are the leaves of one tree above.  Proofs
come by pointer jumping: every node holds a pointer to an ancestor, first its
parent, and the siblings met on the way there; joining the nodes with
themselves replaces a pointer by its ancestor's pointer and appends that
ancestor's siblings, so the distance doubles with each join and a tree of
height h needs about log2(h) of them.  Leaves of one run share all siblings
above it, so they travel together, eight at most, and never alone.

All of it is DataFrame code; a tree is dealt out by position, so a group with a
third of all rows is no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.operators.indexing import global_ordinal
from cuesheet.sinks.files import materialize

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
TOP = -1  # number of the tree above the groups' trees
BROADCAST_BYTES = 8 << 20


def digest(parts: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` if null, else the length in bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return digest([field(c) for c in columns])


@dataclass
class Tree:
    """``runs``: id, tree, group, leaves (pos, key, leaf, other) of every run of leaves; ``links``: id, up, path of every node but
    leaves and root; ``subroots``: tree, subroot.

    An id is (tree, level, pos).  ``path`` lists, for each node passed towards
    ``up``, the digests before and after it in its run.  ``height`` is the
    longest way from a run of leaves to the root.
    """

    runs: DataFrame
    links: DataFrame | None
    subroots: DataFrame
    root: str | None
    height: int
    names: int = 0


def _id(tree: Column, level: Column | int, pos: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), pos.cast("long").alias("pos"))


def _beside(digests: Column, i: Column) -> Column:
    """The digests of a run before and after its ``i``-th."""
    return F.struct(
        F.array_join(F.slice(digests, F.lit(1), i), "").alias("before"),
        F.array_join(F.slice(digests, i + 2, F.greatest(F.size(digests) - i - 1, F.lit(0))), "").alias("after"),
    )


def _level_up(nodes: DataFrame, level: int) -> DataFrame:
    """Parents of ``nodes`` (tree, size, pos, digest), with their children's digests in order; one row for each run of eight."""
    run = F.array_sort(F.collect_list(F.struct("pos", "digest")))
    up = nodes.groupBy("tree", "size", F.shiftright("pos", FANOUT_BITS).alias("up")).agg(run.alias("run"))
    up = up.select("tree", F.ceil(F.col("size") / FANOUT).alias("size"), F.col("up").alias("pos"), F.col("run.digest").alias("children"))
    return up.select(F.lit(level).alias("level"), "*", digest([F.array_join("children", "")]).alias("digest"))


def build(leaves: DataFrame) -> Tree:
    """The trees over ``leaves`` (group, key, leaf, other).

    Groups ascend null first, as strings by their bytes; within a group leaves
    ascend by key, null first, and rows of one key by ``leaf``, so repeated
    rows have places of their own.  ``other`` travels along.
    """
    # rows that are equal in all are told apart by their place, so that a range may end among them
    leaves = leaves.withColumn("__row", F.monotonically_increasing_id())
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf", "__row"]
    ordered = global_ordinal(leaves, order, "ordinal")
    groups = ordered.groupBy("group").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("size"))
    groups = global_ordinal(groups, ["first"], "tree")
    names, largest, name_bytes = groups.agg(F.count(F.lit(1)), F.max("size"), F.sum(F.coalesce(F.octet_length("group"), F.lit(0)) + 64)).first()
    if not names:
        return Tree(leaves, None, groups, None, 0)
    side = groups.select(F.col("group").alias("__group"), "first", "size", "tree")
    side = F.broadcast(side) if name_bytes <= BROADCAST_BYTES else side
    placed = ordered.join(side, F.col("group").eqNullSafe(F.col("__group")))
    placed = placed.select("tree", "group", "size", (F.col("ordinal") - F.col("first")).alias("pos"), "key", "leaf", "other")

    # the leaves, a row for each run
    run = F.array_sort(F.collect_list(F.struct("pos", "key", "leaf", "other")))
    runs = placed.groupBy("tree", "group", "size", F.shiftright("pos", FANOUT_BITS).alias("pos")).agg(run.alias("leaves"))
    lone, whole = F.col("size") == 1, F.col("size") <= FANOUT
    runs = runs.select(
        F.when(whole, _id(F.lit(TOP), 0, F.col("tree"))).otherwise(_id(F.col("tree"), 1, F.col("pos"))).alias("id"),
        "tree",
        "group",
        F.ceil(F.col("size") / FANOUT).alias("size"),
        "pos",
        "leaves",
        lone.alias("lone"),
        F.when(lone, F.col("leaves.leaf")[0]).otherwise(digest([F.array_join("leaves.leaf", "")])).alias("digest"),
    )
    runs = materialize(runs, "runs")

    # the levels above, each an eighth of the one below; a level is written so that it is made once
    nodes = runs.select(F.lit(1).alias("level"), "tree", "size", "pos", "digest")
    inner, subroots, level, size = [], [nodes.where("size = 1")], 1, -(-largest // FANOUT)
    while size > 1:
        level += 1
        nodes = materialize(_level_up(nodes.where("size > 1"), level), "level")
        inner.append(nodes)
        subroots.append(nodes.where("size = 1"))
        size = -(-size // FANOUT)
    height = level - 1
    top = subroots[0].select("tree", "digest")
    for more in subroots[1:]:
        top = top.unionByName(more.select("tree", "digest"))
    top = materialize(top, "subroots")
    nodes = top.select(F.lit(TOP).cast("long").alias("tree"), F.lit(names).cast("long").alias("size"), F.col("tree").alias("pos"), "digest")
    level, size = 0, names
    while size > 1:
        level += 1
        nodes = materialize(_level_up(nodes, level), "level")
        inner.append(nodes)
        size = -(-size // FANOUT)
    root = nodes.first()["digest"]
    return Tree(runs, _links(inner), top.withColumnRenamed("digest", "subroot"), root, height + level, names)


def _links(inner: list[DataFrame]) -> DataFrame | None:
    """A row for each child of the inner nodes: its id, its parent's and its siblings."""
    if not inner:
        return None
    nodes = inner[0]
    for more in inner[1:]:
        nodes = nodes.unionByName(more)
    # the node that is left of a group is a leaf of the tree above
    subroot = (F.col("tree") != TOP) & (F.col("size") == 1)
    up = F.when(subroot, _id(F.lit(TOP), 0, F.col("tree"))).otherwise(_id(F.col("tree"), F.col("level"), F.col("pos")))
    child = nodes.select("*", up.alias("up"), F.posexplode("children").alias("i", "own"))
    return child.select(
        _id(F.col("tree"), F.col("level") - 1, F.col("pos") * FANOUT + F.col("i")).alias("id"),
        "up",
        F.array(_beside(F.col("children"), F.col("i"))).alias("path"),
    )


def jump(tree: Tree) -> DataFrame | None:
    """``id, path`` of every node below the root: its siblings on the whole way to the root.

    A join doubles how far pointers reach.  A node that others point to at
    distance 2^k has 8^(2^k) descendants there at most, and there are few such
    nodes once that is many: they are broadcast if their number proves them
    small, and joined by shuffle if not.
    """
    if tree.links is None:
        return None
    links, reach = materialize(tree.links, "links"), 1
    while reach < tree.height:
        far = links.select(F.col("id").alias("__id"), F.col("up").alias("__up"), F.col("path").alias("__path"))
        wanted = far.join(links.select(F.col("up").alias("__id")).distinct(), "__id", "left_semi")
        n = wanted.count()
        side = F.broadcast(wanted) if n * (reach * (FANOUT - 1) * 64 + 64) <= BROADCAST_BYTES else wanted
        joined = links.join(side, F.col("up") == F.col("__id"), "left")
        path = F.concat("path", F.coalesce("__path", F.array().cast(links.schema["path"].dataType)))
        links = materialize(joined.select("id", F.coalesce("__up", "up").alias("up"), path.alias("path")), "links")
        reach *= 2
    return links.select("id", "path")


def prove(leaves: DataFrame) -> DataFrame:
    """``group, key, leaf, other, subroot, root, path`` of every row of ``leaves`` (see ``build``).

    ``path`` lists, level by level from the leaf to the root, the digests before
    and after the row's own node in its run.  A lone leaf is its group's
    subroot, and a lone group's subroot is the root.  No rows give no rows.
    """
    tree = build(leaves)
    kind = "array<struct<before:string,after:string>>"
    if tree.root is None:
        nothing = [F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"), F.array().cast(kind).alias("path")]
        return leaves.select("group", "key", "leaf", "other", *nothing)
    above, none = jump(tree), F.array().cast(kind)
    runs = tree.runs
    if above is not None:
        runs = runs.join(above.select("id", F.col("path").alias("above")), "id", "left")
    runs = runs.withColumn("above", F.coalesce("above", none) if above is not None else none)
    subroots = F.broadcast(tree.subroots) if tree.names * 128 <= BROADCAST_BYTES else tree.subroots
    runs = runs.join(subroots, "tree")
    rows = runs.select("group", "subroot", "lone", "above", F.col("leaves.leaf").alias("digests"), F.posexplode("leaves").alias("i", "row"))
    own = F.when(F.col("lone"), none).otherwise(F.array(_beside(F.col("digests"), F.col("i"))))
    path = F.concat(own, "above").alias("path")
    return rows.select("group", "row.key", "row.leaf", "row.other", "subroot", F.lit(tree.root).alias("root"), path)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda own, level: F.sha2(F.concat(level["before"], own, level["after"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, one after the other."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), "")
