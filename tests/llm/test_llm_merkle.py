import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from cuesheet.llm import merkle
from cuesheet.llm.queries import OP13_SQL, op13_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute(rows):
    """Leaf, subroot, root and way to the root of every row (group, key, fields), trees walked one node at a time."""
    ways = {i: [] for i in range(len(rows))}
    leaf = [sha("".join(map(field, r[2]))) for r in rows]

    def up(nodes):
        out = []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for i, (_, members) in enumerate(run):
                for m in members:
                    ways[m].append(("".join(d for d, _ in run[:i]), "".join(d for d, _ in run[i + 1 :])))
            out.append((sha("".join(d for d, _ in run)), [m for _, ms in run for m in ms]))
        return out

    def reduce(nodes):
        while len(nodes) > 1:
            nodes = up(nodes)
        return nodes[0]

    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1] is not None, rows[i][1] or 0, leaf[i]))
    subroots = [reduce([(leaf[i], [i]) for i in order if rows[i][0] == g]) for g in groups]
    root = reduce(subroots)[0]
    subroot = {m: d for d, ms in subroots for m in ms}
    return [(leaf[i], subroot[i], root, ways[i]) for i in range(len(rows))]


def check(spark, rows):
    leaves = spark.createDataFrame([(g, k, *f) for g, k, f in rows], "group string, key long, a string, b string")
    leaves = leaves.select("group", "key", merkle.leaf_digest([F.col("a"), F.col("b")]).alias("leaf"), F.col("a").alias("other"))
    got = merkle.prove(leaves.repartition(4)).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    want = brute(rows)
    assert all(r.folded == r.root for r in got)
    mine = sorted((r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in got)
    assert mine == sorted((a, b, c, list(map(tuple, d))) for a, b, c, d in want)


def test_proofs_equal_a_walk_of_the_trees(spark):
    rng = random.Random(2)
    rows = [("big", i, (str(i), "é" * (i % 5))) for i in range(1, 600)]
    rows += [(None, None, (None, "")), (None, 3, ("x", None)), ("", 1, ("y", "y")), ("é", 2, ("z", "")), ("Z" * 70, 5, ("q", "q"))]
    rows += [("copies", 9, ("same", "same"))] * 30 + [("copies", 9, ("other", "same"))] * 2 + [(f"g{i}", 1, ("only", "one")) for i in range(70)]
    rows += [("eight", i, ("", "")) for i in range(8)] + [("nine", i, ("", "")) for i in range(9)]
    rng.shuffle(rows)
    check(spark, rows)


def test_small_trees(spark):
    check(spark, [("a", 1, ("x", "y"))])
    check(spark, [("a", 1, ("x", "y")), ("a", 1, ("x", "y"))])
    check(spark, [("a", 1, ("x", "y")), (None, 1, ("x", "y"))])
    check(spark, [("a", i, ("x", "y")) for i in range(9)])
    none = spark.createDataFrame([], "group string, key long, leaf string, other string")
    assert merkle.prove(none).count() == 0


def test_shuffle_joins_give_the_same_as_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    check(spark, [("a" if i % 3 else f"g{i % 20}", i, (str(i), None)) for i in range(700)])


def test_a_changed_leaf_or_sibling_breaks_the_proof(spark):
    leaves = spark.range(100).select(F.lit("a").alias("group"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(None).cast("string").alias("other"))
    proved = merkle.prove(leaves)
    other = F.sha2(F.lit("other"), 256)
    assert proved.where(merkle.fold(other, F.col("path")) == F.col("root")).count() == 0
    swapped = F.transform("path", lambda p: F.struct(p["after"].alias("before"), p["before"].alias("after")))
    assert proved.where(merkle.fold(F.col("leaf"), swapped) == F.col("root")).count() == 0


def documents(spark, tmp_path):
    rows = [(i, f"Text {i} " + "AbÄ" * (i % 7), random.Random(i).choice(["en", "de", None, "fr"]), f"s{i % 3}", i, 1, "p") for i in range(90)]
    rows += [(200, None, "en", None, None, 1, "p"), (201, "", "xx", "", 0, 1, "p"), (202, "Long " * 100_000, None, "s", 7, 1, "p"), (5, "twice", "en", "s", 1, 1, "p")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    rows = documents(spark, tmp_path)
    got = op13_merkle_manifest(spark, str(tmp_path)).collect()
    want = brute([(r[2], r[0], (r[0], r[3], r[2], r[4], r[1])) for r in rows])
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    expected = []
    for r, (leaf, subroot, root, way) in zip(rows, want, strict=True):
        tampered = zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
        folded = sha("".join(map(field, (r[0], r[3], r[2], r[4], r[1].translate(low) if tampered else r[1]))))
        for before, after in way:
            folded = sha(before + folded + after)
        expected.append((r[0], leaf, subroot, root, sha("".join(a + b for a, b in way)), folded, folded == root))
    assert sorted(map(tuple, got)) == sorted(expected)
    assert 0 < sum(r.verified for r in got) < len(got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(OP13_SQL).fetchall()) == sorted(expected)
