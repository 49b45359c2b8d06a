import hashlib
import random

from pyspark.sql import functions as F

from cuesheet.llm import sharding
from cuesheet.llm.queries import op3_extendible_shards


def bits(doc_id):
    return format(int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16), "060b")


def brute(rows, limit):
    """Split buckets one by one until each fits."""
    todo, done = [("", rows)], {}
    while todo:
        prefix, own = todo.pop()
        if sum(len((t or "").encode()) for _, t in own) <= limit or len({bits(d) for d, _ in own}) == 1:
            done["s" + prefix] = own
        else:
            for b in "01":
                if part := [r for r in own if bits(r[0]).startswith(prefix + b)]:
                    todo.append((prefix + b, part))
    return done


def test_shards_are_those_of_bucket_splits(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "x" * rng.choice([0, 3, 50, 400])) for i in range(300)] + [(1000, None), (None, "é" * 10), (2000, "y" * 5000)]
    df = spark.createDataFrame([(*r, "a", 7) for r in rows], "doc_id long, text string, cell string, depth int")
    directory = sharding.write_shards(df, str(tmp_path / "s"), 1000)
    got = {}
    for r in spark.read.option("basePath", str(tmp_path / "s")).parquet(str(tmp_path / "s")).collect():
        got.setdefault(r.shard, []).append((r.doc_id, r.text))
    want = brute(rows, 1000)
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    totals = {r.shard: (r.bytes, r.rows) for r in directory.shards.collect()}
    assert totals == {k: (sum(len((t or "").encode()) for _, t in v), len(v)) for k, v in want.items()}
    assert all(b <= 1000 or n == 1 for b, n in totals.values()) and directory.depth() == max(len(k) - 1 for k in want)


def test_one_repeated_id_is_split_by_count(spark):
    rows = [(i, "x" * 100) for i in range(200)] + [(7, "y" * 100)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    directory = sharding.build_directory(df, 2000)
    dealt = sharding.assign(df, directory).groupBy("shard").agg(F.sum(F.length("text")).alias("b")).collect()
    assert len(directory.levels) > 1 and sum(r.b for r in dealt) == 50_000
    assert max(r.b for r in dealt) <= 2000 and any("-" in r.shard for r in dealt)


def test_empty_and_small_tables(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.write_shards(df, str(tmp_path / "e")).shards.count() == 0
    one = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    assert {r.shard for r in sharding.assign(one, sharding.build_directory(one)).collect()} == {"s"}


def test_the_query_keeps_ids_that_are_dealt_out(spark, tmp_path):
    rng = random.Random(4)
    sizes = [rng.choice([0, 10, 1_000, 300_000, 500_000, 700_000]) for _ in range(60)]
    rows = [(None if i % 2 else 7, chr(97 + i % 26) * n) for i, n in enumerate(sizes)] + [(7, "x" * 1_200_000), (None, None), (None, "same"), (None, "same")]
    rows += [(100 + i, "z" * 5000) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = op3_extendible_shards(spark, str(tmp_path)).collect()
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r.doc_id, r.text_sha256) for r in got), key=str) == sorted(((d, digest(t)) for d, t in rows), key=str)
    length = {digest(t): len(t or "") for _, t in rows}
    own = {}
    for r in got:
        own.setdefault((r.shard, r.shard_depth, r.shard_bytes, r.shard_rows), []).append(length[r.text_sha256])
    assert len({k[0] for k in own}) == len(own) and sum("-" in k[0] for k in own) > 4
    assert all(sum(v) == k[2] and len(v) == k[3] and len(k[0].split("-")[0]) == k[1] + 1 for k, v in own.items())
    assert all(k[2] <= sharding.SHARD_BYTES or k[3] == 1 for k in own)
