"""Registered queries of the training-data operators: name -> (builder, DuckDB SQL or None).

Each builder applies one operator with its production parameters to its whole
table; the SQL, where there is one, gives the same rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm import bpe, decontam, langid, licenses, linededup, lmscore, merkle, sharding, topk, toxicity, triejoin, warc, whitening
from cuesheet.sinks.files import scratch_path
from cuesheet.sources.tables import read_table


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as dictionary-compressed WARC archives and read them back."""
    path = scratch_path(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, with_payload=False).drop("target_uri")


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""


def op8_topk_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other vectors of every vector whose id is divisible by 100."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def op10_langid_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~langid.held_out())
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")



def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; counts and digests of the ids and of the decoded text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


def bpe_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    lexicon = bpe.build_lexicon(docs, tokenizer)
    ids = bpe.encode(docs, tokenizer, lexicon, keep_text=False).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
    )
    text = bpe.decode(ids, tokenizer)
    return text.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))



def op7_jaccard_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under five-word Jaccard similarity of 0.8."""
    return triejoin.jaccard_components(read_table(spark, sf_dir, "documents")).drop("key")


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), t AS (SELECT doc_id, unnest(s) AS t FROM s
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y WHERE 100 * c >= 80 * (len(p.s) + len(q.s) - c)
), reach AS (
  WITH RECURSIVE r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, l.y FROM r JOIN links l ON l.x = r.y) SELECT * FROM r
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id
FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) ON x = s.doc_id
"""


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``documents`` as shards of at most 1 MiB of text and read them back, with each shard's totals."""
    path = scratch_path(spark, "shards")
    directory = sharding.write_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    rows = spark.read.schema("doc_id long, text string, shard string").parquet(path)
    # a shard that was dealt out has totals per part, from the parts' own folders
    dealt = rows.where(F.col("shard").contains("-")).groupBy("shard").agg(
        F.sum(sharding.text_bytes()).alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    depths = directory.shards.where("parts > 1").select(F.col("shard").alias("whole"), "depth")
    dealt = dealt.join(depths, F.substring_index("shard", "-", 1) == F.col("whole"))
    names = ["shard", "depth", "bytes", "rows"]
    totals = directory.shards.where("parts = 1").select(*names).unionByName(dealt.select(*names))
    totals = totals.select(
        "shard", F.col("depth").cast("int").alias("shard_depth"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows")
    )
    rows = rows.select("doc_id", "shard", F.sha2("text", 256).alias("text_sha256"))
    return rows.join(totals, "shard")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, text, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h,
         strlen(coalesce(text, '')) AS b FROM documents
), n AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(b) AS bytes, count(*) AS c
  FROM d, (SELECT CAST(unnest(range(0, 31)) AS INTEGER) AS depth) GROUP BY ALL
), s AS (
  SELECT n.* FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.prefix = n.prefix >> 1
  WHERE (n.bytes <= 1048576 OR n.c = 1) AND (n.depth = 0 OR (p.bytes > 1048576 AND p.c > 1))
)
SELECT doc_id, 's' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, sha256(text) AS text_sha256,
       depth AS shard_depth, CAST(bytes AS BIGINT) AS shard_bytes, c AS shard_rows
FROM d JOIN s ON prefix = h >> (60 - depth)
"""


def op6_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of 50 words or more that occur earlier."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = linededup.dedup_lines(docs)
    lines = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select(
        "doc_id", lines.alias("removed_lines"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256")
    )


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), w AS (
  SELECT *, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l
), c AS (
  SELECT doc_id, pos, array_to_string(ws, ' ') AS line, len(ws) AS n,
         sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT doc_id, a, b FROM (
    SELECT x.doc_id, x.pos AS a, min(y.pos) AS b FROM c x JOIN c y ON y.doc_id = x.doc_id AND y.upto - x.upto + x.n >= 50 AND y.pos >= x.pos GROUP BY ALL
    UNION ALL
    SELECT y.doc_id, max(x.pos), y.pos FROM c x JOIN c y ON y.doc_id = x.doc_id AND y.upto - x.upto + x.n >= 50 AND y.pos >= x.pos GROUP BY ALL)
), r AS (
  SELECT win.doc_id, a, b, string_agg(line, chr(10) ORDER BY pos) AS run
  FROM win JOIN c ON c.doc_id = win.doc_id AND pos BETWEEN a AND b GROUP BY ALL
), f AS (
  SELECT run, first(doc_id ORDER BY doc_id, a) AS fd, first(b ORDER BY doc_id, a) AS fb FROM r GROUP BY run
), gone AS (
  SELECT DISTINCT r.doc_id, l.pos FROM r JOIN f ON f.run = r.run AND (r.doc_id > fd OR (r.doc_id = fd AND a > fb))
  JOIN l ON l.doc_id = r.doc_id AND l.pos BETWEEN a AND b
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL) AS text, count(gone.pos) AS removed_lines
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(removed_lines, 0) AS removed_lines,
       CASE WHEN d.text IS NOT NULL THEN length(coalesce(kept.text, '')) END AS kept_chars,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def op2_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document, with its place and edits."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")



def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under models of the documents labelled as of high quality and of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    good = read_table(spark, sf_dir, "labels").where("quality = 1")
    found = lmscore.score_corpus(docs, good).drop("text")
    losses = ("target_loss", "background_loss", "difference")
    return found.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in losses))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM w
), vocab AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, encode(w)) AS id FROM t GROUP BY w
), c AS (SELECT doc_id, pos, id AS w FROM t JOIN vocab USING (w)
), p AS (SELECT doc_id, pos, w, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS v FROM c
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1
), n AS (
  SELECT v, w, count(*) AS b, count(good.doc_id) AS t FROM p LEFT JOIN good ON good.doc_id = p.doc_id GROUP BY v, w
), total AS (SELECT sum(t) / sum(b) AS f, sum(t) AS nt, sum(b) AS nb, (SELECT count(*) + 1 FROM vocab) AS size FROM n
), uni AS (
  SELECT w, (sum(t) + 1) / (any_value(nt) + any_value(size)) AS t, (sum(b) * any_value(f) + 1) / (any_value(nb) * any_value(f) + any_value(size)) AS b
  FROM n, total GROUP BY w
), prev AS (SELECT v, sum(t) AS t, sum(b) * any_value(f) AS b FROM n, total GROUP BY v
), cost AS (
  SELECT v, w, -ln((n.t + 16 * uni.t) / (prev.t + 16)) AS t, -ln((n.b * f + 16 * uni.b) / (prev.b + 16)) AS b
  FROM n JOIN uni USING (w) JOIN prev USING (v), total
), s AS (
  SELECT doc_id, count(*) AS n, avg(t) AS t, avg(b) AS b FROM p JOIN cost USING (v, w) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_tokens, round(t, 6) AS target_loss, round(b, 6) AS background_loss, round(t - b, 6) AS difference
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id
"""


def op9_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license template found in every document."""
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op11_bitsliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` on the 16 strongest components, scaled to variance 1."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    found = whitening.whiten(vectors, model).withColumn("deviation", F.col("deviation").cast("long"))
    error = F.lit(model and model.identity_error).cast("double").alias("identity_error")
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", error)


def op12_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document and its offending sentences, learned from the labels of documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~langid.held_out())
    found = toxicity.flag(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "score", "predicted", "offending")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and proof of every document, checked against a table in which a third of the texts is tampered with."""
    docs = read_table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    leaf = merkle.leaf_digest([*columns, F.col("text")])
    # what is found in the tampered table; null where that is the leaf itself
    found = merkle.leaf_digest([*columns, text])
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"), leaf.alias("leaf"), F.when(tampered, found).alias("other"))
    proved = merkle.prove(leaves)
    folded = proved.withColumn("folded_root", merkle.fold(F.coalesce("other", "leaf"), F.col("path")))
    return folded.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


OP13_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, [CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END
      FOR v IN [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text]] AS f,
    [CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END
      FOR v IN [translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')]] AS low,
    -- crc32, a bit at a time over the bytes of the id
    list_reduce(list_concat([4294967295], range(0, 8 * strlen(CAST(doc_id AS VARCHAR)))),
      lambda c, i: CAST(xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) ELSE 0 END) >> 1,
        (xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) ELSE 0 END) & 1) * 3988292384) AS BIGINT)) AS c
  FROM documents
), leaf AS (
  SELECT doc_id, lang, sha256(array_to_string(f, '')) AS leaf,
    CASE WHEN xor(c, 4294967295) % 3 = 0 THEN sha256(array_to_string(list_concat(f[1:4], low), '')) ELSE sha256(array_to_string(f, '')) END AS found
  FROM f
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM leaf
), levels(tree, level, d) AS (
  SELECT tree, 0, list(leaf ORDER BY pos) FROM placed GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, [sha256(array_to_string(d[8 * i + 1 : 8 * i + 8], '')) FOR i IN range(0, (len(d) + 7) // 8)] FROM levels WHERE len(d) > 1
), tops(level, d) AS (
  SELECT 0, list(d[1] ORDER BY tree) FROM levels WHERE len(d) = 1
  UNION ALL
  SELECT level + 1, [sha256(array_to_string(d[8 * i + 1 : 8 * i + 8], '')) FOR i IN range(0, (len(d) + 7) // 8)] FROM tops WHERE len(d) > 1
), climb(doc_id, leaf, tree, top, level, pos, own, proof, subroot) AS (
  SELECT doc_id, leaf, tree, false, 0, pos, found, '', NULL::VARCHAR FROM placed
  UNION ALL
  SELECT doc_id, leaf, c.tree, coalesce(top OR len(l.d) = 1, true),
    CASE WHEN NOT top AND len(l.d) = 1 THEN 0 ELSE c.level + 1 END,
    CASE WHEN NOT top AND len(l.d) = 1 THEN c.tree ELSE pos // 8 END,
    CASE WHEN NOT top AND len(l.d) = 1 THEN own
      ELSE sha256(array_to_string(x.d[8 * (pos // 8) + 1 : pos], '') || own || array_to_string(x.d[pos + 2 : 8 * (pos // 8) + 8], '')) END,
    CASE WHEN NOT top AND len(l.d) = 1 THEN proof
      ELSE proof || array_to_string(x.d[8 * (pos // 8) + 1 : pos], '') || array_to_string(x.d[pos + 2 : 8 * (pos // 8) + 8], '') END,
    CASE WHEN NOT top AND len(l.d) = 1 THEN l.d[1] ELSE subroot END
  FROM climb c LEFT JOIN levels l ON NOT c.top AND l.tree = c.tree AND l.level = c.level
    LEFT JOIN tops t ON c.top AND t.level = c.level, LATERAL (SELECT CASE WHEN top THEN t.d ELSE l.d END AS d) x
  WHERE NOT (top AND len(t.d) = 1)
)
SELECT doc_id, leaf, subroot, (SELECT d[1] FROM tops WHERE len(d) = 1) AS root, sha256(proof) AS proof_sha256, own AS folded_root,
  own = (SELECT d[1] FROM tops WHERE len(d) = 1) AS verified
FROM climb WHERE top AND level = (SELECT max(level) FROM tops)
"""


QUERIES = {
    "op1_warc_dictionary": (op1_warc_dictionary, OP1_SQL),
    "op2_qgram_decontamination": (op2_qgram_decontamination, None),
    "op3_extendible_shards": (op3_extendible_shards, OP3_SQL),
    "op4_cross_entropy_difference": (op4_cross_entropy_difference, OP4_SQL),
    "op5_bpe_transducer": (op5_bpe_transducer, None),
    "op6_line_winnowing": (op6_line_winnowing, OP6_SQL),
    "op7_jaccard_trie_join": (op7_jaccard_trie_join, OP7_SQL),
    "op8_topk_uniform_threshold": (op8_topk_uniform_threshold, OP8_SQL),
    "op9_license_minhash": (op9_license_minhash, None),
    "op10_langid_centroids": (op10_langid_centroids, None),
    "op11_bitsliced_whitening": (op11_bitsliced_whitening, None),
    "op12_multiple_instance_toxicity": (op12_multiple_instance_toxicity, None),
    "op13_merkle_manifest": (op13_merkle_manifest, OP13_SQL),
}
