"""Language identification by nearest centroid.

A document is a TF-IDF vector of hashed byte trigrams of its lower-cased
letters, scaled to length 1.  Every language has several centroids, found by
spherical k-means over its training documents; a document takes the language of
the centroid with the highest cosine.  A document whose distance to that
centroid is well beyond what any training document of its length shows is
marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from cuesheet.llm.common import give_back
from cuesheet.sinks.files import materialize

DIMENSIONS = 4096
CENTROIDS = 4
TRAIN_PER_LANG = 2000
ROUNDS = 8
LENGTH_BINS = 24
SLACK = 0.5
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
# bytes that stay: a-z and the bytes of non-ASCII characters; all else is a space
_KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)
CHUNK_BYTES = 1 << 20


def trigram_counts(text: str) -> tuple[np.ndarray, int]:
    """Counts of the hashed byte trigrams of a whole text, and how many there are.

    Runs of non-letters count as one space; a trigram holds a letter at least.
    Long texts are taken in pieces that overlap by two bytes.
    """
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    counts, tail = np.zeros(DIMENSIONS, np.int64), np.full(1, 32, np.uint32)
    for at in range(0, max(len(raw), 1), CHUNK_BYTES):
        b = np.concatenate([tail, _KEEP[raw[at : at + CHUNK_BYTES]]])
        if at + CHUNK_BYTES >= len(raw):
            b = np.append(b, np.uint32(32))
        space = b == 32
        b = b[~(space & np.concatenate([[False], space[:-1]]))]
        if len(b) >= 3:
            code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
            hashed = (code * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(hashed, minlength=DIMENSIONS)
        tail = b[-2:]
    return counts, int(counts.sum())


def _matrix(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF rows and the trigram count of each text."""
    rows, sizes = np.zeros((len(texts), DIMENSIONS)), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        counts, sizes[i] = trigram_counts(text)
        hit = np.nonzero(counts)[0]
        v = (1 + np.log(counts[hit])) * idf[hit]
        norm = np.sqrt((v * v).sum())
        if norm > 0:
            rows[i, hit] = v / norm
    return rows, sizes


def length_bin(sizes: np.ndarray) -> np.ndarray:
    """Bins of trigram counts, each twice as wide as the last."""
    return np.minimum(np.log2(np.maximum(sizes, 1)).astype(int), LENGTH_BINS - 1)


@dataclass
class Model:
    """``idf`` by dimension; ``langs``, ``centroids`` and ``least`` (lowest accepted cosine by length bin of its language) by centroid."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine in 0 to 1 and rejection of each text."""
        langs, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        rejected[known] = bool(self.langs)  # without a model nothing tells against a text
        for at in range(0, len(known) if self.langs else 0, 256):
            part = known[at : at + 256]
            rows, sizes = _matrix([texts[i] for i in part], self.idf)
            # rounded, as the last digits hang on which texts go through together
            cosine = (rows @ self.centroids.T).round(9)
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(part)), best], 0, 1)
            scores[part] = score
            rejected[part] = (score <= 0) | (score < self.least[best, length_bin(sizes)])
            for i, c in zip(part, best, strict=True):
                langs[i] = self.langs[c]
        return langs, scores, rejected


def _clusters(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; the seeds are documents spread by farthest-first choice."""
    seeds = [int((rows @ rows.mean(axis=0)).argmax())]
    near = rows @ rows[seeds[0]]
    while len(seeds) < min(k, len(rows)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[seeds[-1]])
    centres = rows[seeds]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(docs: DataFrame, usable: Column, per_lang: int = TRAIN_PER_LANG, k: int = CENTROIDS) -> Model:
    """Learn a model from ``text`` and ``lang`` of the ``usable`` rows.

    Document frequencies come from all usable rows.  Centroids come from the
    ``per_lang`` different texts of each language with the smallest hashes (all,
    if fewer), so a language's rows fit one task and no number of copies makes
    a language vanish.  What reaches the driver is one row per centroid and one
    vector of frequencies.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                df += trigram_counts(text.as_py())[0] > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tolist()])], ["n", "df"])
        give_back()

    parts = materialize(rows.select("text").mapInArrow(frequencies, "n long, df array<long>"), "frequencies")
    df = np.zeros(DIMENSIONS)
    for r in parts.select(F.posexplode("df").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        df[r["i"]] = r["x"]
    n = parts.agg(F.sum("n")).first()[0] or 0
    idf = np.log((1 + n) / (1 + df)) + 1
    hashed = rows.withColumn("h", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # ranked within the tasks first
    drawn = hashed.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= per_lang).select("lang", "h")
    # per_lang rows of a number and a name for each language of the model
    sample = hashed.join(F.broadcast(drawn), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def centroids(pdf):
        import pandas as pd

        x, size = _matrix(pdf["text"].tolist(), idf)
        centres = _clusters(x, k, ROUNDS)
        cosine = x @ centres.T
        bins = length_bin(size)
        # lowest cosine of a training document by length; a longer text counts for shorter ones and the next longer bin,
        # and beyond the longest (and below the shortest) seen nothing is known of how far off a text may lie
        low = np.ones(LENGTH_BINS)
        np.minimum.at(low, bins, cosine.max(axis=1))
        low = np.minimum.accumulate(low[::-1])[::-1]
        low[1:] = np.minimum(low[1:], low[:-1].copy())
        low[bins.max() + 1 :] = low[bins.max()]
        low[: bins.min()] = 0
        lang = pdf["lang"].iloc[0]
        out = [(lang, centre.tolist(), (SLACK * low).tolist()) for centre in centres]
        return pd.DataFrame(out, columns=["lang", "centre", "least"])

    found = sample.groupBy("lang").applyInPandas(centroids, "lang string, centre array<double>, least array<double>").collect()
    found.sort(key=lambda r: (r["lang"], r["centre"]))
    return Model(
        idf,
        [r["lang"] for r in found],
        np.array([r["centre"] for r in found]).reshape(-1, DIMENSIONS),
        np.array([r["least"] for r in found]).reshape(-1, LENGTH_BINS),
    )


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text leaves remainder 0; a row without an id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def identify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and rejected added, each named with ``prefix``.

    A text that is null or has no letter is ``und`` with score 0, rejected.  With
    a model that learned nothing all others are ``und`` too, but not rejected.
    Repeated rows get the same answer each; only text is read.
    """
    names = [prefix + x for x in ("lang_pred", "score", "rejected")]
    types = (StringType(), DoubleType(), BooleanType())
    clear = docs.drop(*names)
    spec = StructType(clear.schema.fields + [StructField(n, t) for n, t in zip(names, types, strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some centroids a language
    at = clear.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = shared.value.predict(batch.column(at).to_pylist())
            more = [pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])
        give_back()

    return clear.mapInArrow(run, spec)
