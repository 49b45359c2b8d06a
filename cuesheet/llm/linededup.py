"""Line dedup by winnowing over line hashes.

A run is a stretch of consecutive lines of a document with ``min_words`` words
or more.  From every line the shortest run is a window; winnowing selects the
line with the smallest hash of each window as its fingerprint.  Two copies of a
run share their windows and so the fingerprints, which makes those guaranteed;
lines whose fingerprint occurs nowhere else are out of the game after one
aggregation.  Windows at the positions of shared fingerprints are joined, and a
match is extended both ways through the windows that overlap it: those that
begin at each line and those that end at each line.  Together they cover a
repeated run to its ends.

A run is deleted where it occurs later than its first occurrence, in the order
of doc_id and line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from cuesheet.llm.common import give_back
from cuesheet.sinks.files import materialize

MIN_WORDS = 50
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def line_words(line: bytes) -> list[bytes]:
    """Words of a line, A-Z lower-cased; ASCII white space separates them."""
    return line.translate(_FOLD).split()


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def windows(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
    """``(fingerprint, its line, run hash, first line, last line)`` of a text's windows.

    Lines without words are passed over.  Windows are the shortest runs that
    begin at each line and the shortest that end at each line; each carries the
    fingerprint of the shortest run that begins where it does.
    """
    at, hashes, sizes = [], [], []
    for i, line in enumerate(text.encode("utf-8", "replace").split(b"\n")):
        if words := line_words(line):
            at.append(i)
            hashes.append(hashlib.blake2b(b" ".join(words), digest_size=8).digest())
            sizes.append(len(words))
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    n = len(at)
    # last[i]: end of the shortest run from i; first[j]: start of the shortest run up to j
    last = np.searchsorted(total, total[:-1] + min_words) - 1
    first = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    order = np.frombuffer(b"".join(hashes), np.uint64)
    ends: dict[int, set[int]] = {a: {int(last[a])} for a in range(n) if last[a] < n}
    for b in range(n):
        if first[b] >= 0:
            ends[int(first[b])].add(b)
    rows = []
    for a, stops in ends.items():
        pick = a + int(order[a : last[a] + 1].argmin())
        mark = int.from_bytes(hashes[pick], "little", signed=True)
        rows += [(mark, at[pick], _hash(b"".join(hashes[a : b + 1])), at[a], at[b]) for b in sorted(stops)]
    return rows


def document_key() -> Column:
    """One key for a document wherever it is read: rows that share doc_id and text are one document."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))


def all_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``place, mark, pick, run, a, b``: the windows of all documents; ``place`` orders documents, null ids last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "mark", "pick", "run", "a", "b"]
        kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(doc_id, key, *w) for w in windows(text or "", min_words)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        give_back()

    spec = "doc_id long, key long, mark long, pick int, run long, a int, b int"
    rows = docs.select(F.col("doc_id").cast("long"), document_key().alias("key"), "text").mapInArrow(run, spec)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    return rows.select(place.alias("place"), "mark", "pick", "run", "a", "b")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, spans``: per document the windows to delete, as (first, last) line numbers from 0.

    A window goes if the same lines occur earlier: in an earlier document, or
    before the window in the same one.  Each group of equal windows is reduced
    to its first place before the join, so copies aren't paired with each other.
    """
    found = materialize(all_windows(docs, min_words), "windows")
    spot = F.struct("place", "pick")
    marks = found.groupBy("mark").agg(F.min(spot).alias("low"), F.max(spot).alias("high")).where("low <> high")
    shared = found.join(marks.select("mark"), "mark", "left_semi").select("place", "run", "a", "b")
    firsts = shared.groupBy("run").agg(F.min(F.struct("place", "a", "b")).alias("first"))
    later = (F.col("place") > F.col("first.place")) | (
        (F.col("place") == F.col("first.place")) & (F.col("a") > F.col("first.b"))
    )
    again = shared.join(firsts, "run").where(later)
    return again.groupBy(F.col("place.key").alias("key")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "removed") -> DataFrame:
    """``docs`` with later repeated runs cut out of ``text``; ``removed`` holds the cut stretches (first, last line).

    Lines are what newlines separate; they are compared word by word, A-Z
    lower-cased.  A document that loses all its lines keeps an empty text.  A
    null or empty text has no runs and stays.  Rows that share doc_id and text
    are one document: they lose the same runs, and don't repeat each other.
    Documents without an id come last in the order.  Other columns stay.
    """
    clear = docs.drop(removed)
    spans = repeated_runs(clear, min_words).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    joined = clear.withColumn("__key", document_key()).join(spans, "__key", "left").drop("__key")
    at, names = clear.columns.index("text"), [*clear.columns, removed]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    spec = StructType([*clear.schema.fields, StructField(removed, ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())])))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in own or []):
                    if merged and a <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                if merged:
                    lines, kept, here = text.split("\n"), [], 0
                    for a, b in merged:
                        kept += lines[here:a]
                        here = b + 1
                    text = "\n".join(kept + lines[here:])
                texts.append(text)
                gone.append([{"first": a, "last": b} for a, b in merged])
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, kind)], names)
        give_back()

    return joined.mapInArrow(cut, spec)
