"""Benchmark decontamination with the q-gram lemma.

Benchmark items are cut into overlapping pieces.  Where a text holds a piece of
m characters with at most k edits, the two share at least m + 1 - q * (k + 1)
q-grams, all of them on k + 1 neighbouring diagonals (place in the text less
place in the piece).  So a document's q-grams are looked up, the shared ones
are counted in overlapping bands of diagonals, and only bands that reach that
count are aligned, inside the band.

Both sides are lower-cased and each run of white space is one space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from cuesheet.llm.common import give_back

Q = 10
PIECE = 80
EDITS = 0.08
MIN_CHARS = 16
BLOCK_CHARS = 1 << 21
SKETCH_BITS = 22
CHUNK_CHARS = 1 << 20
LEAK = StructType([StructField(n, LongType() if n == "item_id" else IntegerType()) for n in ("item_id", "first", "last", "edits")])


def normalised(text: str) -> np.ndarray:
    """Code points of a text in lower case, white space collapsed."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters from each place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, run, width, done = None, codes.astype(np.uint64), 1, 0
    base = 0x9E3779B97F4A7C15
    while width <= q:  # hashes of 1, 2, 4 ... characters, put together by the bits of q
        if q & width:
            piece = run[done : done + n]
            out = piece if out is None else out * np.uint64(pow(base, width, 1 << 64)) + piece
            done += width
        run = run[:-width] * np.uint64(pow(base, width, 1 << 64)) + run[width:] if 2 * width <= q else run
        width *= 2
    out = out ^ (out >> np.uint64(29))
    return out * np.uint64(0xBF58476D1CE4E5B9)


def pieces(n: int, size: int = PIECE) -> list[tuple[int, int]]:
    """Stretches of ``size`` characters that overlap by half and end at the end; the whole if shorter."""
    if n <= size:
        return [(0, n)]
    return [(a, a + size) for a in [*range(0, n - size, size // 2), n - size]]


class Index:
    """The pieces of some benchmark items and where their q-grams occur."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edits: float = EDITS):
        self.q, self.items, self.starts, self.codes, self.budget = q, [], [], [], []
        for item_id, text in items:
            codes = normalised(text)
            if len(codes) < MIN_CHARS:
                continue
            for a, b in pieces(len(codes)):
                self.items.append(item_id)
                self.starts.append(a)
                self.codes.append(codes[a:b])
                # as many edits as leave a shared q-gram at least
                self.budget.append(min(int(edits * (b - a)), (b - a) // q - 1))
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array(self.budget, np.int64)
        self.need = self.size + 1 - q * (self.edits + 1)
        self.width = self.edits + 1  # of a bin; a band is two bins
        found = [grams(c, q) for c in self.codes]
        flat = np.concatenate([np.zeros(0, np.uint64), *found])
        piece = np.repeat(np.arange(len(found)), [len(f) for f in found])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(f)) for f in found)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.piece, self.place = piece[order], place[order]
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.sketch = np.zeros(1 << SKETCH_BITS, bool)
        self.sketch[self.grams >> np.uint64(64 - SKETCH_BITS)] = True

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, first bin) of the bands that hold enough shared q-grams."""
        own = grams(codes, self.q)
        at = np.nonzero(self.sketch[own >> np.uint64(64 - SKETCH_BITS)])[0]
        if not len(at):
            return at, at
        row = np.minimum(np.searchsorted(self.grams, own[at]), len(self.grams) - 1)
        hit = self.grams[row] == own[at]
        at, row = at[hit], row[hit]
        many = self.count[row]
        if not len(many):
            return at, at
        spread = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[row], many)
        piece = self.piece[spread]
        bins = (np.repeat(at, many) - self.place[spread]) // self.width[piece]
        span = np.int64(1) << 40
        key, n = np.unique(piece * span + (bins + (span >> 1)), return_counts=True)
        # a band starts at each bin with hits and at the one before it
        starts = np.unique(np.concatenate([key, key - 1]))
        total = np.zeros(len(starts), np.int64)
        for step in (0, 1):
            i = np.minimum(np.searchsorted(key, starts + step), len(key) - 1)
            total += np.where(key[i] == starts + step, n[i], 0)
        piece = starts // span
        keep = total >= self.need[np.minimum(piece, len(self.need) - 1)]
        return piece[keep], (starts % span - (span >> 1))[keep]

    def align(self, codes: np.ndarray, piece: np.ndarray, first_bin: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(piece, edits, start, end) of the best alignment inside each band, where it is within the piece's budget.

        A cell holds edits * 4096 + the lane where its path begins; lanes are
        the diagonals of the band.  Bands of pieces of one length go together.
        """
        found, unit = [], 4096
        for size in np.unique(self.size[piece]).tolist():
            some = np.nonzero(self.size[piece] == size)[0]
            own = np.stack([self.codes[i] for i in piece[some]])
            width = int(self.width[piece[some[0]]])  # follows from the length
            low, lanes = first_bin[some] * width, 2 * width
            place = low[:, None] + np.arange(size + lanes)
            inside = (place >= 0) & (place < len(codes))
            text = np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
            lane = np.arange(lanes)
            cell = np.repeat(lane[None], len(some), axis=0)
            for i in range(size):
                step = cell + unit * (text[:, i : i + lanes] != own[:, i : i + 1])
                np.minimum(step[:, :-1], cell[:, 1:] + unit, out=step[:, :-1])  # a character of the piece left out
                cell = np.minimum.accumulate(step - unit * lane, axis=1) + unit * lane  # characters of the text left out
            best = cell.argmin(axis=1)
            value = cell[np.arange(len(some)), best]
            for j in np.nonzero(value // unit <= self.edits[piece[some]])[0].tolist():
                start, end = int(low[j] + value[j] % unit), int(low[j] + best[j] + size)
                found.append((int(piece[some[j]]), int(value[j] // unit), max(0, start), min(len(codes), end)))
        return found

    def search(self, text: str) -> list[dict]:
        """The items found in a whole text: where (of the normalised text) and the fewest edits of a piece."""
        codes, found = normalised(text), {}
        longest = int(self.size.max()) if len(self.size) else 0
        step = CHUNK_CHARS
        for at in range(0, max(len(codes), 1), step):
            # chunks overlap by more than a piece with its edits
            part = codes[at : at + step + 2 * longest]
            for piece, edits, a, b in self.align(part, *self.bands(part)):
                old, new = found.get(self.items[piece]), (at + a, at + b, edits)
                found[self.items[piece]] = (min(old[0], new[0]), max(old[1], new[1]), min(old[2], edits)) if old else new
        return [{"item_id": i, "first": a, "last": b, "edits": e} for i, (a, b, e) in sorted(found.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, column: str = "leaks") -> DataFrame:
    """``docs`` with the benchmark items found in each ``text`` in ``column``.

    ``benchmark``: item_id, text.  Items are taken in blocks of about
    BLOCK_CHARS characters; a block's index is what is broadcast, and each
    block is one pass over the documents.

    Defined cases: items without id, or with a null text or fewer than
    MIN_CHARS characters, are no evidence and are never found; items of equal
    id count as one; a null or empty text holds none (an empty list).  Each row
    is searched for itself, repeated rows alike, and other columns stay.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    out = docs.drop(column).withColumn(column, F.array().cast(ArrayType(LEAK)))
    spec, at = out.schema, out.columns.index("text")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.int32()) for n in ("first", "last", "edits"))]))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        index = Index([(r["item_id"], r["text"]) for r in own], edits=edits)
        if not index.items:
            continue
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = batch.column(batch.num_columns - 1).to_pylist()
                texts = batch.column(at)
                found = [x + shared.value.search(t.as_py() or "") for x, t in zip(before, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], batch.schema.names)
            give_back()

        out = out.mapInArrow(run, spec)
    return out
