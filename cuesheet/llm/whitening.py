"""Embedding whitening from an exact, bit-sliced scatter matrix.

Vectors are taken as integers.  A block of rows is shifted so that no number is
negative and cut into bit planes: for each dimension and bit, one bit of every
row, packed into 64-bit words.  The rows' sum of products of two dimensions is
then the weighted sum of the popcounts of the AND of their planes, exact in
integers, however the rows were dealt to tasks.  The sums of all blocks are
centred as integers, too, before the one division that makes the covariance
whose eigenvectors whiten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from cuesheet.sinks.files import materialize

STEP = 64
SHIFT = 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 8192
LARGEST = float(1 << 50)
EXACT = DecimalType(38, 0)


def as_integers(column: str = "embedding") -> Column:
    """floor(STEP * c) of every entry; null if the vector is null or empty or holds a null or non-finite entry.

    Entries of LARGEST or more are an error: their products don't fit the sums.
    """
    whole = F.transform(
        F.col(column),
        lambda c: F.when(F.abs(c) < LARGEST, F.floor(c.cast("double") * STEP)).otherwise(F.raise_error(F.lit("an entry is too large"))),
    )
    fit = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    return F.when(fit & (F.size(column) > 0), whole)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The planes of non-negative rows (rows x dimensions), with the dimension and bit of each.

    A dimension has as many planes as its largest number has bits.
    """
    dims, bits, planes = [], [], []
    pad = -len(y) % 64
    for d, column in enumerate(np.ascontiguousarray(y.T)):
        for b in range(int(column.max()).bit_length()):
            dims.append(d)
            bits.append(b)
            planes.append(np.packbits(np.append((column >> b & 1).astype(np.uint8), np.zeros(pad, np.uint8))).view(np.uint64))
    words = np.array(planes, np.uint64).reshape(len(planes), (len(y) + pad) // 64)
    return words, np.array(dims, np.int64), np.array(bits, np.int64)


def block_sums(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (d) and sums of products (d x d) of integer rows, as exact Python integers."""
    n, d = z.shape
    low = z.min(axis=0)
    words, dims, bits = bit_planes(z - low)
    common = np.zeros((len(words), len(words)), np.int64)
    for p in range(len(words)):
        common[p, p:] = common[p:, p] = np.bitwise_count(words[p:] & words[p]).sum(axis=1, dtype=np.int64)
    # planes of the bits b and c count 2^(b + c); counts of one such weight are added up first
    top = int(bits.max(initial=0)) + 1
    at = [np.nonzero(bits == b)[0] for b in range(top)]
    levels = np.zeros((2 * top - 1, d, d), np.int64)
    for b in range(top):
        for c in range(top):
            levels[b + c][np.ix_(dims[at[b]], dims[at[c]])] += common[np.ix_(at[b], at[c])]
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for p, (i, b) in enumerate(zip(dims.tolist(), bits.tolist(), strict=True)):
        sums[i] += int(common[p, p]) << b
    for b, level in enumerate(levels):
        products += level.astype(object) * (1 << b)
    # back from the shifted rows: z = y + low
    low = low.astype(object)
    products += np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)
    return sums + n * low, products


@dataclass
class Whitener:
    """Of ``n`` fitted vectors of ``dimensions`` numbers z: their sums, and by component eigenvector, eigenvalue and share of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    def whitened(self, z: np.ndarray) -> np.ndarray:
        """Rows by components; NaN for a component in which the fitted vectors don't differ."""
        # n z - S is a whole number: no digits are lost to the mean
        centred = (self.n * z.astype(object) - np.array(self.sums, object)) if self.big(z) else self.n * z - np.array(self.sums, np.int64)
        scale = np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (centred.astype(np.float64) / self.n) @ self.vectors / scale

    def big(self, z: np.ndarray) -> bool:
        """Whether n z - S or its squares might not fit in 64 bits."""
        reach = self.n * max(abs(int(z.min(initial=0))), abs(int(z.max(initial=0)))) + max(map(abs, self.sums), default=0)
        return reach * reach * max(1, z.shape[1]) >= 1 << 62

    def deviations(self, z: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n z - S)^2, exact."""
        kind = object if self.big(z) else np.int64
        centred = self.n * z.astype(kind) - np.array(self.sums, kind)
        return [int(x) for x in (centred * centred).sum(axis=1)]


def _rows(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """Learn components from each distinct integer vector of ``vectors``; None if there is none.

    Rows whose vector is null, empty or holds a null or non-finite entry take
    no part, nor do those of another length than most (the longer, in a tie).
    Copies are one however many there are, and are reduced before the shuffle.
    What reaches the driver is one sum for each pair of dimensions.
    """
    distinct = materialize(vectors.select(as_integers(column).alias("z")).where("z IS NOT NULL").distinct(), "vectors")
    lengths = distinct.groupBy(F.size("z").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    n, d = lengths["count"], lengths["d"]
    distinct = distinct.where(F.size("z") == d)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                s, p = block_sums(_rows(batch.column(0).slice(at, BLOCK_ROWS)))
                sums, products = sums + s, products + p
        i, j = np.triu_indices(d)
        first, second = [*range(d), *i.tolist()], [*[-1] * d, *j.tolist()]
        numbers = [Decimal(int(x)) for x in (*sums, *products[i, j])]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(numbers, pa.decimal128(38, 0))], ["i", "j", "x"])

    parts = distinct.mapInArrow(scatter, "i int, j int, x decimal(38,0)")
    sums, products = [0] * d, np.zeros((d, d), object)
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # d (d + 3) / 2 rows
        if r["j"] < 0:
            sums[r["i"]] = int(r["x"])
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = int(r["x"])
    own = np.array(sums, object)
    centred = n * products - np.outer(own, own)  # n^2 times the covariance, in integers
    covariance = np.array([[int(x) / (n * n) for x in row] for row in centred]).reshape(d, d)
    values, vectors_ = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = int(centred.trace()) / (n * n)
    # what eigh leaves of a zero
    values = np.where(values > trace * d * np.finfo(float).eps, values, 0.0)[order]
    model = Whitener(n, sums, vectors_[:, order], values, [float(v) / trace if trace else None for v in values])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = int((model.values > 0).sum())
        total, outer = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(_rows(batch.column(0)))[:, :k]
            total, outer = total + w.sum(axis=0), outer + w.T @ w
        i, j = np.triu_indices(k)
        first, second = [*range(k), *i.tolist()], [*[-1] * k, *j.tolist()]
        numbers = [*total.tolist(), *outer[i, j].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(numbers, pa.float64())], ["i", "j", "x"])

    found = distinct.mapInArrow(errors, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    mean = {r["i"]: r["x"] / n for r in found if r["j"] < 0}  # 0 but for rounding
    model.identity_error = max(
        (abs(r["x"] / n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in found if r["j"] >= 0), default=None
    )
    return model


def whiten(vectors: DataFrame, model: Whitener | None, column: str = "embedding", prefix: str = "") -> DataFrame:
    """A row for each row of ``vectors`` and component, with n, deviation, component, whitened and explained added.

    Every row with a fitting vector is returned, copies and rows with one id
    alike; the rules for other rows are those of ``fit``.  ``deviation`` is a
    decimal.  A component without variance has null in ``whitened``, and
    ``explained`` is null if no component has any.  Columns of ``vectors`` with
    the names added are replaced; without a model there are no rows.
    """
    names = [prefix + x for x in ("component", "n", "deviation", "whitened", "explained")]
    types = (IntegerType(), LongType(), EXACT, DoubleType(), DoubleType())
    clear = vectors.drop(*names)
    spec = StructType(clear.schema.fields + [StructField(n, t) for n, t in zip(names, types, strict=True)])
    if model is None:
        return vectors.sparkSession.createDataFrame([], spec)
    d, k = len(model.sums), len(model.values)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # d * (components + 2) numbers
    rows = clear.withColumn("__z", as_integers(column)).where(F.size("__z") == d)
    own_names = clear.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                z = _rows(batch.column(batch.num_columns - 1))
                each = np.repeat(np.arange(len(z)), k)
                deviation = pa.array([Decimal(x) for x in model.deviations(z)], pa.decimal128(38, 0))
                more = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))),
                    pa.array(np.full(len(each), model.n)),
                    deviation.take(pa.array(each)),
                    pa.array(model.whitened(z).ravel(), from_pandas=True),
                    pa.array(model.explained * len(z), pa.float64()),
                ]
                own = batch.take(pa.array(each))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *more], [*own_names, *names])

    return rows.mapInArrow(run, spec)
