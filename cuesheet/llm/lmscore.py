"""Cross-entropy difference of a target and a background language model.

Both are bigram models over one vocabulary: every word of the corpus
(``score_corpus``), or a given number of the most frequent words, all others
being one unknown word (``fit`` and ``score``).  They are matched in every other
respect too: order, smoothing, and mass, the background's counts being scaled
to the target's number of tokens.  A document's score is the mean over its
tokens of the target's loss less the background's; low scores are like the
target.

P(w) = (c(w) + 1) / (N + V) and P(w | v) = (c(v, w) + m * P(w)) / (c(v) + m),
in nats, with a text's first word following an empty start word.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.sinks.files import materialize

VOCABULARY = 1023
PRIOR = 16.0
COUNTER_WORDS = 1 << 18
BROADCAST_ROWS = 1 << 22
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    """Words of a whole text: ASCII white space separates, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: every word of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(words(text.as_py()))
                if len(counts) > COUNTER_WORDS:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, size: int = VOCABULARY) -> list[bytes]:
    """The ``size`` most frequent words of ``counts``, ties in byte order."""
    return [bytes(r["word"]) for r in counts.orderBy(F.col("n").desc(), "word").limit(size).collect()]


def _codes(text: str | None, number: dict[bytes, int], unknown: int) -> np.ndarray:
    own = words(text)
    return np.fromiter((number.get(w, unknown) for w in own), np.int64, len(own))


def pair_counts(docs: DataFrame, is_target: Column, vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (previous, word) pairs in the target rows and in all rows, as two (V + 2, V + 1) tables.

    The last word stands for all unknown ones, the last previous word for the
    start of a text.  Tasks add up their documents; what reaches the driver is
    a row per pair that occurs, which the vocabulary bounds.
    """
    number, unknown = {w: i for i, w in enumerate(vocab)}, len(vocab)
    v = len(vocab) + 1
    shared = docs.sparkSession.sparkContext.broadcast(number)  # VOCABULARY words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, (v + 1) * v), np.int64)
        for batch in batches:
            groups: tuple[list, list] = ([], [])
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                code = _codes(text.as_py(), shared.value, unknown)
                if len(code):
                    pairs = np.concatenate([[v], code[:-1]]) * v + code
                    groups[1].append(pairs)
                    if wanted:
                        groups[0].append(pairs)
            for table, own in zip(tables, groups, strict=True):
                if own:
                    table += np.bincount(np.concatenate(own), minlength=len(table))
        at = np.nonzero(tables[1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, tables[0][at], tables[1][at])], ["pair", "t", "b"])

    counts = docs.select("text", is_target.alias("target")).mapInArrow(run, "pair long, t long, b long")
    rows = counts.groupBy("pair").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toPandas()
    out = np.zeros((2, (v + 1) * v), np.int64)
    for table, name in zip(out, ("t", "b"), strict=True):
        table[rows["pair"].to_numpy(np.int64)] = rows[name].to_numpy(np.int64)
    return out[0].reshape(v + 1, v), out[1].reshape(v + 1, v)


def losses(counts: np.ndarray, scale: float = 1.0, prior: float = PRIOR, size: int | None = None) -> np.ndarray:
    """-log P(word | previous) of every pair, ``size`` words being known (as many as ``counts`` has)."""
    c = counts * scale
    word = (c.sum(axis=0) + 1) / (c.sum() + (size or c.shape[1]))
    return -np.log((c + prior * word) / (c.sum(axis=1, keepdims=True) + prior))


@dataclass
class Models:
    """One vocabulary, and both models' losses by (previous, word)."""

    vocab: list[bytes]
    target: np.ndarray
    background: np.ndarray

    def score(self, texts: list[str | None], number: dict[bytes, int]) -> list[tuple[int, float | None, float | None]]:
        """(tokens, mean target loss, mean background loss) of each text."""
        v, out = len(self.vocab) + 1, []
        for text in texts:
            code = _codes(text, number, v - 1)
            if not len(code):
                out.append((0, None, None))
                continue
            before = np.concatenate([[v], code[:-1]])
            out.append((len(code), float(self.target[before, code].mean()), float(self.background[before, code].mean())))
        return out


def _labelled(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``docs`` with __id, which is null for documents that ``targets`` doesn't name."""
    wanted = targets.select(F.col("doc_id").cast("long").alias("__id")).where("__id IS NOT NULL").distinct()
    # a small list goes to the texts; a long one is joined by shuffling both
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return docs.join(wanted, F.col("doc_id").cast("long") == F.col("__id"), "left")


def fit(docs: DataFrame, targets: DataFrame, vocab_size: int = VOCABULARY) -> Models:
    """Models of ``vocab_size`` words, of the documents named in ``targets`` (doc_id) and of all documents (doc_id, text).

    Null ids match nothing; repeated ids in ``targets`` count once; without any
    target text the target model falls back on the uniform prior.
    """
    rows = _labelled(docs.select("doc_id", "text"), targets)
    vocab = vocabulary(word_counts(docs), vocab_size)
    target, background = pair_counts(rows, F.col("__id").isNotNull(), vocab)
    scale = target.sum() / max(1, background.sum())
    return Models(vocab, losses(target), losses(background, scale))


def score(docs: DataFrame, models: Models, prefix: str = "") -> DataFrame:
    """``docs`` with n_tokens, target_loss, background_loss and difference added, named with ``prefix``.

    A null or empty text, or one without words, has no tokens and null losses.
    Each row is scored for itself; other columns stay.
    """
    names = [prefix + n for n in ("n_tokens", "target_loss", "background_loss", "difference")]
    clear = docs.drop(*names)
    spec = clear.select("*", *(F.lit(None).cast(t).alias(n) for n, t in zip(names, ["long"] + ["double"] * 3, strict=True))).schema
    shared = docs.sparkSession.sparkContext.broadcast(models)  # (V + 2) * (V + 1) cells a model
    at = clear.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        number = {w: i for i, w in enumerate(models.vocab)}
        for batch in batches:
            found = models.score(batch.column(at).to_pylist(), number)
            n, t, b = ([f[i] for f in found] for i in range(3))
            diff = [None if x is None else x - y for x, y in zip(t, b, strict=True)]
            more = [pa.array(n, pa.int64()), *(pa.array(x, pa.float64()) for x in (t, b, diff))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    return clear.mapInArrow(run, spec)


RARE = 1 << 62
CACHE_WORDS = 1 << 18
FIXED = float(1 << 32)


def _hashes(own: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    """A number from 2^62 on for each word."""
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for w in own:
        if w not in cache:
            cache[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") >> 1 | RARE
    return np.fromiter((cache[w] for w in own), np.uint64, len(own))


def score_corpus(docs: DataFrame, targets: DataFrame, prefix: str = "", frequent: int = VOCABULARY) -> DataFrame:
    """``docs`` (doc_id, text) under models of those named in ``targets`` and of all of them, every word being a word of its own.

    Columns and edge rows are those of ``score`` and ``fit``.  Pairs of two of
    the ``frequent`` words are counted as in ``pair_counts`` and scored from
    broadcast tables.  All other pairs are dealt out once, a row per document
    and pair: by the word if it isn't frequent, else by the previous word, which
    isn't then.  A word's pairs, its count and its count as a previous word all
    meet there, and no group is that of a frequent word.  Words are compared by
    62 bits of hash.
    """
    names = [prefix + n for n in ("n_tokens", "target_loss", "background_loss", "difference")]
    clear = docs.drop(*names)
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))  # rows that share both have the same scores
    counts = materialize(word_counts(clear), "words")
    vocab, size = vocabulary(counts, frequent), counts.count() + 1
    rows = _labelled(clear.select("doc_id", "text", key.alias("key")), targets).withColumn("wanted", F.col("__id").isNotNull())
    tables = pair_counts(rows, F.col("wanted"), vocab)
    total = [int(c.sum()) for c in tables]
    scales = [1.0, total[0] / max(1, total[1])]
    known = [losses(c, x, size=size) for c, x in zip(tables, scales, strict=True)]
    before = [np.log(c.sum(axis=1) * x + PRIOR) for c, x in zip(tables, scales, strict=True)]
    word = [(c.sum(axis=0) * x + 1) / (n * x + size) for c, x, n in zip(tables, scales, total, strict=True)]
    shared = clear.sparkSession.sparkContext.broadcast((vocab, known, before))  # (frequent + 2) * (frequent + 1) cells a model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known, before = shared.value
        number, other = {w: i for i, w in enumerate(vocab)}, len(vocab)
        cache: dict[bytes, int] = {}

        def rows_of(key: int, text: str | None, wanted: bool) -> tuple | None:
            own = words(text)
            if not own:
                return None
            code = np.fromiter((number.get(w, other) for w in own), np.int64, len(own))
            full, rare = code.astype(np.uint64), np.nonzero(code == other)[0]
            full[rare] = _hashes([own[i] for i in rare], cache)
            prev = np.concatenate([[other + 1], code[:-1]])
            prev_full = np.concatenate([np.array([other + 1], np.uint64), full[:-1]])
            left = (code == other) | (prev == other)
            mine = [float(k[prev[~left], code[~left]].sum() + b[prev[left & (prev != other)]].sum()) for k, b in zip(known, before, strict=True)]
            at = np.nonzero(left)[0]
            is_rare = code[at] == other
            deal = np.where(is_rare, full[at], prev_full[at]).astype(np.int64)
            pair = np.where(is_rare, prev_full[at].astype(np.int64), -1 - code[at])
            order = np.lexsort((pair, deal))
            deal, pair = deal[order], pair[order]
            new = np.ones(len(at), bool)
            new[1:] = (deal[1:] != deal[:-1]) | (pair[1:] != pair[:-1])
            first = np.nonzero(new)[0]
            n = np.diff(first, append=len(at))
            deal, pair = deal[first], pair[first]
            # the text's last word is no previous word
            last = (deal == np.int64(full[-1])) & (pair == np.int64(prev_full[-1])) & (code[-1] == other)
            packed = (n << 2) | (int(wanted) << 1) | last
            # two rows before the pairs hold the number of tokens and the sums of what is known already
            return (
                np.concatenate([[key >> 2] * 2, deal]),
                np.concatenate([np.rint(np.array(mine) * FIXED).astype(np.int64), pair]),
                np.full(len(deal) + 2, key, np.int64),
                np.concatenate([[-2 * len(own), -2 * len(own) - 1], packed]),
            )

        for batch in batches:
            found = [r for r in map(rows_of, *(c.to_pylist() for c in batch.columns)) if r]
            for i in range(0, len(found), 256):
                cols = [np.concatenate(c) for c in zip(*found[i : i + 256], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["deal", "pair", "key", "packed"])

    spread = rows.select("key", "text", "wanted").mapInArrow(run, "deal long, pair long, key long, packed long")
    plain = [(-1 - i, *(float(p[i]) for p in word)) for i in range(len(vocab))]
    lookup = F.broadcast(clear.sparkSession.createDataFrame(plain, "frequent long, word_t double, word_b double"))
    n, wanted, last = F.shiftright("packed", 2), F.shiftright("packed", 1).bitwiseAND(F.lit(1)), F.col("packed").bitwiseAND(F.lit(1))
    own = F.when(F.col("pair") >= 0, n).otherwise(0)  # of the word itself, not of one that follows it
    # dealt and sorted as they are, before the windows add columns to each row; both windows use that one order
    spread = spread.repartition("deal").sortWithinPartitions("deal", "pair")
    same_word, same_pair = Window.partitionBy("deal"), Window.partitionBy("deal", "pair")
    sums = {"all_b": own, "all_t": own * wanted, "prev_b": own - last, "prev_t": (own - last) * wanted}
    spread = spread.select("*", *(F.sum(x).over(same_word).alias(name) for name, x in sums.items()))
    spread = spread.select("*", F.sum(n).over(same_pair).alias("pair_b"), F.sum(n * wanted).over(same_pair).alias("pair_t"))
    spread = spread.join(lookup, F.col("pair") == F.col("frequent"), "left")

    def loss(which: str, scale: float, tokens: int) -> Column:
        p = F.coalesce(F.col(f"word_{which}"), (F.col(f"all_{which}") * scale + 1) / F.lit(tokens * scale + size))
        seen = -n * F.log(F.col(f"pair_{which}") * scale + PRIOR * p)
        # what follows a word is charged with it where the word itself is, once for each time that a word follows
        after = F.when(F.col("pair") >= 0, (n - last) * F.log(F.col(f"prev_{which}") * scale + PRIOR)).otherwise(0.0)
        known = F.when(last == (0 if which == "t" else 1), F.col("pair") / FIXED).otherwise(0.0)
        return F.sum(F.when(F.col("packed") < 0, known).otherwise(seen + after))

    tokens = F.when((F.col("packed") < 0) & (last == 0), F.shiftright(-F.col("packed"), 1))
    sums = spread.groupBy(F.col("key").alias("__key")).agg(
        loss("t", scales[0], total[0]).alias("__t"),
        loss("b", scales[1], total[1]).alias("__b"),
        F.max(tokens).alias("__n"),
        F.sum(tokens).alias("__all"),
    )
    out = clear.withColumn("__key", key).join(sums, "__key", "left")
    values = F.coalesce("__n", F.lit(0).cast("long")), F.col("__t") / F.col("__all"), F.col("__b") / F.col("__all"), (F.col("__t") - F.col("__b")) / F.col("__all")
    return out.select(*clear.columns, *(v.alias(c) for v, c in zip(values, names, strict=True)))
