"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the whole has a label.  Each
sentence has its own score, a logistic function of its words and pairs of
adjacent words; the document's score is their noisy-or, the chance that at
least one of them is toxic.  The weights are learned from document labels
alone, through that noisy-or, so that blame settles on the sentences which
toxic documents have and others don't; ``flag`` names them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from cuesheet.llm.shingles import mixed, word_places
from cuesheet.sinks.files import materialize

BITS = 18
SENTENCE_WORDS = 64
CHUNK_BYTES = 1 << 20
TRAIN_PER_LABEL = 10_000
LEAST_TOXIC = 3
LEAST_DEVIATIONS = 4.0
ROUNDS = 60
DECAY = 0.05
MEMORY = 8
OFFENDING = 0.5
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True  # newline ! . ?
_PAIR = np.uint64(0x9FB21C651E98DF25)


@dataclass
class Bags:
    """Sentences of some texts: their words and word pairs as numbers, side by side.

    ``features[i]`` stands in sentence ``sentence[i]``; sentence ``s`` lies in
    text ``text[s]``, at the bytes ``start[s]`` to ``end[s]`` of its UTF-8 form.
    """

    features: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _stretches(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Index of the first text, and texts of about CHUNK_BYTES together."""
    held: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if held and size + len(raw) > CHUNK_BYTES:
            yield first, held
            held, first, size = [], i, 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def bags(texts: Iterable[str | None]) -> Iterator[Bags]:
    """The sentences of whole texts, some texts at a time.

    A sentence ends at a full stop, a mark or a line's end, and after
    SENTENCE_WORDS words at the latest; one without words is none.
    """
    for first, raws in _stretches(texts):
        joined = b"\n".join(raws)
        size = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
        begins = np.cumsum(size) - size
        words, starts = word_places(joined)
        breaks = np.nonzero(_END[np.frombuffer(joined, np.uint8)])[0]
        run = np.searchsorted(breaks, starts)
        new = np.ones(len(words), bool)
        new[1:] = run[1:] != run[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(words)), 0)) if len(words) else np.zeros(0, np.int64)
        new |= (np.arange(len(words)) - head) % SENTENCE_WORDS == 0
        sentence = np.cumsum(new) - 1
        at = np.nonzero(new)[0]
        text = np.searchsorted(begins, starts[at], "right") - 1
        edges = np.append(breaks, len(joined))
        end = np.minimum(edges[run[at]], np.append(starts[at[1:]], len(joined)) if len(at) else edges[:0])
        pair = mixed(words[:-1] * _PAIR + words[1:])[~new[1:]]
        both = np.concatenate([words, pair]) >> np.uint64(64 - BITS)
        where = np.concatenate([sentence, sentence[1:][~new[1:]]])
        yield Bags(both.astype(np.int32), where, text + first, starts[at] - begins[text], end - begins[text])


@dataclass
class Model:
    """A weight by feature, and the bias of a sentence."""

    weights: np.ndarray
    bias: float

    def sentences(self, b: Bags) -> np.ndarray:
        """The log-odds of each sentence."""
        return np.bincount(b.sentence, self.weights[b.features], minlength=len(b.text)) + self.bias


def noisy_or(odds: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The chance that at least one sentence of each of ``n`` texts is toxic, from the sentences' log-odds."""
    return -np.expm1(-np.bincount(text, np.logaddexp(0, odds), minlength=n))


def slopes(
    theta: np.ndarray, features: np.ndarray, sentence: np.ndarray, text: np.ndarray, label: np.ndarray, weight: np.ndarray
) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the labels, and its slope by weight and (last) bias."""
    odds = np.bincount(sentence, theta[features], minlength=len(text)) + theta[-1]
    clean = np.bincount(text, np.logaddexp(0, odds), minlength=len(label))  # -log of the chance that no sentence is toxic
    toxic = np.maximum(-np.expm1(-clean), 1e-12)
    loss = np.where(label == 1, -np.log(toxic), clean) * weight
    by_text = np.where(label == 1, -np.exp(-clean) / toxic, 1.0) * weight
    by_sentence = by_text[text] * np.exp(-np.logaddexp(0, -odds))
    return float(loss.sum()), np.append(np.bincount(features, by_sentence[sentence], minlength=len(theta) - 1), by_sentence.sum())


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """L-BFGS with step halving; ``value`` gives a function's value and slope."""
    at, (fx, g) = start, value(start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, parts = g.copy(), []
        for s, y in reversed(steps):
            parts.append((s @ way) / (s @ y))
            way -= parts[-1] * y
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.linalg.norm(g))
        for (s, y), part in zip(steps, reversed(parts), strict=True):
            way += s * (part - (y @ way) / (s @ y))
        size = 1.0
        while True:
            new, (f_new, g_new) = at - size * way, value(at - size * way)
            if f_new <= fx - 1e-4 * size * (way @ g) or size < 1e-6:
                break
            size /= 2
        s, y = new - at, g_new - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        small = abs(fx - f_new) <= 1e-6 * abs(fx)
        at, fx, g = new, f_new, g_new
        if small:
            break
    return at


# --- over a corpus -----------------------------------------------------------------


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = TRAIN_PER_LABEL) -> DataFrame:
    """``text, label, weight`` of about ``per_label`` different texts of each label (all, if fewer), by hash of the text.

    Copies of a text are one, toxic if any of them is labelled so.  A weight
    makes the drawn texts of a label stand for all of them.
    """
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    rows = docs.where(usable & F.col("text").isNotNull()).select("doc_id", "text").withColumn("__h", F.xxhash64("text"))
    known = rows.select("doc_id", "__h").join(marks, "doc_id").groupBy("__h").agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id"))
    known = materialize(known, "labelled")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    shares = {x: min(1.0, per_label / n) for x, n in sizes.items()}
    share = F.coalesce(*(F.when(F.col("label") == x, F.lit(s)) for x, s in shares.items()), F.lit(1.0))
    drawn = known.where(F.pmod(F.col("__h"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("weight", 1 / share)
    # some 2 * per_label rows of numbers; the same row twice is one
    return rows.join(F.broadcast(drawn), ["doc_id", "__h"]).dropDuplicates(["__h"]).select("text", "label", "weight")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = TRAIN_PER_LABEL) -> Model:
    """Learn sentence weights from the labels of whole documents.

    ``labels`` (doc_id, toxic) names documents of ``docs`` (doc_id, text); only
    ``usable`` rows are looked at.  Features that toxic documents don't have
    clearly more often (by LEAST_DEVIATIONS standard deviations) weigh nothing.
    Every evaluation of the likelihood is a Spark job over the sample's
    remaining features; the driver holds a number by feature.
    Without labels of both kinds there is nothing to learn, and no sentence is
    toxic.
    """
    sample = training_sample(docs, labels, usable, per_label)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for b in bags(batch.column(0).to_pylist()):
                if not len(b.text):
                    continue
                of = b.text[b.sentence]
                order = np.argsort(of, kind="stable")
                texts, sentences = np.unique(b.text, return_counts=True)
                cuts = np.append(np.searchsorted(of[order], texts), len(of)).astype(np.int32)
                first = np.searchsorted(b.text, texts)
                within = b.sentence[order] - np.repeat(first, np.diff(cuts))
                lists = (pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order] if x is b.features else x)) for x in (b.features, within.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[texts], pa.int32()), pa.array(weight[texts]), pa.array(sentences.astype(np.int32)), *lists],
                    ["label", "weight", "sentences", "features", "places"],
                )

    kind = "label int, weight double, sentences int, features array<int>, places array<int>"
    whole = materialize(sample.mapInArrow(split, kind), "bags")
    n, toxic = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return Model(np.zeros(1 << BITS), -np.inf)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            of, features = _flat(batch.column(1))
            both = np.unique(of * (1 << BITS) + features)
            for x in (0, 1):
                found[x] += np.bincount(both[label[both >> BITS] == x] & ((1 << BITS) - 1), minlength=1 << BITS)
        hit = np.nonzero(found.sum(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(found.sum(axis=0)[hit]), pa.array(found[1][hit])], ["feature", "n", "toxic"])

    counts = whole.select("label", "features").mapInArrow(frequencies, "feature int, n long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    prior = toxic / n
    beyond = (F.col("toxic") - F.col("n") * prior) / F.sqrt(F.col("n") * (prior * (1 - prior)))
    telling = counts.where((F.col("toxic") >= LEAST_TOXIC) & (beyond >= LEAST_DEVIATIONS)).select("feature").collect()  # 2^BITS at most
    kept = np.sort(np.array([r["feature"] for r in telling], np.int64))
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, features = _flat(batch.column(3))
            own = place[features]
            cuts = np.searchsorted(of[own >= 0], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[own >= 0])) for x in (own, _flat(batch.column(4))[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], batch.schema.names)

    evidence = materialize(whole.mapInArrow(reduce, kind), "evidence")
    total, sentences = evidence.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("sentences"))).first()

    def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope = 0.0, np.zeros(len(theta))
            for batch in batches:
                label, weight, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                of, features = _flat(batch.column(3))
                sentence = (np.cumsum(size) - size)[of] + _flat(batch.column(4))[1]
                f, g = slopes(theta, features, sentence, np.repeat(np.arange(len(size)), size), label, weight)
                loss, slope = loss + f, slope + g
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tolist()])], ["loss", "slope"])

        # one row a task, and the sample bounds the tasks
        parts = evidence.mapInArrow(run, "loss double, slope array<double>").collect()
        pull = DECAY * theta[:-1]
        loss = sum(r["loss"] for r in parts) + pull @ theta[:-1] / 2
        return loss / total, (np.sum([r["slope"] for r in parts], axis=0) + np.append(pull, 0)) / total

    start = np.zeros(len(kept) + 1)
    start[-1] = np.log(max(prior, 1e-6) * total / sentences)
    theta = minimise(value, start)
    weights = np.zeros(1 << BITS)
    weights[kept] = theta[:-1]
    return Model(weights, float(theta[-1]))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element of a column of arrays without nulls."""
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)


def flag(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with score, predicted and offending added, each named with ``prefix``.

    ``offending`` lists the sentences with a score of OFFENDING or more: where
    they begin (in characters), their text and score.  A null or empty text,
    or one without words, has no sentences and score 0.  Repeated rows get the
    same answer each; only text is read, and all of it.  Columns of ``docs``
    with those names are replaced.
    """
    names = [prefix + x for x in ("score", "predicted", "offending")]
    place = StructType([StructField("at", LongType()), StructField("sentence", StringType()), StructField("score", DoubleType())])
    clear = docs.drop(*names)
    types = (DoubleType(), IntegerType(), ArrayType(place))
    spec = StructType(clear.schema.fields + [StructField(n, t) for n, t in zip(names, types, strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers
    at = clear.columns.index("text")
    kind = pa.list_(pa.struct([("at", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            score, offending = np.zeros(len(texts)), [[] for _ in texts]
            for b in bags(texts):
                odds = model.sentences(b)
                score += noisy_or(odds, b.text, len(texts))
                chance = np.exp(-np.logaddexp(0, -odds))
                last = None
                for s in np.nonzero(chance >= OFFENDING)[0]:
                    i, start, end = int(b.text[s]), int(b.start[s]), int(b.end[s])
                    if i != last:
                        last, raw, seen, before = i, texts[i].encode("utf-8", "replace"), 0, 0
                    before += len(raw[seen:start].decode("utf-8", "replace"))
                    seen = start
                    own = raw[start:end].decode("utf-8", "replace").rstrip()
                    offending[i].append({"at": before, "sentence": own, "score": float(chance[s])})
            more = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(offending, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    return clear.mapInArrow(run, spec)
