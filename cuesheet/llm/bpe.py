"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's most frequent words are merged once and compiled into a minimal
acyclic automaton in which words share suffixes as well as prefixes.  Counts of
the words behind each edge turn an accepted path into the word's number, and
the number into its token ids.  The automaton is one flat array file that every
worker memory-maps; words it lacks are merged exactly on the spot.

The tokenizer file is that of a BPE model with an end-of-word suffix, over
byte-level characters, lower case, white space dropped.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from cuesheet.llm.common import give_back, most_frequent
from cuesheet.sinks.files import scratch_path

LEXICON_WORDS = 1 << 18
LEXICON_WORD_BYTES = 128
CHUNK_CHARS = 1 << 19
COUNTER_WORDS = 1 << 17
SHORT_WORD = 32
CHUNKS_KEPT = 1 << 17
MARKS = frozenset(",.;:!?)")
# Characters whose classes hang neither on the Unicode version nor on what counts as white space;
# a text with others is split by the tokenizer library's own tables.
RARE = re.compile("[^\u0000-\u001b\u0020-\u0084\u0086-\u0557\u2000-\u206f\u20a0-\u20bf\u3000-\u3029\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")


def _byte_characters() -> dict[int, str]:
    """Printable stand-ins for the 256 bytes: themselves, or the next free code from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """The tokenizer file: splits texts into words and merges single words."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): i for i, (a, b) in enumerate(pairs)}
        self.joined = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        character = _byte_characters()
        self.single = [self.vocab[character[b]] for b in range(256)]
        self.final = [self.vocab[character[b] + self.suffix] for b in range(256)]
        self.width = max(self.vocab.values()) + 1
        keys = np.array([a * self.width + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), np.int64)[order]

    @cached_property
    def text(self) -> dict[int, str]:
        return {i: t for t, i in (self.vocab | self.special).items()}

    def chunks(self, text: str) -> list[str]:
        """A whole text in pieces that no word crosses; ``words_of`` gives the words of each.

        Ordinary pieces are normalised and hold no white space.  A piece with a
        leading space is a word as it stands: a special token, or a word of a
        text with characters whose class the tokenizer library has to tell.
        """
        if self.apart is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[str] = []
        for i, piece in enumerate(self.apart.split(text)):
            out += [" " + piece] if i % 2 else self._plain(piece)
        return out

    def words_of(self, chunk: str) -> list[str]:
        if chunk.isalpha():  # letters alone are one word, and letters with one mark behind are two
            return [chunk]
        if chunk[-1] in MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return [chunk[1:]] if chunk[0] == " " else self.word.findall(chunk)

    def words(self, text: str) -> list[str]:
        return [w for c in self.chunks(text) for w in self.words_of(c)]

    def _plain(self, text: str) -> list[str]:
        if RARE.search(text):
            clean, split = self._library()
            return [" " + w for w, _ in split.pre_tokenize_str(clean.normalize_str(text))]
        # lower case goes character by character, so a sigma at a word's end is no special case
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().split()

    @lru_cache(maxsize=1)  # noqa: B019  one instance per file lives as long as the worker
    def _library(self):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        clean = Tokenizer.from_file(self.path).normalizer
        return clean, pre_tokenizers.Split(Regex(self.word.pattern), "removed", invert=True)

    def merge(self, word: str) -> list[int]:
        """Token ids of one word: the adjacent pair of lowest rank is merged, leftmost first, until none has a rank."""
        if word in self.special:
            return [self.special[word]]
        raw = word.encode("utf-8", "replace")
        ids = [self.single[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        n, rank = len(ids), self.ranks.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            # a pair is stale once one of its ends was merged with another token
            if ids[i] < 0 or j >= n or rank((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j], after[i] = self.joined[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank((ids[i], ids[after[i]]))) is not None:
                    heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank((ids[before[i]], ids[i]))) is not None:
                heappush(heap, (r, before[i]))
        return [x for x in ids if x >= 0]

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many words: all token ids behind each other, and how many each word has.

        Words of similar length are the rows of a table; each step merges, in
        every row, the leftmost pair of the row's lowest rank.
        """
        raw = [w.encode("utf-8", "replace") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        alone = {i: self.merge(words[i]) for i in np.nonzero(length > SHORT_WORD)[0].tolist()}
        if self.special:
            alone |= {i: [self.special[w]] for i, w in enumerate(words) if w in self.special}
        size = length.copy()
        for i, own in alone.items():
            size[i], length[i] = len(own), 0
        tables, low = [], 0
        for high in (4, 8, 12, 16, 24, SHORT_WORD):
            rows = np.nonzero((length > low) & (length <= high))[0]
            low = high
            if len(rows):
                table, size[rows] = self._merge_rows(b"".join(raw[i] for i in rows.tolist()), length[rows], high)
                tables.append((rows, table))
        first = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), np.int32)
        for rows, table in tables:
            ids[_spans(first[rows], size[rows])] = table[np.arange(table.shape[1]) < size[rows, None]]
        for i, own in alone.items():
            ids[first[i] : first[i] + size[i]] = own
        return ids, size

    def _merge_rows(self, raw: bytes, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of ``size`` bytes, ``width`` at most, merged: a row of ids each, and how many of them count."""
        flat, end = np.frombuffer(raw, np.uint8), np.cumsum(size)
        ids = np.array(self.single, np.int64)[flat]
        ids[end - 1] = np.array(self.final, np.int64)[flat[end - 1]]
        at, out, sizes = np.arange(width), np.zeros((len(size), width), np.int64), size.copy()
        out[at < size[:, None]] = ids
        who, now, n = np.arange(len(size)), out.copy(), size.copy()
        rank = self._rank(now[:, :-1], now[:, 1:])
        none = len(self.joined)
        rank[at[1:] >= n[:, None]] = none
        joined = np.array(self.joined, np.int64)
        while len(who):
            i = rank.argmin(axis=1)
            best = rank[np.arange(len(who)), i]
            go = best < none
            if not go.all():
                out[who[~go]], sizes[who[~go]] = now[~go], n[~go]
                who, now, n, rank, i, best = who[go], now[go], n[go], rank[go], i[go], best[go]
            row = np.arange(len(who))
            now[row, i] = joined[best]
            now = np.take_along_axis(now, np.minimum(at + (at > i[:, None]), width - 1), 1)
            rank = np.take_along_axis(rank, np.minimum(at[:-1] + (at[:-1] >= i[:, None]), width - 2), 1)
            rank[:, -1] = none
            n = n - 1
            left, right = np.nonzero(i > 0)[0], np.nonzero(i + 1 < n)[0]
            rank[left, i[left] - 1] = self._rank(now[left, i[left] - 1], now[left, i[left]])
            rank[right, i[right]] = self._rank(now[right, i[right]], now[right, i[right] + 1])
            ended = np.nonzero((i + 1 >= n) & (i < width - 1))[0]
            rank[ended, i[ended]] = none
        return out, sizes

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; pairs that aren't merged have the rank behind the last."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.joined))


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


@lru_cache(maxsize=2)
def token_strings(path: str) -> pa.Array:
    """The string of each token id, null where there is none: all that decoding needs of the tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = [None] * (max(ids.values()) + 1)
    for t, i in ids.items():
        strings[i] = t
    return pa.array(strings, pa.large_string())


def release() -> None:
    """Let go of what a task leaves in its worker process, which the next stage may use for something else."""
    merger.cache_clear()
    give_back()


# --- the automaton -----------------------------------------------------------------


def compile_words(entries: Iterable[tuple[bytes, list[int]]]) -> np.ndarray:
    """The minimal acyclic transducer of (word, ids), words distinct and sorted, as one int32 array.

    Words are added in order; once the next word leaves a state, that state is
    final and is replaced by an equal one if there is any, so equal suffixes
    are stored once.
    Layout: counts of edges, states and words; edge keys (state * 256 + byte,
    ascending), edge targets, words passed by taking the edge, accepting
    states, offsets of the ids, ids.
    """
    register: dict[tuple, int] = {}
    edges: list[tuple] = []  # of each finished state: ((byte, state), ...)
    accepts: list[bool] = []
    open_: list[list] = [[False, []]]  # along the last word: [accepting, [(byte, state), ...]]
    last, offsets, ids = b"", [0], []

    def finish(depth: int) -> None:
        while len(open_) > depth + 1:
            accepting, out = open_.pop()
            key = (accepting, tuple(out))
            if (state := register.get(key)) is None:
                state = register[key] = len(edges)
                edges.append(key[1])
                accepts.append(accepting)
            open_[-1][1].append((last[len(open_) - 1], state))

    for word, out in entries:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        finish(shared)
        open_.extend([False, []] for _ in word[shared:])
        open_[-1][0] = True
        last = word
        ids += out
        offsets.append(len(ids))
    finish(0)
    edges.append(tuple(open_[0][1]))
    accepts.append(open_[0][0])
    root = len(edges) - 1

    behind = [0] * len(edges)  # words accepted from a state; targets come before sources
    for s, out in enumerate(edges):
        behind[s] = accepts[s] + sum(behind[t] for _, t in out)
    name = {root: 0} | {s: s + 1 for s in range(root)}
    keys, targets, passed = [], [], []
    for s in sorted(range(len(edges)), key=name.__getitem__):
        before = int(accepts[s])
        for byte, t in edges[s]:
            keys.append(name[s] * 256 + byte)
            targets.append(name[t])
            passed.append(before)
            before += behind[t]
    accepting = [int(accepts[s]) for s in sorted(range(len(edges)), key=name.__getitem__)]
    flat = [len(keys), len(edges), len(offsets) - 1, *keys, *targets, *passed, *accepting, *offsets, *ids]
    return np.array(flat, np.int32)


class Lexicon:
    """Looks up many words at once in a compiled (usually memory-mapped) array."""

    def __init__(self, flat: np.ndarray):
        n_edges, n_states, n_words = (int(x) for x in flat[:3])
        cuts = np.cumsum([3, n_edges, n_edges, n_edges, n_states, n_words + 1])
        self.keys, self.targets, self.passed, self.accepting, self.offsets = (
            flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)
        )
        self.ids = flat[cuts[-1] :]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1; all words take a step together."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return found
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live, step = np.nonzero(size > 0)[0], 0
        while len(live):
            key = state[live] * 256 + flat[start[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.targets[at]
            number[live] += self.passed[at]
            step += 1
            done = size[live] == step
            ended = live[done]
            hit = ended[self.accepting[state[ended]] == 1]
            found[hit] = number[hit]
            live = live[~done]
        return found


@lru_cache(maxsize=2)
def _mapped(name: str) -> Lexicon:
    return Lexicon(np.load(SparkFiles.get(name), mmap_mode="r"))


# --- over a corpus -----------------------------------------------------------------


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``word, n`` over all whole texts; a task adds up what it meets before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, counts = merger(tokenizer), Counter()

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for chunk, n in counts.items():
                for w in m.words_of(chunk):
                    words[w] += n
            counts.clear()
            out = [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(out, ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(m.chunks(text.as_py() or ""))
                if len(counts) > COUNTER_WORDS:
                    yield flush()
        yield flush()
        release()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words, ``words`` at most, and give every worker the file; its name.

    The number of words and their length (LEXICON_WORD_BYTES) bound the
    automaton, not the encoding: other words are merged where they occur.  The file goes to the shared checkpoint folder, from
    which executors (also later ones) fetch their own copy to map.
    """
    counts = word_counts(docs, tokenizer).where(F.octet_length("word") <= LEXICON_WORD_BYTES)
    top = most_frequent(counts, words).select(F.col("word").cast("binary")).toArrow()
    m = merger(tokenizer)
    words = sorted(top.column(0).to_pylist())
    ids, size = m.merge_all([w.decode() for w in words])
    cuts = np.cumsum(size)[:-1].tolist()
    flat = compile_words(zip(words, (own.tolist() for own in np.split(ids, cuts)), strict=False))
    return share_array(docs.sparkSession, flat)


def share_array(spark: SparkSession, flat: np.ndarray) -> str:
    """Save an array in the shared folder and add it to the job's files; the file's name."""
    import io

    data = io.BytesIO()
    np.save(data, flat)
    path = scratch_path(spark, "lexicon") + ".npy"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).create(target)
    stream.write(bytearray(data.getvalue()))
    stream.close()
    spark.sparkContext.addFile(target.getFileSystem(conf).makeQualified(target).toString())
    return path.rpartition("/")[2]


class Encoder:
    """Encodes texts, many at once; what it worked out for a piece of text is kept for later ones, within a bound."""

    def __init__(self, m: Merger, lexicon: Lexicon):
        self.merger, self.lexicon = m, lexicon
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.first, self.size, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the chunks met most often, half of the bound at most."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: CHUNKS_KEPT // 2])
        keep = keep[self.met[keep] > 1]
        names = list(self.place)
        self.place = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.met, size = self.met[keep] // 2, self.size[keep]
        self.ids = self.ids[_spans(self.first[keep], size)]
        self.first, self.size = np.cumsum(size) - size, size

    def encode(self, texts: list[str]) -> pa.ListArray:
        split = [self.merger.chunks(t) for t in texts]
        flat = [c for chunks in split for c in chunks]
        if len(self.place) > CHUNKS_KEPT:
            self._forget()
        place, new = self.place, []
        for c in flat:
            if c not in place:
                place[c] = len(place)
                new.append(c)
        if new:
            self._learn(new)
        order = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        self.met += np.bincount(order, minlength=len(place))
        size = self.size[order]
        out = self.ids[_spans(self.first[order], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        rows = np.concatenate([[0], np.cumsum([len(c) for c in split])]).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pa.array(out, pa.int32()))

    def _learn(self, chunks: list[str]) -> None:
        """Put the token ids of new chunks behind those at hand."""
        m, lexicon = self.merger, self.lexicon
        words = [[c] if c.isalpha() else m.words_of(c) for c in chunks]
        pieces = [w for own in words for w in own]
        place = {w: i for i, w in enumerate(dict.fromkeys(pieces))}

        # token ids of the distinct words side by side
        distinct = list(place)
        known = lexicon.numbers([w.encode("utf-8", "replace") for w in distinct])
        size = np.where(known >= 0, lexicon.offsets[known + 1] - lexicon.offsets[known], 0).astype(np.int64)
        miss, hit = np.nonzero(known < 0)[0], np.nonzero(known >= 0)[0]
        merged, size[miss] = m.merge_all([distinct[i] for i in miss.tolist()])
        first = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), np.int32)
        ids[_spans(first[hit], size[hit])] = lexicon.ids[_spans(lexicon.offsets[known[hit]], size[hit])]
        ids[_spans(first[miss], size[miss])] = merged

        # then those of the chunks
        at = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        cuts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size[at])])[cuts]
        self.first = np.concatenate([self.first, len(self.ids) + ends[:-1]])
        self.size = np.concatenate([self.size, np.diff(ends)])
        self.met = np.concatenate([self.met, np.zeros(len(chunks), np.int64)])
        self.ids = np.concatenate([self.ids, ids[_spans(first[at], size[at])]])


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after the other."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts.astype(np.int64) - (ends - sizes), sizes)


def encode(docs: DataFrame, tokenizer: str, lexicon: str, out: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with the token ids of each whole ``text`` in column ``out``; without the text itself if it isn't kept.

    A null or empty text has no ids.  Special tokens in a text get their ids.
    Each row is encoded for itself, repeated rows alike.
    """
    clear = docs.drop(out)
    at = clear.columns.index("text")
    stay = [i for i in range(len(clear.columns)) if keep_text or i != at]
    spec = StructType([*(clear.schema.fields[i] for i in stay), StructField(out, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merger(tokenizer), _mapped(lexicon))
        for batch in batches:
            for part in _chunks(batch, at):
                ids = encoder.encode([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in stay), ids], [*(part.schema.names[i] for i in stay), out])
        encoder.clear()
        release()

    return clear.mapInArrow(run, spec)


def _chunks(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch with about CHUNK_CHARS bytes of the variable-size column ``at``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(lengths) // CHUNK_CHARS
    starts = [0, *(np.nonzero(np.diff(cut))[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each row's token ids in column ``out``.

    The tokenizer file names no decoder, so the text is the tokens' strings
    with one space between; ids outside the vocabulary have none.  Null ids
    give null.
    """
    clear = encoded.drop(out)
    at = clear.columns.index(ids)
    spec = StructType([*clear.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_strings(tokenizer)
        named = table.is_valid().to_numpy(zero_copy_only=False)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                col = part.column(at)
                # the ids that have a string, and how many of them lie before each row's end
                flat = pc.fill_null(col.flatten(), -1).to_numpy(zero_copy_only=False)
                ok = (flat >= 0) & (flat < len(table))
                ok[ok] = named[flat[ok]]
                ends = np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))
                kept = np.concatenate([[0], np.cumsum(ok)])[np.concatenate([[0], ends])]
                strings = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), table.take(pa.array(flat[ok])))
                joined = pc.binary_join(strings, pa.scalar(" ", pa.large_string())).cast(pa.string())
                joined = pc.if_else(col.is_valid(), joined, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, joined], [*part.schema.names, out])
        give_back()

    return clear.mapInArrow(run, spec)
