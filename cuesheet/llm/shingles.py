"""Word and shingle hashes of whole texts, many texts at a time.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a
shingle is a run of words.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

SIZE = 5
CHUNK_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OTHER = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(64)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _piece_words(raw: bytes, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word: a polynomial over its bytes, from differences of one running sum."""
    b = np.frombuffer(raw, np.uint8)
    edge = np.diff(~gap[b], prepend=False, append=False)
    at = np.nonzero(edge)[0]
    starts, ends = at[::2], at[1::2]
    n = 1 << max(10, (len(b) + 1).bit_length())
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LOWER[b] * _powers(_BASE, n)[: len(b)], out=total[1:])
    value = (total[ends] - total[starts]) * _powers(_INVERSE, n)[starts]
    return mixed(value + (ends - starts).astype(np.uint64)), starts


def _cuts(raw: bytes, gap: np.ndarray) -> Iterator[bytes]:
    """Pieces of about CHUNK_BYTES that end between words."""
    at = 0
    while at < len(raw):
        end = at + CHUNK_BYTES
        while end < len(raw) and not gap[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def word_hashes(texts: Iterable[str | None], alphanumeric: bool = False) -> Iterator[np.ndarray]:
    """The word hashes of each text; none for a null text.

    With ``alphanumeric``, words are runs of ASCII letters and digits and of non-ASCII characters.
    """
    gap = _OTHER if alphanumeric else _SPACE
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        words, starts = _piece_words(b" ".join(held), gap)
        ends = np.cumsum([len(x) + 1 for x in held])
        yield from np.split(words, np.searchsorted(starts, ends[:-1]))

    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        if held and size + len(raw) > CHUNK_BYTES:
            yield from flush()
            held, size = [], 0
        if len(raw) > CHUNK_BYTES:
            yield np.concatenate([_piece_words(piece, gap)[0] for piece in _cuts(raw, gap)])
            continue
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield from flush()


def shingles(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Shingle hashes by position; fewer words than ``size`` make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    total = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        total += words[j : n - k + 1 + j] * _STEPS[j]
    return mixed(total)


def shingle_sets(texts: Iterable[str | None], size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for words in word_hashes(texts):
        yield np.unique(shingles(words, size))


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte place of each word (ASCII letters and digits, non-ASCII characters) of a UTF-8 text."""
    places = []
    at = 0
    for piece in _cuts(raw, _OTHER):
        words, starts = _piece_words(piece, _OTHER)
        places.append((words, starts + at))
        at += len(piece)
    if not places:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*places, strict=True))
