"""License scans: MinHash bands over text windows, then exact containment.

A template is a set of word shingles.  Texts are covered by overlapping windows
such that every stretch as long as a template lies whole within one; a window
and a template that share a MinHash band are compared exactly: the template is
found where at least ``CONTAINED`` of its shingles occur in the window.

The number of bands follows from that share.  A window that holds so much of a
template has a Jaccard similarity J with it of at least a known floor, each of
b bands of r rows agrees with probability J^r, and b is the smallest number
that keeps the chance of a miss, (1 - J^r)^b, under ``MISS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuesheet.llm.shingles import SIZE, mixed, shingles, word_hashes

CONTAINED = 0.8
MISS = 1e-6
ROWS = 1
CHUNK_WORDS = 1 << 16

# Short statements and the notices that licenses ask to include.
TEMPLATES = {
    "All-rights-reserved": "All rights reserved.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License."
    ),
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."
    ),
    "ISC-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
}


class Scanner:
    """The templates' shingles, windows and bands."""

    def __init__(self, templates: dict[str, str], contained: float = CONTAINED, miss: float = MISS, rows: int = ROWS):
        self.names = list(templates)
        self.contained, self.rows = contained, rows
        self.sets, classes = [], {}
        for i, words in enumerate(word_hashes(templates.values(), alphanumeric=True)):
            size = min(SIZE, len(words))
            self.sets.append(np.unique(shingles(words, size)) if size else np.zeros(0, np.uint64))
            if size:
                classes.setdefault((size, len(words) - size + 1), []).append(i)
        # by (shingle size, shingles in a row): window length, its step and the bands' tables
        self.plans = []
        for (size, run), members in sorted(classes.items()):
            step = max(1, run // 2) + 1
            width = run + step - 1
            least = min(self.need(i) / (width + len(self.sets[i]) - self.need(i)) for i in members)
            bands = 1 if least >= 1 else math.ceil(math.log(miss) / math.log(1 - least**rows))
            tables = []
            for band in range(bands):
                key = np.stack([self._key(self.sets[i][None], band) for i in members])[:, 0]
                order = np.argsort(key)
                tables.append((key[order], np.array(members)[order]))
            self.plans.append((size, width, step, tables))

    def need(self, i: int) -> int:
        """Shingles of template i that have to occur."""
        return max(1, math.ceil(self.contained * len(self.sets[i]) - 1e-9))

    def _key(self, windows: np.ndarray, band: int) -> np.ndarray:
        """The band's MinHash of each row of shingles."""
        out = np.zeros(len(windows), np.uint64)
        for row in range(self.rows):
            seed = mixed(np.array([band * self.rows + row + 1], np.uint64))[0]
            out = out * np.uint64(31) + ((windows ^ seed) * (seed | np.uint64(1))).min(axis=1)
        return out

    def _keys(self, flat: np.ndarray, width: int, step: int, band: int) -> np.ndarray:
        """``_key`` of the windows of ``width`` at every ``step`` of one long row, hashing each shingle once."""
        out = None
        for row in range(self.rows):
            seed = mixed(np.array([band * self.rows + row + 1], np.uint64))[0]
            value = (flat ^ seed) * (seed | np.uint64(1))
            n = (len(value) - width) // step + 1
            low = value[: (n - 1) * step + 1 : step].copy()
            for j in range(1, width):  # whole columns at a time
                np.minimum(low, value[j : j + (n - 1) * step + 1 : step], out=low)
            out = low if out is None else out * np.uint64(31) + low
        return out

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int]]:
        """(text, template, share of its shingles, first word) of what is found, the best window of each."""
        held, first, count = [], 0, 0
        for i, words in enumerate(word_hashes(texts, alphanumeric=True)):
            held.append(words)
            count += len(words)
            if count >= CHUNK_WORDS:
                yield from self._scan(held, first)
                held, first, count = [], i + 1, 0
        if held:
            yield from self._scan(held, first)

    def _scan(self, held: list[np.ndarray], first: int) -> Iterator[tuple[int, int, float, int]]:
        words = np.concatenate(held)
        row = np.repeat(np.arange(len(held)), [len(w) for w in held])
        begin = np.cumsum([0, *(len(w) for w in held)])
        best: dict[tuple[int, int], tuple[float, int]] = {}
        flats: dict[int, np.ndarray] = {}
        for size, width, step, tables in self.plans:
            if len(words) < size:
                continue
            if size not in flats:
                flats[size] = shingles(words, size)
            flat = flats[size]
            # the last window is filled up with the last shingle
            fill = width - len(flat) if len(flat) < width else -(len(flat) - width) % step
            padded = np.concatenate([flat, np.full(fill, flat[-1])])
            found = set()
            for band, (keys, members) in enumerate(tables):
                own = self._keys(padded, width, step, band)
                low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                for w in np.nonzero(high > low)[0].tolist():
                    found.update((w, int(members[k])) for k in range(low[w], high[w]))
            for w, template in sorted(found):
                a, b = w * step, min(w * step + width, len(flat))
                place = np.arange(a, b)
                same = row[place] == row[place + size - 1]  # a shingle lies within one text
                place = place[same & np.isin(flat[place], self.sets[template])]
                for r in np.unique(row[place]).tolist():
                    own = place[row[place] == r]
                    n = len(np.unique(flat[own]))
                    if n >= self.need(template):
                        new = (n / len(self.sets[template]), int(begin[r] - own[0]))
                        key = (r, template)
                        best[key] = max(best.get(key, new), new)
        for (r, template), (share, at) in sorted(best.items()):
            yield first + r, template, share, -at


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """``doc_id, license, containment, first_word``: the templates found in each row of ``docs`` (doc_id, text).

    Words are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased; shingles are five words, or the whole of a shorter template.
    ``containment`` is the highest share of the template's shingles in a
    window, ``first_word`` the earliest place of that share.  Null, empty and
    wordless texts hold nothing; templates without words are never found;
    repeated rows are reported each; other columns are ignored.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, contained)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)  # the templates and their bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            hits = list(scanner.scan(batch.column(1).to_pylist()))
            cols = [
                batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                pa.array([scanner.names[h[1]] for h in hits], pa.string()),
                pa.array([h[2] for h in hits], pa.float64()),
                pa.array([h[3] for h in hits], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "license", "containment", "first_word"])

    spec = "doc_id long, license string, containment double, first_word long"
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, spec)
