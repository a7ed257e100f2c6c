"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are runs of letters and digits, A to Z in lower case.  A template's and a
window's shingles are of five words.  For each template length windows of that
many shingles overlap; the number of bands is set so that a window that holds
the template at the least containment collides with it almost surely.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import by_bytes, passed
from heronlake.llm.tokenhash import PUNCT, buffer, mix, ngram_hashes, word_hashes, word_spans

SIZE, ROWS, PERCENT = 5, 2, 80
#: The chance that a true window meets its template in no band is below this.
MISS = 1e-4

#: Public licence notices and statements of them (fixed values).
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "CC0-1.0": ("Released under CC0 1.0 Universal.",),
}

SPAN = T.StructType([T.StructField("license", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("containment", T.DoubleType())])
_SPAN_ARROW = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' shingle hashes one after the other, and where each text's start, with the end."""
    data, offsets = buffer(column)
    starts, lengths, first = word_spans(data, offsets, PUNCT)
    grams = ngram_hashes(word_hashes(data, starts, lengths), SIZE)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    whole = row[: len(grams)] == row[SIZE - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    counts = np.bincount(row[: len(grams)][whole], minlength=len(column))
    return grams[whole], np.concatenate([[0], np.cumsum(counts)])


def stride_of(m: int) -> int:
    """How far apart windows for templates of m shingles start: a power of two, at most an eighth of the length."""
    return 1 << max(0, (m // 8).bit_length() - 1)


def bands_of(m: int, percent: int = PERCENT) -> int:
    """The bands for templates of m shingles.

    A text that contains ``ceil(percent * m)`` of them has a window, at most
    half a stride off, whose Jaccard similarity is at least j; a band of ROWS
    rows collides with chance j ** ROWS.
    """
    held = ceil(percent * m / 100)
    off = stride_of(m) // 2
    j = max(1, held - off) / (2 * m - max(1, held - off))
    return 1 if j >= 1 else ceil(log(MISS) / log(1 - j**ROWS))


class Bands:
    """Templates by length, their signatures' band keys and their exact shingles."""

    def __init__(self, templates: dict[str, tuple[str, ...]], percent: int = PERCENT):
        self.percent = percent
        self.items = []
        for name, texts in templates.items():
            for text in texts:
                found, _ = shingles(pa.array([text]))
                if len(found):
                    self.items.append((name, np.unique(found), len(found)))
        self.lengths = sorted({m for _, _, m in self.items})
        self.rows = max([bands_of(m, percent) for m in self.lengths], default=0) * ROWS
        self.salts = mix(np.arange(1, 2 * self.rows + 1, dtype=np.uint64)).reshape(-1, 2)
        self.keys = {}
        for m in self.lengths:
            mine = [i for i, x in enumerate(self.items) if x[2] == m]
            signature = np.array([[int(self.permuted(self.items[i][1], r).min()) for r in range(self.rows)] for i in mine], dtype=np.uint64)
            per_band = []
            for b in range(bands_of(m, percent)):
                keys = self.band(signature[:, b * ROWS], signature[:, b * ROWS + 1], b)
                seen = np.zeros(1 << 16, dtype=bool)
                seen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
                per_band.append((keys, seen))
            self.keys[m] = (mine, per_band)

    def permuted(self, grams: np.ndarray, row: int) -> np.ndarray:
        """The shingle hashes in the order of one row of the signatures."""
        with np.errstate(over="ignore"):
            return (grams ^ self.salts[row, 0]) * (self.salts[row, 1] | np.uint64(1))

    @staticmethod
    def band(a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(number))

    def retrieve(self, grams: np.ndarray) -> set[tuple[int, int]]:
        """(template, first shingle of a window) pairs of which a band collides."""
        out: set[tuple[int, int]] = set()
        if not len(grams):
            return out
        before: dict[int, np.ndarray] = {}
        for row in range(self.rows):
            minima = Minima(self.permuted(grams, row))
            now = {m: minima.windows(m, stride_of(m)) for m in self.lengths if row < len(self.keys[m][1]) * ROWS}
            if row % ROWS == ROWS - 1:
                band = row // ROWS
                for m, least in now.items():
                    mine, per_band = self.keys[m]
                    keys, seen = per_band[band]
                    key = self.band(before[m], least, band)
                    at = np.flatnonzero(seen[(key & np.uint64(0xFFFF)).astype(np.int64)])
                    for k, template in zip(keys, mine, strict=True):
                        out.update((template, int(w) * stride_of(m)) for w in at[key[at] == k])
            before = now
        return out

    def verify(self, grams: np.ndarray, first: int, end: int, template: int, at: int) -> tuple[int, int, float] | None:
        """The exact share of a template's shingles in a window and what is beside it, in one text: (first, end, share)."""
        _, own, m = self.items[template]
        low, high = max(first, at - m // 4), min(end, at + m + m // 4)
        hit = np.flatnonzero(np.isin(grams[low:high], own))
        share = len(np.unique(grams[low:high][hit])) / len(own)
        return (low + int(hit[0]), low + int(hit[-1]) + 1, share) if share * 100 >= self.percent else None


class Minima:
    """The least hashes of windows, built by doubling and shared between lengths."""

    def __init__(self, hashed: np.ndarray):
        self.known = {(1, 1): hashed}

    def blocks(self, stride: int) -> np.ndarray:
        """The least hash of each block of ``stride`` shingles."""
        if (stride, 1) not in self.known:
            half = self.blocks(stride // 2)
            if len(half) % 2:
                half = np.append(half, half[-1])
            self.known[stride, 1] = np.minimum(half[::2], half[1::2])
        return self.known[stride, 1]

    def runs(self, stride: int, width: int) -> np.ndarray:
        """The least hash of ``width`` blocks from each on, width a power of two; runs over the end are shorter."""
        if width == 1:
            return self.blocks(stride)
        if (stride, width) not in self.known:
            self.known[stride, width] = ahead(self.runs(stride, width // 2), width // 2)
        return self.known[stride, width]

    def windows(self, m: int, stride: int) -> np.ndarray:
        """The least hash of each window of m shingles, windows starting at multiples of ``stride``."""
        blocks = -(-m // stride)
        width = 1 << blocks.bit_length() - 1
        return ahead(self.runs(stride, width), blocks - width) if blocks > width else self.runs(stride, width)


def ahead(a: np.ndarray, by: int) -> np.ndarray:
    """The lesser of each element and the one ``by`` places on, where there is one."""
    if by >= len(a):
        return a
    return np.concatenate([np.minimum(a[:-by], a[by:]), a[-by:]])


def scan_column(bands: Bands, column: pa.Array) -> list[list[dict]]:
    """The verified spans of each text; where those of several licences overlap, the most contained ones stay."""
    grams, begin = shingles(column)
    found: list[dict[tuple[int, int], tuple[int, float]]] = [{} for _ in range(len(column))]
    for template, at in sorted(bands.retrieve(grams)):
        m = bands.items[template][2]
        # A window may reach over the end of a text: each text it touches is tried.
        row = int(np.searchsorted(begin, at, side="right")) - 1
        while row < len(column) and begin[row] < at + m:
            if begin[row + 1] > begin[row] and (span := bands.verify(grams, int(begin[row]), int(begin[row + 1]), template, at)):
                key = (template, span[0] - int(begin[row]))
                end, share = found[row].get(key, (0, 0.0))
                found[row][key] = (max(end, span[1] - int(begin[row])), max(share, span[2]))
            row += 1
    out = []
    for spans in found:
        rows: list[dict] = []
        for (template, start), (end, share) in sorted(spans.items(), key=lambda x: (x[0][1], bands.items[x[0][0]][0], -x[1][0])):
            name = bands.items[template][0]
            # Windows that overlap see the same notice.
            if rows and any(r["license"] == name and start < r["end_word"] and r["first_word"] < end + SIZE - 1 for r in rows):
                for r in rows:
                    if r["license"] == name and start < r["end_word"] and r["first_word"] < end + SIZE - 1:
                        r["end_word"], r["containment"] = max(r["end_word"], end + SIZE - 1), max(r["containment"], share)
                        break
            else:
                rows.append({"license": name, "first_word": start, "end_word": end + SIZE - 1, "containment": share})
        out.append([r for r in rows if not any(x["containment"] > r["containment"] and x["first_word"] < r["end_word"] and r["first_word"] < x["end_word"] for x in rows)])
    return out


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, tuple[str, ...]] | None = None, percent: int = PERCENT) -> DataFrame:
    """``keep`` and an array ``spans`` of (license, first_word, end_word, containment) of every whole text.

    Null and empty texts, and texts of fewer than five words, have none.
    Templates shorter than five words can't be found and are ignored.  The
    templates are a parameter and small, so they go to every task; there is no
    shuffle, and copies of a text and repeated rows are simply scanned.  A
    kept column named spans gives way.
    """
    keep = passed(keep, ("spans",))
    bands = Bands(TEMPLATES if templates is None else templates, percent)
    source = docs.select(*keep, text)
    schema = docs.select(*keep).schema.add("spans", T.ArrayType(SPAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, len(keep), 1 << 19):
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scan_column(bands, part.column(len(keep))), _SPAN_ARROW)], names=schema.names)

    return source.mapInArrow(run, schema)


def digest(spans):
    """``license:first:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["license"], s["first_word"].cast("string"), s["end_word"].cast("string"))), ",")
