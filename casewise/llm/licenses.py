"""License scan: words shared with a template near one diagonal are counted, then a banded alignment of words."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import Words, table, text_slices

#: Words by which a copy may run ahead of or behind its template: a quarter of it, from 1 to this many.
BAND = 8
COVERAGE = 0.8
MATCH, MISS = 2, -1

# License statements and notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "All rights reserved."),
]


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash, the last of equals, of every ``window`` hashes in a row."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.array([], int)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def band_of(n: int) -> int:
    """Words by which a copy of a template of ``n`` words may run ahead or behind."""
    return max(1, min(BAND, n // 4))


class TemplateIndex:
    """Words of the templates, and an inverted index of all of them."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float = COVERAGE):
        self.names = [name for name, _ in templates]
        self.words: list[np.ndarray] = []
        posts = []
        for at, (_, text) in enumerate(templates):
            raw = np.frombuffer(text.encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)])).hash
            self.words.append(words)
            posts.extend((int(h), at, offset) for offset, h in enumerate(words))
        posts.sort()
        self.needs = [max(1, math.ceil(coverage * len(words) - 1e-9)) for words in self.words]
        self.longest = max((len(words) for words in self.words), default=0)
        self.hashes = np.array([p[0] for p in posts], np.uint64)
        self.template = np.array([p[1] for p in posts], np.int64)
        self.offset = np.array([p[2] for p in posts], np.int64)
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def candidates(self, words: Words) -> list[tuple[int, int, int]]:
        """(text, template, diagonal), sorted, of every place where a copy may run.

        A diagonal is the place of the template's first word if the copy ran evenly. A copy of which enough words
        match has as many shared words on diagonals of twice the band, so each diagonal that starts such a group
        is a candidate, and no copy is missed.
        """
        at = np.flatnonzero(self.quick[(words.hash >> np.uint64(48)).astype(np.int64)])
        low, high = (np.searchsorted(self.hashes, words.hash[at], side) for side in ("left", "right"))
        count = high - low
        place, low = np.repeat(at, count), np.repeat(low, count)
        post = low + np.arange(len(low)) - np.repeat(np.cumsum(count) - count, count)
        if not len(post):
            return []
        # Texts stand apart on the axis of diagonals, and templates on an axis of those.
        gap = self.longest + 2 * BAND + 2
        shift = np.arange(len(words.first) - 1) * gap + self.longest
        text = np.searchsorted(words.first, place, "right") - 1
        width = int(words.first[-1]) + int(shift[-1]) + gap
        key = np.sort(self.template[post] * width + place - self.offset[post] + shift[text])
        out = []
        ends = np.searchsorted(key, np.arange(len(self.words) + 1) * width)
        for t, need in enumerate(self.needs):
            lane = key[ends[t] : ends[t + 1]] - t * width
            if len(lane) < need:
                continue
            lane = np.unique(lane[: len(lane) - need + 1][lane[need - 1 :] - lane[: len(lane) - need + 1] <= 2 * band_of(len(self.words[t]))])
            text = np.searchsorted(words.first[:-1] + shift - self.longest + 1, lane, "right") - 1
            out.extend((d, t, s) for d, s in zip(text.tolist(), (lane - shift[text]).tolist()))
        return sorted(out)


def _apart(copies: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The copies (matched, first, past) that no better one overlaps, by place."""
    kept: list[tuple[int, int, int]] = []  # first, past, matched
    for matched, a, b in sorted(copies, key=lambda c: (-c[0], c[2] - c[1], c[1])):
        at = bisect_left(kept, (a, b, 0))
        if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
            insort(kept, (a, b, matched))
    return [(matched, a, b) for a, b, matched in kept]


def align(template: np.ndarray, text: np.ndarray, start: int, band: int) -> tuple[int, int, int]:
    """Best local alignment of a template with the words of a text near the diagonal ``start``.

    Returns (words matched, first word, past the last word). Cells more than ``band`` off the diagonal are not
    looked at, so the work is the template's length times the band.
    """
    best = (0, 0, 0, 0)  # score, matched, first, past
    above: dict[int, tuple[int, int, int]] = {}
    for i in range(len(template)):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, start + i - band), min(len(text), start + i + band + 1)):
            same = bool(template[i] == text[j])
            score, matched, first = above.get(j - 1, (0, 0, j))
            if score <= 0:
                score, matched, first = 0, 0, j
            cell = (score + (MATCH if same else MISS), matched + same, first)
            for other in (above.get(j), row.get(j - 1)):
                if other and other[0] + MISS > cell[0]:
                    cell = (other[0] + MISS, other[1], other[2])
            row[j] = cell
            if same and cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best[1], best[2], best[3]


def can_match(template: np.ndarray, text: np.ndarray, start: int, band: int, need: int) -> bool:
    """Whether an alignment within the band may match ``need`` words.

    Every matched pair has a template word and a text word of its own, so no alignment matches more words than either
    side has with an equal word in the band.
    """
    low = max(0, start - band)
    part = text[low : max(low, start + len(template) + band)]
    places = np.arange(len(template))[:, None] + np.arange(start - band, start + band + 1) - low
    inside = (places >= 0) & (places < len(part))
    if not inside.any():
        return False
    same = inside & (part[np.clip(places, 0, len(part) - 1)] == template[:, None])
    if np.count_nonzero(same.any(axis=1)) < need:
        return False
    hit = np.zeros(len(part), bool)
    hit[places[same]] = True
    return np.count_nonzero(hit) >= need


def _scan(index: TemplateIndex):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in text_slices(batch.column("text")):
                words = Words(data, bounds)
                found: dict[tuple[int, int], set] = {}
                last, whole = None, 0
                for d, t, s in index.candidates(words):
                    if last == (d, t) and s <= whole:
                        continue  # the group holds a whole copy, which is found
                    if last != (d, t):
                        last, whole = (d, t), s - 1
                    band = band_of(len(index.words[t]))
                    first, past = int(words.first[d]), int(words.first[d + 1])
                    text, start = words.hash[first:past], s + band - first
                    if not can_match(index.words[t], text, start, band, index.needs[t]):
                        continue
                    matched, a, b = align(index.words[t], text, start, band)
                    if matched >= index.needs[t]:
                        found.setdefault((d, t), set()).add((matched, a, b))
                    if matched == b - a == len(index.words[t]):
                        whole = first + a
                rows = [(d, t, *copy) for (d, t), copies in found.items() for copy in _apart(copies)]
                out = []
                for d, t, matched, a, b in rows:
                    low, first = int(bounds[d]), int(words.first[d])
                    spot = [int(np.count_nonzero((data[low : int(e)] & 0xC0) != 0x80)) for e in (words.start[first + a], words.end[first + b - 1])]
                    out.append((at + d, index.names[t], t, matched, matched / len(index.words[t]), *spot))
                if out:
                    columns = list(zip(*out))
                    kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(columns[0])), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]],
                        ["id", "license", "template", "words", "coverage", "start", "end"],
                    )

    return scan


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, coverage: float = COVERAGE, id_column: str = "doc_id"
) -> DataFrame:
    """(id, license, template, words, coverage, start, end): each passage that holds ``coverage`` of a template's words.

    ``templates`` are (name, text), by default :data:`TEMPLATES`; they travel with the code, so their total length is
    that of a configuration. Every word of a text is looked up in the templates; where as many words as the
    coverage asks for stand within the band of a diagonal, and as many template words and text words have a partner there,
    a banded alignment counts the matched words in order and finds the span, in code points, end exclusive. Copies of one template that overlap count once, the best
    one; different templates are reported each.

    A template without words is never found. Null and
    empty texts have no rows; null ids and repeated rows keep theirs; only ``id_column`` and ``text`` are read.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates, coverage)
    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), "text")
    schema = f"id {kind}, license string, template int, words long, coverage double, start long, end long"
    return rows.mapInArrow(_scan(index), schema).withColumnRenamed("id", id_column)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
