"""License scans: MinHash bands over overlapping windows, exact containment.

Templates are classed by length. For the class of templates of up to S
shingles the text is cut into windows of 2 S shingles that overlap by half, so
a whole template lies in some window; the number of bands (one MinHash value
each) follows from the least Jaccard similarity that a match can have to its
window, so that a match fails to collide with probability ``MISS`` at most.
Windows that share a band with a template are verified by exact shingle
containment on the words.

Everything happens row by row in Arrow batches; nothing is shuffled. The
templates, a small fixed set, go to the tasks with the function.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, texts

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-6
SEED = 23
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SLAB = 1 << 15                     # shingles of several texts that are hashed at once
NOTHING = np.uint32(0xFFFFFFFF)

# Notices of well-known licenses, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                         "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                         "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                         "language governing permissions and limitations under the License.",
    "BSD-2-Clause-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                           "provided that the following conditions are met:",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                      "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                      "or (at your option) any later version.",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                  "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                  "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
                  "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
                  "conditions:",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
}


def words_of(raw: bytes) -> list[bytes]:
    return WORD.findall(raw.lower())


def shingle_hashes(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of the word shingles; fewer words: one of all of them."""
    if len(words) < k:
        return np.array([xxhash.xxh32_intdigest(b" ".join(words))] * bool(words), dtype=np.uint32)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x) for x in words], dtype=np.uint64)
    n = len(w) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[j:j + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(np.uint32)


def shingles(words: list[bytes], k: int = SHINGLE) -> list[tuple[bytes, ...]]:
    return [tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def bands_needed(matched: int, window: int, template: int, miss: float = MISS) -> int:
    """Bands of one value so that a window that holds ``matched`` of the
    template's shingles collides but with probability ``miss``."""
    similarity = matched / (window + template - matched)
    return math.ceil(math.log(miss) / math.log(1 - similarity)) if similarity < 1 else 1


class Scanner:
    """Templates with their band values, ready to scan texts."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, k: int = SHINGLE, miss: float = MISS):
        self.k, self.containment, self.templates = k, containment, []
        classes: dict[int, list[int]] = defaultdict(list)
        needed: dict[int, int] = defaultdict(int)
        for name, text in templates.items():
            words = words_of(text.encode())
            own = set(shingles(words, k))
            if not own:
                continue
            m = len(words) - k + 1 if len(words) >= k else 1
            stride = 1 << (m - 1).bit_length()                    # smallest power of two from m on
            classes[stride].append(len(self.templates))
            needed[stride] = max(needed[stride], bands_needed(math.ceil(containment * len(own)), 2 * stride, len(own), miss))
            self.templates.append((name, own, shingle_hashes(words, k)))
        rng = np.random.default_rng(SEED)
        count = max(needed.values(), default=1)
        self.a = rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)
        # Of every class: stride, templates, and their band values (bands, templates).
        self.classes = [(s, classes[s], np.stack([self.bands(self.templates[t][2]).min(axis=1)[:needed[s]]
                                                  for t in classes[s]], axis=1)) for s in sorted(classes)]

    def bands(self, hashes: np.ndarray) -> np.ndarray:
        return self.a[:, None] * hashes[None, :] + self.b[:, None]

    def candidates(self, hashes: np.ndarray):
        """``(template, first, last)`` shingle ranges of the windows that
        share a band with a template."""
        low, width = self.bands(hashes), 1                        # block minima of `width` shingles
        for stride, members, values in self.classes:
            while width < stride:
                if low.shape[1] % 2:
                    low = np.pad(low, ((0, 0), (0, 1)), constant_values=NOTHING)
                low, width = np.minimum(low[:, ::2], low[:, 1::2]), 2 * width
            block = low[:len(values)]
            window = np.minimum(block[:, :-1], block[:, 1:]) if block.shape[1] > 1 else block
            for at, template in enumerate(members):
                for w in np.flatnonzero((window == values[:, at, None]).any(axis=0)).tolist():
                    yield template, w * stride, (w + 2) * stride

    def verify(self, words: list[bytes], template: int, lo: int, hi: int):
        """``(containment, first word, last word)`` of a template in the
        shingles ``lo`` to ``hi`` of a text and half a window around them."""
        _, own, _ = self.templates[template]
        margin = (hi - lo) // 2
        lo, hi = max(0, lo - margin), min(max(1, len(words) - self.k + 1), hi + margin)
        hits = [i for i in range(lo, hi) if tuple(words[i:i + self.k]) in own]
        share = len({tuple(words[i:i + self.k]) for i in hits}) / len(own)
        return (share, hits[0], min(len(words), hits[-1] + self.k)) if hits else (0.0, 0, 0)

    def scan(self, texts_: list[bytes]) -> list[list[tuple[str, float, int, int]]]:
        """For each text its ``(name, containment, first word, end word)``:
        the best, then first, occurrence of each template contained enough."""
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts_]
        held, size = [], 0

        def flush():
            begins = np.cumsum([0] + [len(h) for _, _, h in held])
            for template, lo, hi in self.candidates(np.concatenate([h for _, _, h in held])):
                d = int(np.searchsorted(begins, lo, side="right")) - 1
                while d < len(held) and begins[d] < hi:           # a window may reach into the next texts
                    number, words, _ = held[d]
                    share, first, end = self.verify(words, template, lo - int(begins[d]), hi - int(begins[d]))
                    old = best[number].get(template)
                    if share >= self.containment and (old is None or (-share, first) < (-old[0], old[1])):
                        best[number][template] = (share, first, end)
                    d += 1

        for number, raw in enumerate(texts_):
            words = words_of(raw)
            hashes = shingle_hashes(words, self.k)
            if len(hashes):
                held.append((number, words, hashes))
                size += len(hashes)
            if size >= SLAB:
                flush()
                held, size = [], 0
        if held:
            flush()
        return [[(self.templates[t][0], *x) for t, x in sorted(b.items())] for b in best]


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
             containment: float = CONTAINMENT, words_per_shingle: int = SHINGLE) -> DataFrame:
    """``(<id_col>, license, containment, first_word, end_word)`` for every
    row and template such that at least ``containment`` of the template's
    word shingles occur near each other in the text: the best occurrence, the
    first among equals (word numbers, end exclusive).

    Words are runs of ASCII letters and digits and of non-ASCII characters,
    ASCII-lower-cased. Null and empty texts match nothing, nor do templates
    without words. Rows with null ids and repeated rows match each for
    itself; templates of equal text all match. Empty tables give an empty
    result; other columns are ignored, whatever their names. Texts of any
    length are scanned whole.
    """
    chosen = TEMPLATES if templates is None else templates
    schema = pa.schema([("id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()),
                        ("first_word", pa.int64()), ("end_word", pa.int64())])

    def run(batches):
        scanner = Scanner(chosen, containment, words_per_shingle)
        for b in batches:
            found = scanner.scan(b.column(1).to_pylist()) if scanner.templates else [[]] * b.num_rows
            rows = [(i, *hit) for i, hits in zip(b.column(0).to_pylist(), found) for hit in hits]
            yield batch(dict(zip(schema.names, map(list, zip(*rows)))) if rows else dict.fromkeys(schema.names, []), schema)

    return (docs.select(F.col(id_col).cast("long").alias("id"), texts(docs, text_col).cast("binary").alias("t"))
            .mapInArrow(run, "id long, license string, containment double, first_word long, end_word long")
            .withColumnRenamed("id", id_col))
