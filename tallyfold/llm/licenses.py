"""License scan: winnowed fingerprints pick templates, banded alignment measures the match.

Method: templates and texts become lower-cased words. A fingerprint is the hash of
``GRAM`` consecutive words; winnowing keeps the smallest hash of every ``WINDOW``
consecutive ones, so any run of GRAM + WINDOW - 1 words that a text shares with a
template shares a kept fingerprint. An inverted index of the templates' fingerprints
turns a text's kept fingerprints into hits (template, place in template, place in
text); hits of a template whose diagonals lie within ``BAND`` form a candidate region,
and the region is aligned with the template word by word in a band around its
diagonal (match 1, mismatch and gap -1, local). Reported are the matched template
words as a share of all (``coverage``) and the span in the text.

A template of fewer than ``BRIEF`` words may have one word edited and no such run left:
its pairs of words are looked up at every place instead, and a region needs two of them
(as many as one edit leaves); one of three words or fewer is found by all its words.

Templates are few and fixed; the index is built once for each Python worker.
Texts are scanned where they are: no shuffle, no broadcast that grows with the data.

Defined results: null and empty texts match nothing. Rows are scanned one by one,
so repeated rows and null ids give rows of their own. An empty table gives no rows.
Equal matches of one template at different places are all reported; of overlapping
matches of one template the one with more matched words is. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import wordhash as wh

GRAM = 4
WINDOW = 3
BAND = 8
#: Templates of fewer words are found by pairs of words: a longer one keeps a run of GRAM + WINDOW - 1 words when one is edited.
BRIEF = 2 * (GRAM + WINDOW - 1) + 1
#: Regions that are aligned at once.
REGIONS = 2048
#: Share of a template's words that a match must cover.
LEAST = 0.6
SCHEMA = "doc_id long, license string, coverage double, matched_words long, template_words long, start_word long, end_word long, start_byte long, end_byte long"

# Names and texts of templates (notices and opening or closing sentences of public licenses).
TEMPLATES = {
    "AGPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "BSD-2-Clause-conditions": """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution.""",
    "BSD-3-Clause-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.""",
    "BSD-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met""",
    "BSD-warranty": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the
public domain worldwide. This software is distributed without any warranty.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0""",
    "GPL-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies""",
    "LGPL-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "MIT": "Released under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions""",
    "MIT-warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software.""",
}


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the kept hashes: of every ``window`` consecutive ones the smallest, the last on a tie."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + window - 1 - np.argmin(views, axis=1))


def _gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = wh.mix(out + h[k : k + n])
    return out


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of one text as UTF-8."""
    lower = np.frombuffer(data.lower(), np.uint8)
    start, end, _ = wh.words(lower, np.array([0, len(lower)]), wh.NOT_ALNUM)
    return wh.word_hashes(lower, start, end)[0], start, end


class Index:
    """Templates by fingerprint."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [_words(templates[n].encode())[0] for n in self.names]
        #: Words of the fingerprints that find each template.
        self.size = [GRAM if len(w) >= BRIEF else 2 if len(w) > 3 else len(w) for w in self.words]
        at = defaultdict(list)
        for t, h in enumerate(self.words):
            # every place of a template is indexed, so that any kept fingerprint of a text finds it
            for p, x in enumerate(_gram_hashes(h, self.size[t]).tolist() if len(h) else []):
                at[self.size[t], x].append((t, p))
        self.at = dict(at)
        self.keys = {n: np.array(sorted(x for k, x in at if k == n), np.uint64) for n in sorted(set(self.size) - {0})}
        self.maybe = {}
        for n, keys in self.keys.items():
            self.maybe[n] = np.zeros(1 << 16, dtype=bool)
            self.maybe[n][keys & np.uint64(0xFFFF)] = True

    def hits(self, h: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """template -> [(place in text, place in template)] of kept fingerprints."""
        out = defaultdict(list)
        for size, keys in self.keys.items():
            g = _gram_hashes(h, size)
            kept = winnow(g) if size == GRAM else np.arange(len(g))
            kept = kept[self.maybe[size][g[kept] & np.uint64(0xFFFF)]]
            for p in kept[np.isin(g[kept], keys)].tolist():
                for t, q in self.at[size, int(g[p])]:
                    out[t].append((p, q))
        return out

    def needed(self, t: int) -> int:
        """Fingerprints that a region must hold."""
        return 2 if self.size[t] == 2 and len(self.words[t]) >= 5 else 1


def align(text: np.ndarray, template: np.ndarray, diagonals: np.ndarray, band: int = BAND) -> np.ndarray:
    """(matched words, first, last + 1) of the best local alignment with text place - template place within ``band`` of each diagonal."""
    n, width = len(diagonals), 2 * band + 1
    step, rows = np.arange(width), np.arange(n)
    score, hits = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    first = np.full((n, width), -1)
    best = np.zeros((n, 4), np.int64)
    for q in range(len(template)):
        places = diagonals[:, None] - band + q + step
        inside = (places >= 0) & (places < len(text))
        same = inside & (text[np.clip(places, 0, len(text) - 1)] == template[q])
        fresh = (score <= 0) & same
        new = np.where(same, score + 1, score - 1)
        new_first, new_hits = np.where(fresh, places, first), np.where(fresh, 1, hits + same)
        # a template word that the text lacks
        up = np.pad(score[:, 1:], ((0, 0), (0, 1))) - 1
        take = up > new
        new = np.where(take, up, new)
        new_first = np.where(take, np.pad(first[:, 1:], ((0, 0), (0, 1)), constant_values=-1), new_first)
        new_hits = np.where(take, np.pad(hits[:, 1:], ((0, 0), (0, 1))), new_hits)
        # text words that the template lacks: from the place on the left that stays best, the nearest on a tie
        left = np.maximum.accumulate((new + step + 2) * width + step, axis=1) % width
        new = np.take_along_axis(new, left, 1) - (step - left)
        new_first, new_hits = np.take_along_axis(new_first, left, 1), np.take_along_axis(new_hits, left, 1)
        dead = (new <= 0) | ~inside
        score, first, hits = np.where(dead, 0, new), new_first, np.where(dead, 0, new_hits)
        k = (score * width - np.abs(step - band)).argmax(1)  # nearest to the diagonal on a tie, so that each of several repeats finds itself
        better = score[rows, k] > best[:, 3]
        best[better] = np.stack([hits[rows, k], first[rows, k], places[rows, k] + 1, score[rows, k]], axis=1)[better]
    return best[:, :3]


def _regions(hits: list[tuple[int, int]], length: int, needed: int) -> list[int]:
    """Diagonals of runs of hits that lie near each other, with ``needed`` different fingerprints at least."""
    out, start, last, places = [], 0, 0, set()
    for d, p, q in sorted((p - q, p, q) for p, q in hits):
        if not places or d - start > BAND // 2 or p - last > length + BAND:
            if len(places) >= needed:
                out.append(start)
            start, places = d, set()
        places.add(q)
        last = p
    return [*out, start] if len(places) >= needed else out


def scan(data: bytes, index: Index, least: float = LEAST) -> list[tuple]:
    """Matches in one text: (license, coverage, matched, template words, first word, last + 1, first byte, last + 1)."""
    h, start, end = _words(data)
    found = []
    for t, hits in index.hits(h).items():
        template = index.words[t]
        diagonals = np.array(_regions(hits, len(template), index.needed(t)), np.int64)
        got = set()
        for lo in range(0, len(diagonals), REGIONS):
            made = align(h, template, diagonals[lo : lo + REGIONS])
            got.update(map(tuple, made[made[:, 0] >= least * len(template)].tolist()))
        taken: list[tuple[int, int]] = []
        for matched, first, last in sorted(got, key=lambda x: (-x[0], x[1])):
            k = bisect_right(taken, (first, first))
            if (not k or taken[k - 1][1] <= first) and (k == len(taken) or taken[k][0] >= last):
                insort(taken, (first, last))
                found.append((index.names[t], matched / len(template), matched, len(template), first, last, int(start[first]), int(end[last - 1])))
    return sorted(found, key=lambda x: (x[4], x[0]))


_INDEX: dict[str, Index] = {}


def _scan(templates: dict[str, str], least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = repr(sorted(templates.items()))
        if key not in _INDEX:
            _INDEX[key] = Index(templates)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 6]
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                rows += [(doc_id, *m) for m in (scan(data, _INDEX[key], least) if data else ())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def license_matches(docs: DataFrame, *, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match of a template in a document (see ``SCHEMA``)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_scan(TEMPLATES if templates is None else templates, least), SCHEMA)
