"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment.

A template of m shingles belongs to the class L = the next power of two. A copy is a stretch of
less than 4L shingles that holds 0.8 of the template's, so words may be inserted, changed or
left out. Windows are 8L long with a step of 4L: every such stretch lies in one whole. A
window is the set of its shingles that templates of the class have; others cannot be shared.
If it holds 0.8 of a template, their Jaccard similarity is over 0.049 whatever else it holds
(0.8 m of at most 8L + 0.2 m), so BANDS bands of one row miss it with a chance under
(1 - 0.049)^256 < 3e-6; with no other template in the window under 0.2^256.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bitloom.llm.common import byte_classes, mix, shingles, slices, string_buffers, tune, words

BANDS, K, CONTAINED = 256, 5, 0.8
_CLASSES = byte_classes(b"", only=bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details."

#: Short notices, standard headers and grants as they are commonly written.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-text": _MIT_GRANT,
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-text": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-conditions": _BSD_TWO,
    "BSD-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-header": _GNU.format("", 3),
    "GPL-2.0-header": _GNU.format("", 2).replace("software: you", "software; you"),
    "LGPL-3.0-header": _GNU.format("Lesser", 3),
    "LGPL-2.1-header": _GNU.format("Lesser", "2.1").replace("program", "library"),
    "AGPL-3.0-header": _GNU.format("Affero", 3),
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
}


def _read(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shingles, word starts, word ends) of each text; offsets are bytes of the text."""
    data, offsets = string_buffers(column)
    for i, j in slices(offsets):
        h, s, e, first = words(data, offsets[i : j + 1], *_CLASSES)
        out, begin = shingles(h, first, K)
        for d in range(j - i):
            base = int(offsets[i + d] - offsets[i])
            yield out[begin[d] : begin[d + 1]], s[first[d] : first[d + 1]] - base, e[first[d] : first[d + 1]] - base


def _needed(m: int) -> int:
    return next(n for n in range(1, m + 1) if n / m >= CONTAINED)


def _class_of(s: np.ndarray) -> int:
    return 1 << max(len(s) - 1, 0).bit_length()


_SEEDS = mix(np.arange(BANDS, dtype=np.uint64), 1000)


def _signature(s: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of BANDS orders."""
    out = np.full(BANDS, ~np.uint64(0))
    for i in range(0, len(s), 256):
        out = np.minimum(out, mix(s[i : i + 256, None] ^ _SEEDS).min(0))
    return out


@dataclass
class Templates:
    """Template shingles, their band values by class, and a prefilter of one bit per low 16 hash bits."""

    names: list[str]
    sets: list[np.ndarray]
    classes: dict[int, tuple[list[int], np.ndarray, np.ndarray, int]]  # by L: templates, their signatures, their shingles, least number that a copy holds
    every: np.ndarray
    low: np.ndarray
    places: list[list[list[int]]]  # of each shingle of sets, where it stands in the template

    @staticmethod
    def build(texts: dict[str, str]) -> "Templates":
        names = sorted(texts)
        order = [s for s, _, _ in _read(pa.array([texts[n] for n in names], pa.string()))]
        sets = [np.unique(s) for s in order]
        places = [[np.flatnonzero(s == x).tolist() for x in u] for s, u in zip(order, sets)]
        by: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(sets):
            if len(s):
                by[_class_of(s)].append(i)
        classes = {size: (own, np.stack([_signature(sets[i]) for i in own]), np.unique(np.concatenate([sets[i] for i in own])), min(_needed(len(sets[i])) for i in own)) for size, own in by.items()}
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]))
        low = np.zeros(1 << 16, bool)
        low[(every & np.uint64(0xFFFF)).astype(np.int64)] = True
        return Templates(names, sets, classes, every, low, places)

    def scan(self, s: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first shingle, last shingle, containment) of all matches, those of one template not overlapping."""
        at = np.flatnonzero(self.low[(s & np.uint64(0xFFFF)).astype(np.int64)])
        at = at[np.isin(s[at], self.every)]
        near: set[int] = set()
        for size, (own, signatures, shingles_, least) in self.classes.items() if len(at) else ():
            mine = at[np.isin(s[at], shingles_)]
            step = 4 * size
            for w in np.unique(np.concatenate([mine // step, np.maximum(mine // step - 1, 0)])).tolist():
                part = np.unique(s[mine[np.searchsorted(mine, w * step) : np.searchsorted(mine, (w + 2) * step)]])
                if len(part) >= least:
                    near.update(own[i] for i in np.flatnonzero((signatures == _signature(part)).any(1)))
        found = [(t, *m) for t in near for m in self._occurrences(t, s[at], at)]
        return sorted(found, key=lambda m: (m[1], m[2], m[0]))

    def _occurrences(self, t: int, s: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
        """(first, last, containment) of each copy of one template; s are the template shingles of a text, at their places.

        A copy grows from a stretch that holds enough of the template and none shorter inside,
        the shortest ones first, over the hits beside it that go on in the template's order.
        """
        ids = np.searchsorted(self.sets[t], s)
        mine = self.sets[t][np.minimum(ids, len(self.sets[t]) - 1)] == s
        hit, at = ids[mine].tolist(), at[mine].tolist()
        m = len(self.sets[t])
        need, limit = _needed(m), 4 * _class_of(self.sets[t])
        cores, count, i = [], defaultdict(int), 0
        for j, x in enumerate(hit):
            count[x] += 1
            while count[hit[i]] > 1 or len(count) > need:
                count[hit[i]] -= 1
                if not count[hit[i]]:
                    del count[hit[i]]
                i += 1
            if len(count) == need and at[j] - at[i] < limit:
                cores.append((at[j] - at[i], i, j))
        used, out = np.zeros(len(hit), bool), []
        for _, i, j in sorted(cores):
            if used[i : j + 1].any():
                continue
            low, high = self.places[t][hit[i]][0], self.places[t][hit[j]][-1]
            while j + 1 < len(hit) and not used[j + 1] and at[j + 1] - at[i] < limit:
                after = [p for p in self.places[t][hit[j + 1]] if p > high]
                if not after:
                    break
                j, high = j + 1, after[0]
            while i and not used[i - 1] and at[j] - at[i - 1] < limit:
                before = [p for p in self.places[t][hit[i - 1]] if p < low]
                if not before:
                    break
                i, low = i - 1, before[-1]
            used[i : j + 1] = True
            out.append((at[i], at[j], len(set(hit[i : j + 1])) / m))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, matches) for each row of docs(doc_id, text, ...); matches is an array of (license, start, end, containment).

    A match holds 0.8 or more of the template's five-word shingles (words: letters and
    digits, A-Z lower-cased). Offsets are code points from the first word of the first
    shared shingle to the last word of the last one, end exclusive. Each copy of a template is
    a match of its own, also next to another copy. Matches of different templates may
    overlap, those of one template don't.

    A null, empty or short text has no match. Repeated rows repeat theirs, a null doc_id
    stays null, other columns are ignored. The templates are a bounded parameter.
    """
    held = tune(docs.sparkSession).sparkContext.broadcast(Templates.build(TEMPLATES if templates is None else templates))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for batch in batches:
            rows = []
            for i, (s, start, end) in enumerate(_read(batch.column(1))):
                found = t.scan(s)
                if found:
                    raw = np.frombuffer(batch.column(1)[i].as_py().encode(), np.uint8)
                    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    last = lambda x: end[min(x + K - 1, len(end) - 1)]
                    found = [{"license": t.names[m], "start": int(lead[start[a]]), "end": int(lead[last(b)]), "containment": c} for m, a, b, c in found]
                rows.append(found)
            yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "matches": pa.array(rows, pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])))})

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, matches array<struct<license:string,start:long,end:long,containment:double>>")
