"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are public notices and whole licenses. Each template's word n-grams are winnowed to the smallest hash of every
window; an inverted index leads from a fingerprint to templates and places. A text is scanned whole; where it
has fingerprints of a template, banded alignments of the words around each of their diagonals and each chain of
neighbouring ones give the matched share of the template and the span. Null and empty texts have no licenses; of
overlapping matches of one template, and of matches of several over nearly the same words, the best is reported,
ties by template name; repeated rows are scanned alike.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import field, map_rows
from lattica.llm.textkit import code_points_before, row_chunks, shingle_hashes, text_buffers, word_hashes, word_spans

#: Separators: ASCII other than digits and letters.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_BITS = 24
_PLACE = (1 << _BITS) - 1  # words that the text of a band may have
#: Notices by SPDX name (fixed values, public texts).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
}

#: Whole licenses, by SPDX name.
TEMPLATES |= {f"{p.stem}-body": p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, hashes, starts and ends of a text's words."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), SEPARATORS)
    return data, word_hashes(data, starts, ends), starts, ends


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost smallest hash of every window."""
    if len(hashes) <= window:
        return np.flatnonzero(hashes == hashes.min())[-1:] if len(hashes) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))


class Index:
    """Fingerprints of all templates; its size is that of the templates, a parameter."""

    def __init__(self, templates: dict[str, str], gram: int = 3, window: int = 3):
        self.gram = gram
        self.names = sorted(templates)
        self.words = [words_of(templates[n])[1] for n in self.names]
        entries = []
        for t, words in enumerate(self.words):
            grams, _ = shingle_hashes(words, np.array([0, len(words)]), gram)
            entries += [(grams[p], t, p) for p in winnow(grams, window)]
        entries.sort()
        self.keys = np.array([e[0] for e in entries], np.uint64)
        self.at = [(e[1], int(e[2])) for e in entries]

    def candidates(self, grams: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each template the (text place, template place) of common fingerprints."""
        low = np.searchsorted(self.keys, grams)
        found: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == grams):
            k = int(low[i])
            while k < len(self.keys) and self.keys[k] == grams[i]:
                found.setdefault(self.at[k][0], []).append((int(i), self.at[k][1]))
                k += 1
        return found


def align(text: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Most template words matched in order on diagonals ``low`` to ``high``, and the first and last text word matched.

    Of equal matches the one that starts last and then ends first. A cell of the table is one number of score,
    start + 1 and ``_PLACE`` - end, so that its order is this order.
    """
    first = max(low, 0)  # places are counted from here
    near = text[first : max(high + len(template), first)]
    if len(near) >= _PLACE or len(template) >> 63 - 2 * _BITS:
        raise ValueError("a band of 2^24 words of text or a template of 2^15 words")
    best = np.zeros(high - low + 1, np.int64)
    offsets = np.arange(low - first, high - first + 1)
    for j in range(len(template)):
        new = best.copy()
        new[:-1] = np.maximum(new[:-1], best[1:])
        at = offsets + j
        hits = np.flatnonzero((at >= 0) & (at < len(near)))
        hits = hits[near[at[hits]] == template[j]]
        if len(hits):
            i, old = at[hits], best[hits]
            start = np.where(old > 0, (old >> _BITS) & _PLACE, i + 1)
            new[hits] = np.maximum(new[hits], ((old >> 2 * _BITS) + 1 << 2 * _BITS) | (start << _BITS) | (_PLACE - i))
        best = np.maximum.accumulate(new)
    top = int(best[-1])
    if not top:
        return 0, -1, -1
    return top >> 2 * _BITS, first + (top >> _BITS & _PLACE) - 1, first + _PLACE - (top & _PLACE)


def reach(text: np.ndarray, template: np.ndarray, low: int, high: int) -> int:
    """The template words that the text has anywhere in a band: no alignment there matches more."""
    seen = np.zeros(len(template), bool)
    for d in range(max(low, 1 - len(template)), min(high, len(text) - 1) + 1):
        a, b = max(0, -d), min(len(template), len(text) - d)
        seen[a:b] |= text[a + d : b + d] == template[a:b]
    return int(seen.sum())


def bands(diagonals: list[int], band: int) -> list[tuple[int, int]]:
    """The margin around each diagonal, and around each chain of diagonals at most ``band`` apart."""
    out = {(d - band, d + band) for d in diagonals}
    begin = 0
    for k in range(1, len(diagonals) + 1):
        if k == len(diagonals) or diagonals[k] - diagonals[k - 1] > band:
            out.add((diagonals[begin] - band, diagonals[k - 1] + band))
            begin = k
    return sorted(out)


def licenses_of(text: str, index: Index, least: float, band: int) -> list[dict]:
    data, hashes, starts, ends = words_of(text)
    grams, _ = shingle_hashes(hashes, np.array([0, len(hashes)]), index.gram)
    out = []
    for t, pairs in sorted(index.candidates(grams).items()):
        template = index.words[t]
        words, need = np.unique(template, return_counts=True)
        where = np.searchsorted(words, hashes)
        places = np.searchsorted(words, template)
        where = np.where(words[np.minimum(where, len(words) - 1)] == hashes, where, len(words))
        if np.minimum(np.bincount(where, minlength=len(words) + 1)[:-1], need).sum() < least * len(template):
            continue
        found = []
        for low, high in bands(sorted({i - j for i, j in pairs}), band):
            near = np.bincount(where[max(low, 0) : max(high + len(template), 0)], minlength=len(words) + 1)[:-1]
            if np.minimum(near, need).sum() < least * len(template) or reach(where, places, low, high) < least * len(template):
                continue  # no order of these words matches enough
            score, a, b = align(hashes, template, low, high)
            if score >= least * len(template):
                found.append((-score, b - a, a, b))
        kept: list[tuple[int, int]] = []
        for score, _, a, b in sorted(set(found)):
            if all(b < x or y < a for x, y in kept):
                kept.append((a, b))
                out.append((score, index.names[t], a, b, -score / len(template)))
    named: list[tuple] = []
    for _, name, a, b, coverage in sorted(out, key=lambda x: (x[0], -x[4], *x[1:4])):  # CC BY lies within CC BY-NC: the most matched words name a place
        if all(min(b, y) - max(a, x) + 1 < least * (max(b - a, y - x) + 1) for _, x, y, _ in named):
            named.append((name, a, b, coverage))
    spans = [code_points_before(data, np.array([starts[a], ends[b]])) for _, a, b, _ in named]
    return sorted(({"license": n[0], "coverage": n[3], "start": int(x[0]), "end": int(x[1])} for n, x in zip(named, spans)), key=lambda x: (x["start"], x["license"]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, band: int = 4, text_column: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``row`` with licenses: name, matched share of the template, start and end in code points."""
    chosen = dict(templates or TEMPLATES)
    kept: dict = {}
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(rows: pa.StructArray) -> dict:
        index = kept.setdefault("index", None) or Index(chosen)
        kept["index"] = index
        column = field(rows, text_column)
        data, offsets = text_buffers(column)
        out: list[list[dict]] = []
        for lo, hi in row_chunks(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, first = word_spans(part, at, SEPARATORS)
            grams, begins = shingle_hashes(word_hashes(part, starts, ends), first, index.gram)
            low = np.minimum(np.searchsorted(index.keys, grams), len(index.keys) - 1)
            hits = np.diff(np.concatenate([[0], np.cumsum(index.keys[low] == grams)])[begins])
            out += [licenses_of(column[lo + i].as_py(), index, least, band) if n else [] for i, n in enumerate(hits)]
        return {"licenses": pa.array(out, kind)}

    return map_rows(docs, scan, "licenses array<struct<license:string,coverage:double,start:bigint,end:bigint>>", columns)
