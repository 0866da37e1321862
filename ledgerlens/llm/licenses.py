"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Words are runs of letters, digits and non-ASCII characters, in lower case; shingles are
five words. Templates of similar length share a window size and step, chosen so that
any stretch of a template's length lies whole in some window. From the least
similarity such a window can have to a template of which ``MIN_CONTAINMENT`` of the
shingles are there, the number of bands follows for a collision probability of at least
``SURE``. A candidate is a match if the exact share of the template's shingles found
in the document around the window is at least ``MIN_CONTAINMENT``.

The work is one pass over the texts without a shuffle; only the templates, a fixed
list, go to the tasks. Null and empty texts have no matches; repeated rows each have
theirs; rows with a null id too; extra columns aren't read. A template needs at least
five words.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes

SHINGLE, MIN_CONTAINMENT, SURE = 5, 0.8, 0.9999
#: Words put together in one array; a longer text makes its own.
TOGETHER = 1 << 17

# Wording of common licence notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                  "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
           "copyright notice and this permission notice appear in all copies.",
    # notices
    "mit-licensed": "Licensed under the MIT License.",
    "mit-distributed": "Distributed under the MIT License.",
    "mit-terms": "under the terms of the MIT License",
    "apache-2.0-plain": "Licensed under the Apache License 2.0.",
    "bsd-style-notice": "governed by a BSD-style license that can be found in the LICENSE file",
    "bsd-2-notice": "Licensed under the BSD 2-Clause License.",
    "bsd-3-notice": "Licensed under the BSD 3-Clause License.",
    "isc-notice": "Licensed under the ISC License.",
    "gpl-plain-notice": "licensed under the GNU General Public License",
    "lgpl-notice": "licensed under the GNU Lesser General Public License",
    "agpl-notice": "licensed under the GNU Affero General Public License",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, version 2.0.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-1.0-notice": "Licensed under CC0 1.0 Universal.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-sa-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-nd-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-3.0-notice": "Text is available under the Creative Commons Attribution-ShareAlike License.",
    "cc-by-nc-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    # headers of source files
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                       "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                       "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                       "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                      "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                           "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                           "permissions and limitations under the License.",
    # later clauses
    "mit-notice-clause": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
                    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
                    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
                    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-clause-1": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-clause-2": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                    "documentation and/or other materials provided with the distribution.",
    "bsd-clause-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                    "software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
                    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
                    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
                    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def license_words(text: str | None) -> list[bytes]:
    return as_bytes(text).translate(_TABLE).split()


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for each place where five words begin."""
    n = max(0, len(words) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h = (h ^ words[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Family:
    """Templates of similar length with their window, step, bands and signatures."""

    def __init__(self, templates: dict[str, np.ndarray], top: int, min_containment: float):
        self.step = max(4, top // 2)
        blocks = 1 + math.ceil((top - SHINGLE) / self.step)
        self.blocks = blocks + (top - SHINGLE + 1 > (blocks - 1) * self.step + 1)
        self.shingles = self.blocks * self.step  # of a window; a template's places lie in one whatever its start
        self.names, self.sets = list(templates), [np.unique(h) for h in templates.values()]
        least = min(math.ceil(min_containment * len(s)) / (self.shingles + len(s) - math.ceil(min_containment * len(s))) for s in self.sets)
        self.rows = 1 if least < 0.5 else 2
        self.bands = math.ceil(math.log(1 - SURE) / math.log(1 - min(least ** self.rows, 0.999)))
        odd = np.random.default_rng(20).integers(1 << 62, size=self.bands * self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.odd = odd.reshape(self.bands, self.rows)
        self.keys = [[[((s * a) >> np.uint64(32)).min() for a in band] for band in self.odd] for s in self.sets]

    def candidates(self, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, first shingle of a window) for windows that share a band with a template."""
        n = -(-len(h) // self.step)
        found = [np.zeros(n, bool) for _ in self.sets]
        for b, band in enumerate(self.odd):
            agree = None
            for r, a in enumerate(band):
                v = np.full(n * self.step, np.uint64(1 << 32))
                np.right_shift(h * a, np.uint64(32), out=v[:len(h)])
                low = v.reshape(n, self.step).min(axis=1)
                window = low.copy()
                for k in range(1, self.blocks):
                    np.minimum(window[:n - k], low[k:], out=window[:n - k])
                hits = [window == keys[b][r] for keys in self.keys]
                agree = hits if agree is None else [x & y for x, y in zip(agree, hits, strict=True)]
            for t, x in enumerate(agree):
                found[t] |= x
        for t, x in enumerate(found):
            for w in np.nonzero(x)[0]:
                yield t, int(w) * self.step


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, min_containment: float = MIN_CONTAINMENT):
        self.min_containment = min_containment
        groups: dict[int, dict[str, np.ndarray]] = defaultdict(dict)
        for name, text in templates.items():
            w = license_words(text)
            if len(w) < SHINGLE:
                raise ValueError(f"{name}: a template needs {SHINGLE} words at least")
            top = SHINGLE
            while top < len(w):
                top = math.ceil(top * 1.6)
            groups[top][name] = shingle_hashes(word_hashes(w))
        self.families = [Family(g, top, min_containment) for top, g in groups.items()]

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """For each text its matches (license, first word, end word, containment), by place."""
        cut = [license_words(t) for t in texts]
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        first = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
        h = shingle_hashes(word_hashes([w for c in cut for w in c]))
        out: list[list] = [[] for _ in texts]
        if not len(h):
            return out
        inside = owner[:len(h)] == owner[SHINGLE - 1:SHINGLE - 1 + len(h)]  # not across texts
        spans = defaultdict(list)
        for family in self.families:
            for t, at in family.candidates(h):
                want, size = family.sets[t], len(family.sets[t])
                lo, hi = max(0, at - size), min(len(h), at + family.shingles + size)
                places = lo + np.nonzero(np.isin(h[lo:hi], want) & inside[lo:hi])[0]
                for doc in np.unique(owner[places]):
                    own = places[owner[places] == doc]
                    for run in np.split(own, np.nonzero(np.diff(own) > size)[0] + 1):
                        share = len(np.unique(h[run])) / size
                        if share >= self.min_containment:
                            spans[int(doc), family.names[t]].append((int(run[0]), int(run[-1]) + SHINGLE, share))
        for (doc, name), found in spans.items():
            kept: list[list] = []
            for lo, hi, share in sorted(set(found)):
                if kept and lo < kept[-1][1]:
                    kept[-1][1:] = [max(hi, kept[-1][1]), max(share, kept[-1][2])]
                else:
                    kept.append([lo, hi, share])
            out[doc] += [(name, lo - int(first[doc]), hi - int(first[doc]), share) for lo, hi, share in kept]
        return [sorted(x, key=lambda m: (m[1], m[0])) for x in out]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES,
                  min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """(id, license, start_word, end_word, containment), one row for each match."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_containment)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") // 6 <= TOGETHER):
                    size += len(texts[end] or "") // 6
                    end += 1
                found = [(k, *m) for k, ms in enumerate(scanner.scan(texts[at:end]), at) for m in ms]
                if found:
                    k, name, lo, hi, share = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(name), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()),
                                                      pa.array(share, pa.float64())], names=["id", "license", "start_word", "end_word", "containment"])
                at = end

    return src.mapInArrow(task, f"id {kind}, license string, start_word int, end_word int, containment double")
