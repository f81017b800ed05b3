"""License scans: MinHash bands over overlapping windows, verified by shingle containment.

Templates are notices and whole licence texts.  Texts and templates become lower-case words and three-word shingles
(a shorter template is one shingle of all its words).  For each size class of templates (a power of
two of shingles), windows of twice that size overlap by half, so every place of a template lies
whole in some window.  A window that holds a whole template has a similarity with it of a quarter or more; one that
holds four fifths of it, the least containment by default, of 0.19 or more.  They are compared by ``BANDS`` bands of one minimum hash each,
so they collide with a probability of at least 1 - 0.81 ** 42 > 0.9998.  Each collision is verified
exactly, on words: the share of the template's distinct shingles that stand in the window.

All work is per row with a template table of fixed size, so there is no shuffle; windows cover whole
texts, and minima are taken over runs of up to a million shingles at once, from each size class to the next.

Defined results: null texts, empty texts and texts without a match have an empty list; every verified template is
reported once, at its best place, the earliest of equals.  ``covered`` marks a match that overlaps one of another template with a
greater containment, as version 2 of a licence does where version 3 stands; of equals none is covered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from .common import annotate

SHINGLE, BANDS, CONTAINMENT, RUN = 3, 42, 0.8, 1 << 20
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

#: Wordings of public licences, by name. Default templates; another mapping can be given.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT license.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-2-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def shingles_of(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """A 64-bit code for each run of ``size`` words (of all words, if they are fewer)."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = min(size, len(words))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = _mix(out ^ h[k : len(h) - n + 1 + k], k)
    return out


def _runs(words: list[str]) -> Iterator[tuple[str, ...]]:
    return zip(*(words[i:] for i in range(SHINGLE)), strict=False)


class Scanner:
    """Templates with their shingles and band tables, for one worker."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT):
        self.containment = containment
        self.names = sorted(templates)
        self.words = [words_of(templates[n]) for n in self.names]
        self.sets = [np.unique(shingles_of(w)) for w in self.words]
        self.classes: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            if len(s):
                self.classes.setdefault(1 << int(len(s) - 1).bit_length(), []).append(t)
        self.minima = [[_mix(s, 100 + k).min() if len(s) else None for k in range(BANDS)] for s in self.sets]
        self.shingles = [set(_runs(w)) for w in self.words]
        # templates below a whole shingle are compared with shingles of their own length
        self.brief = [t for t, w in enumerate(self.words) if 0 < len(w) < SHINGLE]
        for members in self.classes.values():
            members[:] = [t for t in members if t not in self.brief]

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first, past the last) of windows that share a band with a template."""
        found: set[tuple[int, int, int]] = set()
        n, largest = len(codes), max((h for h, m in self.classes.items() if m), default=0)
        for k in range(BANDS if n else 0):
            least, half = _mix(codes, 100 + k), 1  # the minima of blocks of ``half`` shingles
            while half <= largest:
                if self.classes.get(half):
                    two = np.concatenate([np.minimum(least[:-1], least[1:]), least[-1:]])
                    for t in self.classes[half]:
                        for w in np.flatnonzero(two == self.minima[t][k]).tolist():
                            found.add((t, w * half, min((w + 2) * half, n)))
                if len(least) % 2:
                    least = np.concatenate([least, least[-1:]])
                least, half = np.minimum(least[0::2], least[1::2]), 2 * half
        return sorted(found)

    def scan(self, batch: list[list[str]]) -> list[list[tuple]]:
        """For each text (as words) its matches: (template, containment, first word, past the last)."""
        out: list[dict[int, tuple]] = [{} for _ in batch]

        def settle(docs: list[int], parts: list[np.ndarray]) -> None:
            codes = np.concatenate(parts)
            ends = np.cumsum([len(p) for p in parts])
            for t, a, b in self.candidates(codes):
                owners = np.searchsorted(ends, np.arange(a, b), side="right")
                for owner in np.unique(owners):
                    at = np.arange(a, b)[owners == owner]
                    inside = np.isin(codes[at], self.sets[t])
                    if len(np.unique(codes[at][inside])) < self.containment * len(self.sets[t]):
                        continue
                    base = int(ends[owner] - len(parts[owner]))
                    first, last = int(at[inside][0]) - base, int(at[inside][-1]) - base + SHINGLE
                    # codes may collide, words do not
                    held = self.shingles[t].intersection(_runs(batch[docs[owner]][first:last]))
                    share = len(held) / len(self.shingles[t])
                    if share >= self.containment:
                        self._keep(out[docs[owner]], t, share, first, last)

        docs, parts, size = [], [], 0
        for i, words in enumerate(batch):
            if len(words) >= SHINGLE:
                docs.append(i)
                parts.append(shingles_of(words))
                size += len(parts[-1])
                if size >= RUN:
                    settle(docs, parts)
                    docs, parts, size = [], [], 0
            for t in self.brief:
                n = len(self.words[t])
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == self.words[t]:
                        self._keep(out[i], t, 1.0, at, at + n)
                        break
        if docs:
            settle(docs, parts)
        return [[(self.names[t], *m, self._covered(t, found)) for t, m in sorted(found.items())] for found in out]

    @staticmethod
    def _covered(t: int, found: dict[int, tuple]) -> bool:
        """Whether another template matches more of itself at an overlapping place."""
        share, first, last = found[t]
        return any(o != t and s > share and a < last and first < b for o, (s, a, b) in found.items())

    @staticmethod
    def _keep(found: dict[int, tuple], t: int, share: float, first: int, last: int) -> None:
        old = found.get(t)
        if old is None or (share, -first) > (old[0], -old[1]):
            found[t] = (share, first, last)


_MATCHES = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.bool_())]))


def matches_column(text: Column, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> Column:
    given = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(given, containment)
        for batch in batches:
            found = scanner.scan([words_of(t or "") for t in batch.to_pylist()])
            yield pa.StructArray.from_arrays([pa.array([[dict(zip(("template", "containment", "first_word", "end_word", "covered"), m, strict=True)) for m in row] for row in found], _MATCHES)], ["license_matches"])

    return arrow_udf(run, "license_matches array<struct<template:string,containment:double,first_word:bigint,end_word:bigint,covered:boolean>>", ArrowUDFType.SCALAR_ITER)(text)


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` with ``license_matches``; a column of that name is replaced."""
    return annotate(docs, matches_column(F.col(text), templates, containment), ["license_matches"])


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: the templates it holds, those of them that a better match covers, the best containment and the matches."""
    m = F.col("license_matches")
    return scan_licenses(docs.select("doc_id", "text")).select(
        "doc_id",
        F.array_join(F.transform(m, lambda x: x["template"]), ",").alias("licenses"),
        F.array_join(F.transform(F.filter(m, lambda x: x["covered"]), lambda x: x["template"]), ",").alias("covered"),
        F.size(m).cast("long").alias("n_licenses"),
        F.coalesce(F.array_max(F.transform(m, lambda x: x["containment"])), F.lit(0.0)).alias("best_containment"),
        F.to_json(m).alias("matches"),
    )
