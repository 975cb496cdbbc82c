"""License scans by patience alignment of texts with license templates.

Words of the text that the template lacks can't align, so only the others, with their places, enter. From each of these
words on, the window of ``SLACK`` times the template's length is aligned if it shares enough of the template's words, each as
often as the template has it: words that occur once in both are anchors; the longest increasing subsequence of their places
is kept, and the gaps between kept anchors are aligned the same way. Gaps without anchors, whose words repeat, are aligned by
their longest common subsequence. Coverage is the share of the template's words that are aligned in the best window. Whole
texts are processed.

Edge cases: null and empty texts have no license. Texts with no word of a template cost nothing for it. Repeated rows are
judged alone, an empty table gives an empty result. Ties go to the longer template, then to the first by name. Templates that
are null or have no word match nothing. Other columns are kept; a column named as the result is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, table

LEAST_COVERAGE, SLACK = 0.8, 1.5
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
# License names with the notices that announce them, or with their whole text where that is short.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "Apache-2.0-disclaimer": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
}


def words_at(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text, lower-cased where A-Z, and their code point spans."""
    lowered = text.lower() if text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    found = list(WORD.finditer(lowered))
    return [m[0] for m in found], [m.span() for m in found]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ascending by the first, that ascends by the second, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [y]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common_words(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, as late in ``x`` as can be."""
    best = [[0] * (len(y) + 1)]
    for w in x:
        up, row = best[-1], [0]
        for j, v in enumerate(y):
            row.append(up[j] + 1 if v == w else max(up[j + 1], row[j]))
        best.append(row)
    out, i, j = [], len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def align(text: list[tuple[int, str]], template: list[str]) -> list[tuple[int, int]]:
    """(place in the text, place in the template) of the aligned words; ``text`` is (place, word) ascending."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        once_t: dict[str, int | None] = {}
        for j in range(c, d):
            once_t[template[j]] = None if template[j] in once_t else j
        once_x: dict[str, int | None] = {}
        for i in range(a, b):
            w = text[i][1]
            if w in once_t:
                once_x[w] = None if w in once_x else i
        pairs = sorted((i, once_t[w]) for w, i in once_x.items() if i is not None and once_t[w] is not None)
        if pairs:
            kept = rising(pairs)
            out += [(text[i][0], j) for i, j in kept]
            edges = [(a - 1, c - 1), *kept, (b, d)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
        elif once_x:
            out += [(text[a + i][0], c + j) for i, j in common_words([w for _, w in text[a:b]], template[c:d])]
    return sorted(out)


def windows(text: list[tuple[int, str]], wanted: Counter, least: float, width: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, shared) of the stretches of ``text`` from each of its words, less than ``width`` places long, that share at least so many words with the template, each as often as it has it."""
    have: Counter = Counter()
    shared = b = 0
    for a, (place, word) in enumerate(text):
        while b < len(text) and text[b][0] - place < width:
            have[text[b][1]] += 1
            shared += have[text[b][1]] <= wanted[text[b][1]]
            b += 1
        if shared >= least:
            yield a, b, shared
        shared -= have[word] <= wanted[word]
        have[word] -= 1


def best_match(text: list[tuple[int, str]], template: list[str], wanted: Counter, least: float) -> list[tuple[int, int]]:
    """The longest alignment within a window of ``SLACK`` times the template; of equals the one of the shortest span, then the first."""
    best: list[tuple[int, int]] = []
    for a, b, shared in windows(text, wanted, least, int(SLACK * len(template)) + 1):
        if shared < len(best):
            continue
        own = align(text[a:b], template)
        if own and (not best or (-len(own), own[-1][0] - own[0][0]) < (-len(best), best[-1][0] - best[0][0])):
            best = own
            if len(best) == len(template) == best[-1][0] - best[0][0] + 1:
                break
    return best


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE):
        self.templates = [(k, words_at(v)[0]) for k, v in sorted(templates.items(), key=lambda x: (-len(words_at(x[1])[0]), x[0]))]
        self.templates = [(k, w, Counter(w)) for k, w in self.templates if w]
        self.known = frozenset(x for _, w, _ in self.templates for x in w)
        self.least = least

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of the templates found, best first; code points."""
        if not text:
            return []
        words, spans = words_at(text)
        own = [(i, w) for i, w in enumerate(words) if w in self.known]
        have = {w for _, w in own}
        out = []
        for name, template, wanted in self.templates:
            least = self.least * len(template) - 1e-9
            if sum(n for w, n in wanted.items() if w in have) < least:
                continue
            matched = best_match([x for x in own if x[1] in wanted], template, wanted, least)
            coverage = len(matched) / len(template)
            if matched and coverage >= self.least:
                out.append((name, round(coverage, 4), spans[matched[0][0]][0], spans[matched[-1][0]][1]))
        return sorted(out, key=lambda x: -x[1])


def templates_of(table_: DataFrame, name_col: str = "license", text_col: str = "text") -> dict[str, str]:
    """Templates from a table of licenses, which the driver and every task hold: a few thousand texts at most, by its nature."""
    return {r[0]: r[1] for r in table_.select(name_col, text_col).dropna().collect()}


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_FOUND = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with licenses, the templates found in every whole text, best first."""

    def make():
        scanner = Scanner(templates, least)
        names = ("license", "coverage", "start", "end")
        return lambda col: [pa.array([[dict(zip(names, x)) for x in scanner.scan(t)] for t in col.to_pylist()], ARROW_FOUND)]

    return annotate(docs, [text_col], make, [T.StructField("licenses", FOUND)], drop)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    best = F.get("licenses", F.lit(0))
    names = F.array_join(F.array_sort(F.transform("licenses", lambda x: x["license"])), ",")
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), best["license"].alias("license"), best["coverage"].alias("coverage"), best["start"].alias("start"), best["end"].alias("end"), names.alias("licenses"))
